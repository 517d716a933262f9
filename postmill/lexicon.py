"""The terms that postings are searched for: each canonical name with its other forms (fixed values)."""

LEXICON: dict[str, list[str]] = {
    "Python": ["python"],
    "C++": ["c++", "cpp"],
    "Java": ["java"],
    "JavaScript": ["javascript", "js"],
    "TypeScript": ["typescript"],
    "SQL": ["sql"],
    "PostgreSQL": ["postgresql", "postgres"],
    "R": [],
    "HTML/CSS": ["html", "css", "html/css"],
    "React": ["react", "react.js", "reactjs"],
    "Node.js": ["node.js", "nodejs", "node"],
    "FastAPI": ["fastapi"],
    "Flask": ["flask"],
    "Django": ["django"],
    "REST APIs": ["rest api", "restful", "rest apis"],
    "GraphQL": ["graphql"],
    "Docker": ["docker", "containerization"],
    "Kubernetes": ["kubernetes", "k8s"],
    "Git": ["git", "version control"],
    "CI/CD": ["ci/cd", "continuous integration", "continuous delivery"],
    "Google Cloud Platform": ["google cloud", "gcp"],
    "AWS": ["aws", "amazon web services"],
    "Azure": ["azure"],
    "Linux": ["linux", "unix"],
    "Machine Learning": ["machine learning", "ml"],
    "Deep Learning": ["deep learning", "neural network", "neural networks"],
    "LLMs": ["llm", "llms", "large language model", "large language models"],
    "Generative AI": ["generative ai", "genai", "generative"],
    "NLP": ["nlp", "natural language processing"],
    "Computer Vision": ["computer vision", "cv"],
    "RLHF": ["rlhf", "reinforcement learning from human feedback"],
    "Reinforcement Learning": ["reinforcement learning"],
    "Prompt Engineering": ["prompt engineering", "prompting"],
    "RAG": ["rag", "retrieval augmented generation", "retrieval-augmented generation"],
    "Fine-tuning": ["fine-tuning", "finetuning", "fine tuning", "lora", "peft"],
    "PyTorch": ["pytorch", "torch"],
    "TensorFlow": ["tensorflow"],
    "Hugging Face": ["hugging face", "huggingface", "transformers"],
    "Scikit-learn": ["scikit-learn", "sklearn", "scikit learn"],
    "pandas": ["pandas"],
    "NumPy": ["numpy"],
    "Matplotlib": ["matplotlib"],
    "XGBoost": ["xgboost"],
    "Data Analysis": ["data analysis", "data analytics", "analytics"],
    "Data Science": ["data science", "data scientist"],
    "Data Engineering": ["data engineering", "data engineer", "etl", "data pipeline", "data pipelines"],
    "Data Visualization": ["data visualization", "data visualisation", "visualization", "dashboard", "tableau", "power bi"],
    "Statistics": ["statistics", "statistical", "hypothesis testing", "confidence interval", "confidence intervals"],
    "Forecasting": ["forecasting", "forecast", "time series", "time-series"],
    "Evaluation": ["evaluation", "eval", "benchmark", "benchmarking", "a/b test", "ab test"],
    "MLOps": ["mlops", "model deployment", "model serving"],
    "Model Deployment": ["model deployment", "deployment", "serving"],
    "Predictive Modeling": ["predictive modeling", "predictive modelling", "predictive model"],
    "Research": ["research", "research scientist", "publication", "publications"],
    "Algorithms": ["algorithms", "data structures"],
    "Optimization": ["optimization", "optimisation"],
    "Security": ["security", "appsec", "guardrails"],
    "Automation": ["automation", "scripting", "automation scripting"],
    "Data Scraping": ["data scraping", "web scraping", "scraping"],
    "Communication": ["communication", "stakeholder", "cross-functional", "collaboration"],
    "Problem Solving": ["problem solving", "problem-solving", "analytical"],
    "Agile": ["agile", "scrum"],
}
