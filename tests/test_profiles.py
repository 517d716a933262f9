"""Profiles, facts, ranking, sinks and the window of ISO dates: cases beyond the queries."""

import pytest
from pyspark.sql import functions as F

from postmill.functions import temporal, text
from postmill.operators import facts, ranking
from postmill.sources import profiles, sinks

PROFILE = """# Ada Example — Profile

- **Email:** ada@example.org
- **GitHub:** github.com/ada

## Education

**Some University** — Town
*BSc* — Jan 2019 – Present

## Experience

### Analyst — Firm (Remote) — Feb 2022 – May 2023
- Cut **costs** by 7%.
- Repo: https://github.com/ada/x

## Projects

### sorter — sorts things (2024)
*Python, SQL*
- Sorted.

### old — done (2001)
*(non-AI; excluded)*

## Skills
- **Tools:** Git, Docker; Git
"""


@pytest.fixture(scope="module")
def lines(spark):
    return profiles.profile_lines(spark.createDataFrame([(1, PROFILE), (2, None), (3, "")], "profile_id long, text string"))


def test_profile_entries(lines):
    got = {(r.section, r.entry): r for r in profiles.profile_entries(lines).collect()}
    assert set(got) == {("education", 1), ("experience", 1), ("projects", 1), ("projects", 2)}
    job, sorter = got[("experience", 1)], got[("projects", 1)]
    assert (job.title, job.dates, job.bullets, len(job.links)) == ("Analyst", "Feb 2022 – May 2023", ["Cut costs by 7%."], 1)
    assert (sorter.title, sorter.org, sorter.year, sorter.stack, sorter.non_ai) == ("sorter", "sorts things", "2024", "Python, SQL", False)
    assert got[("projects", 2)].non_ai and got[("education", 1)].dates == "Jan 2019 – Present"


def test_profile_contact_and_skills(lines):
    who = profiles.profile_contacts(lines).collect()
    assert len(who) == 1 and who[0].name == "Ada Example" and who[0].contact == {"email": "ada@example.org", "github": "github.com/ada"}
    assert [(r.category, r.skills) for r in profiles.profile_skills(lines).collect()] == [("Tools", ["Git", "Docker"])]


def one(spark, value, c):
    return spark.createDataFrame([(value,)], "x string").select(c.alias("c")).first().c


@pytest.mark.parametrize(
    "said, label",
    [
        ("Internship 2026-01-15 - 2026-06-30", "Jan-Jun 2026"),
        ("Applications for the internship: 2026-01-15 to 2026-06-30", "unknown"),
        ("2026-01-15 to 2026-06-30", "unknown"),
        ("Apply until 2026-01-01 to 2026-02-01. Term: 2026-11-01 to 2027-02-01", "Nov-Feb 2026"),
    ],
)
def test_iso_window(spark, said, label):
    assert one(spark, said, temporal.window(F.col("x")))["label"] == label


def test_role_and_pages(spark):
    assert one(spark, "We are big\nresponsibilities matter to us, as we have long said to all\n## Your Role:\nWork", text.role_description(F.col("x"))) == "## Your Role:\nWork"
    assert one(spark, "No heading", text.role_description(F.col("x"))) == "No heading"
    assert [one(spark, t, facts.pages(F.col("x"))) for t in (None, "", "a", "a\fb", "a\fb\f")] == [0, 0, 1, 2, 2]


def test_relevance_caps_words(spark):
    many = " ".join(f"w{i:02d}" for i in range(40))
    got = one(spark, many + " sql", ranking.relevance(F.col("x"), F.array(F.lit("SQL")), F.split(F.lit(many), " "), {"SQL": []}))
    assert got == pytest.approx(2.0 + 2.5)


def test_facts_of_nothing(spark):
    words, numbers = spark.createDataFrame([], "word string"), spark.createDataFrame([], "number string")
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "Made 5")], "id long, text string")
    assert sorted(tuple(r) for r in facts.violations(texts, words, numbers).collect()) == [(3, "number", "5"), (3, "unknown-word", "made")]
    assert facts.violations(texts.limit(0), words, numbers).count() == 0


def test_queue_files(spark, tmp_path):
    rows = [("a", "pending", None, "C", "T", "s", "u", "[]", '["x"]'), ("b", "pending", 0.5, "D", "T", "s", "u", "bad", None), ("c", "approved", 0.9, "E", "T", "s", "u", "[]", "[]")]
    q = spark.createDataFrame(rows, "stable_id string, status string, score double, company string, title string, source string, apply_url string, gaps string, matched_keywords string")
    assert [r.stable_id for r in sinks.queue_items(q).collect()] == ["b", "a"]
    sinks.write_queue(q, f"{tmp_path}/j")
    back = spark.read.json(f"{tmp_path}/j")
    assert back.count() == 2 and back.where("stable_id = 'a'").first().matched_keywords == ["x"]
    sinks.write_queue(q, f"{tmp_path}/m", "md")
    assert "## D - T (score 0.5)" in "\n".join(r.value for r in spark.read.text(f"{tmp_path}/m").collect())
