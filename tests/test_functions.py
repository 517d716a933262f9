"""Case tables of the text, date, money and filter rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from postmill import config
from postmill.config import Lifecycle, Rules
from postmill.functions import money, temporal, text
from postmill.operators import facts, filters, reports, score, select, state


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def each(spark, texts, c):
    """The value of an expression for each text, in one job."""
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", c.alias("c")).collect()
    return [r.c for r in sorted(rows, key=lambda r: r.n)]


# expected values of cases: fixed values of the rules
STIPENDS = {
    "Stipend: ₹30,000": ("confirmed_ge_floor", 30000, 30000),
    "Stipend: ₹40,000/month": ("confirmed_ge_floor", 40000, 40000),
    "Stipend: ₹29,999/month": ("confirmed_below_floor", 29999, 29999),
    "Stipend: INR 15,000-18,000/ month": ("confirmed_below_floor", 15000, 18000),
    "Stipend range- Rs 5000 - Rs 10000": ("confirmed_below_floor", 5000, 10000),
    "Stipend: ₹12-15k per month": ("confirmed_below_floor", 12000, 15000),
    "Stipend: ₹25,000-35,000/month": ("confirmed_below_floor", 25000, 35000),
    "Stipend: ₹8,000 - ₹12,000 per month": ("confirmed_below_floor", 8000, 12000),
    "This is an unpaid role": ("unpaid", None, None),
    "Stipend: $3,000 per month": ("unstated", None, None),
    "Salary ₹6 LPA": ("confirmed_ge_floor", 50000, 50000),
    "": ("unstated", None, None),
    None: ("unstated", None, None),
    "CTC ₹6,00,000/annum. Stipend ₹15,000/month.": ("confirmed_below_floor", 15000, 15000),
    "₹60,000 for 3 months stipend": ("confirmed_below_floor", 20000, 20000),
    "Stipend: ₹60,000 over 8 weeks": ("unstated", None, None),
    "Stipend: up to ₹10,000 per month": ("confirmed_below_floor", 10000, 10000),
    "Stipend: up to ₹50,000 per month": ("unstated", None, None),
    "We do not offer unpaid internships. Stipend ₹35,000/month": ("confirmed_ge_floor", 35000, 35000),
    "Unpaid internship. Salary later ₹40,000": ("unpaid", None, None),
    "₹30,000/month plus a ₹5,000 bonus": ("confirmed_ge_floor", 30000, 30000),
    "Stipend 40,000/month, USD. INR": ("unstated", None, None),
    "₹500 per day stipend": ("unstated", None, None),
    "Stipend: 6-8 LPA INR": ("confirmed_ge_floor", 50000, 66666),
    "₹4.8 Lakhs": ("confirmed_ge_floor", 40000, 40000),
    "Annual stipend: ₹3,00,000": ("confirmed_below_floor", 25000, 25000),
    "Travel allowance ₹2,000/month stipend ₹30,000/month": ("confirmed_ge_floor", 30000, 30000),
    "6 months internship in 2026, stipend 32000 INR": ("confirmed_ge_floor", 32000, 32000),
    "Stipend ₹25,000-30k per month": ("confirmed_below_floor", 25000, 30000),
    "Paid in USD, stipend 40,000 per month. INR welcome": ("unstated", None, None),
    "Stipend 40,000 (USD) INR": ("unstated", None, None),
    "Stipend: ₹35,000 per month in US dollars": ("unstated", None, None),
    "Reports in USD. Stipend: ₹35,000 per month": ("confirmed_ge_floor", 35000, 35000),
    "No stipend": ("unpaid", None, None),
    "Unpaid positions are not offered. ₹31k stipend": ("confirmed_ge_floor", 31000, 31000),
    "Commission-only": ("unpaid", None, None),
    "Stipend: ₹2,000 per week": ("unstated", None, None),
    "Stipend: Rs. 20000 p.m. for 40 employees": ("confirmed_below_floor", 20000, 20000),
}


def test_stipends(spark):
    got = each(spark, list(STIPENDS), money.stipend(F.col("x")))
    assert {t: tuple(g) for t, g in zip(STIPENDS, got, strict=True)} == STIPENDS


WINDOWS = {
    "January 2026 - June 2026": (True, "Jan-Jun 2026"),
    "September to December 2026": (False, "Sep-Dec 2026"),
    "Summer 2026 internship": (True, "Summer 2026"),
    "great internship": (None, "unknown"),
    "Spring Boot and Java": (None, "unknown"),
    "Spring Boot internship": (None, "unknown"),
    "Spring internship": (True, "Spring"),
    "Internship, Summer": (True, "Summer"),
    "Trainee program in the Winter": (None, "unknown"),
    "Trainee for Winter": (True, "Winter"),
    "Fall (2026)": (False, "Fall 2026"),
    "November to February": (True, "Nov-Feb"),
    "07/2026 - 12/2026": (False, "Jul-Dec 2026"),
    "01/ - 06/2026": (True, "Jan-Jun 2026"),
    "13/2026 - 14/2026": (None, "unknown"),
    "starts 2026-01-15": (None, "unknown"),
    "from May to August 2026": (True, "5-Aug 2026"),
    "start in March 2026": (True, "Mar-Mar 2026"),
    "Feburary - June 2026": (True, "Feb-Jun 2026"),
    "March to Mayor": (None, "unknown"),
    "Jan.–Jun. 2026": (True, "Jan-Jun 2026"),
    "In October 2026 we met. July-August 2026": (False, "Jul-Aug 2026"),
    "": (None, "unknown"),
    None: (None, "unknown"),
}


def test_windows(spark):
    got = each(spark, list(WINDOWS), temporal.window(F.col("x")))
    assert {t: (g.overlaps, g.label) for t, g in zip(WINDOWS, got, strict=True)} == WINDOWS
    assert [g.detail for g in got[:4]] == ["explicit range Jan-Jun 2026", "explicit range Sep-Dec 2026", "season Summer 2026", "no timing signal found"] and got[-1].detail == "no text to inspect"


DEADLINES = {
    "Apply by March 15, 2026.": "2026-03-15",
    "Apply: 1 March 2026 - 5 April 2026": "2026-04-05",
    "Apply: March 1, 2026 through April 5, 2026": "2026-04-05",
    "Apply - 2026-03-01 to 2026-04-01": "2026-04-01",
    "Applications open January 1, 2026 and close February 1, 2026": "2026-02-01",
    "Applications are open January 1, 2026, closing on February 1st, 2026": "2026-02-01",
    "Applications open January 1 2026–February 3 2026": "2026-02-03",
    "Applications open January 1, 2026": "",
    "Applications accepted until March 3, 2026": "2026-03-03",
    "Applications are accepted until positions are filled. Starts May 1, 2026": "",
    "applications are closed on March 3, 2026": "2026-03-03",
    "The deadline is far. Starts 2026-05-01": "",
    "Deadline: 2026-02-30": "",
    "Deadline: 2026-02-30. Apply by 3rd Sept 2026": "2026-09-03",
    "Last date to apply - 2 Feb 2026": "2026-02-02",
    "Apply no later than 15.03.2026": "",
    "Deadline for applying: Sept. 9, 2026": "2026-09-09",
    "": "",
    None: "",
}


def test_deadlines(spark):
    got = each(spark, list(DEADLINES), temporal.deadline(F.col("x")))
    assert dict(zip(DEADLINES, got, strict=True)) == DEADLINES


def test_deadline_status_edges(spark):
    day = F.lit("2026-03-10").cast("date")
    want = {"2026-03-09": "expired", "2026-03-10": "closing_soon", "2026-03-17": "closing_soon", "2026-03-18": "open", "ASAP": "", None: ""}
    for value, status in want.items():
        assert one(spark, value, temporal.deadline_status(F.col("x"), day)).c0 == status


def test_open_state(spark):
    now = F.lit("2026-09-20 00:00:00").cast("timestamp")
    raw = '{"regn_open":1,"status":"LIVE","end_date":"2026-09-29T00:00:00+05:30","regnRequirements":{"end_regn_dt":"2026-09-15T11:42:19+05:30"}}'
    cases = [
        ("", raw, "x", "closed", "registration closed 2026-09-15T11:42:19+05:30"), ("", raw.replace("-15T", "-25T"), "x", "open", ""),
        ("", '{"end_date":"2026-01-01"}', "lever", "unverified", ""), ("", '{"end_date":"2026-01-01"}', "unstop", "closed", "registration ended 2026-01-01"),
        ("", '{"end_date":"2027-01-01"}', "unstop", "unverified", ""), ("", '{"regn_open":"false"}', "x", "closed", "registration is not open (regn_open is false)"),
        ("", '{"regn_open":null}', "x", "closed", "registration is not open (regn_open is false)"), ("", '{"regn_open":1}', "unstop", "unverified", ""),
        ("", '{"start_regn_dt":"2026-10-01T00:00:00"}', "x", "closed", "registration opens later (2026-10-01T00:00:00)"), ("", '{"end_regn_dt":"soon"}', "x", "unverified", ""),
        ("We are no longer accepting candidates", "{}", "x", "closed", "the posting states the application is closed"), ("Apply by March 3, 2026", "{}", "x", "closed", "the application deadline 2026-03-03 has passed"), ("", None, None, "unverified", ""),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, text string, raw string, source string, state string, reason string")
    got = df.select("n", temporal.open_state(F.col("text"), F.lit(""), F.col("raw"), now, F.col("source")).alias("o")).orderBy("n").collect()
    assert [(r.o.state, r.o.reason) for r in got] == [c[3:] for c in cases]


def test_phrases_are_whole_and_in_list_order(spark):
    f = lambda t, terms: one(spark, t, text.find_term(F.col("x"), terms)).c0
    assert f("Internal tools", ["intern"]) is None
    assert f("An intern; a co-op", ["co-op", "intern"]) == "co-op"
    assert f("Team lead wanted", ["lead "]) == "lead "
    assert f(None, ["a"]) is None


def test_terms_by_first_place(spark):
    lex = {"C++": ["c++"], "Java": ["java"], "JavaScript": ["javascript", "js"], "R": []}
    assert one(spark, "JS, then Java and C++ (not R)", text.extract_terms(F.col("x"), lex)).c0 == ["JavaScript", "Java", "C++"]
    assert one(spark, "c++11", text.extract_terms(F.col("x"), {"C": ["c"]})).c0 == []


def test_urls(spark):
    assert one(spark, "HTTPS://Ex.com/A/?b=2&a=1#x", text.norm_url(F.col("x"))).c0 == "https://ex.com/a?a=1&b=2"
    assert one(spark, "Ex.com/A/", text.norm_url(F.col("x"))).c0 == "ex.com/a"


def test_html(spark):
    rows = spark.createDataFrame([("<p>A&amp;B<br>c</p><script>x()</script><li> d&nbsp; e</li>",), ("x &lt; y",), (None,)], "h string")
    assert [r.t for r in rows.select(text.html_to_text("h").alias("t")).collect()] == ["A&B\nc\nd e", "x < y", None]


def test_quiet_days_and_published(spark):
    got = one(spark, "1700000000", temporal.published_date(F.col("x")), temporal.quiet_days(F.lit("2026-03-10").cast("date"), F.lit("2026-03-01").cast("timestamp"), F.lit(None).cast("timestamp")))
    assert got.c0 == dt.date(2023, 11, 14) and got.c1 == 9


POSTINGS = "title string, location string, employment_type string, description string, is_remote boolean"


def postings(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {POSTINGS}").withColumns({"company": F.lit("A"), "stable_id": F.col("n").cast("string")})
    return df.withColumn("open", F.struct(F.lit("unverified").alias("state"), F.lit("").alias("reason")))


def test_demo_postings(spark):
    rows = [
        ("Machine Learning Intern", "Bengaluru, India", "Internship", "Runs January 2026 - June 2026. Stipend ₹40,000/month", None),
        ("Senior Software Engineer", "Bengaluru, India", "FullTime", "", None),
        ("Research Intern", "San Francisco, United States", "Intern", "", None),
        ("Data Intern (Full-Time)", "Remote - Worldwide", "FullTime", "", True),
        ("Intern", "Remote", "", "We are a team in Germany", True),
    ]
    got = filters.filter_postings(postings(spark, rows), Rules()).orderBy("n").collect()
    assert [r.eligible for r in got] == [True, False, False, True, True]
    assert got[1].reject_reasons == ["internship: not identifiable as an internship", "fulltime: full-time signal 'fulltime'", "seniority: seniority keyword 'senior' in title"]
    assert got[2].reject_reasons == ["india_eligible: onsite location abroad ('united states')"]
    assert got[0].review_reasons == []
    assert got[3].review_reasons == ["ambiguous: internship title with full-time signal 'full-time'; review before applying", "stipend not stated; verify before applying"]
    assert not got[4].place.auto_ok and got[4].place.detail == "location/work-authorization restriction stated in the description ('germany'); review before applying"
    assert [c.name for c in got[0].checks] == ["internship", "fulltime", "seniority", "india_eligible", "application_open", "stipend", "window"]
    assert got[0].checks[6].detail == "explicit range Jan-Jun 2026 overlaps Jan-Jun" and got[0].checks[5].detail == "₹40,000/mo confirmed"


def test_matches(spark):
    """Scores in bounds, coverage and bands, the company's own words left out, red flags."""
    rows = [
        ("Machine Learning Intern", "Pune, India", "Internship", "January 2026 - June 2026. Python, RAG, Kubernetes, TensorFlow. Stipend ₹40,000/month", None),
        ("Intern", "Pune, India", "Internship", "We do machine learning with Python\nResponsibilities\nMake tea", None),
        ("Intern", "Paris, France", "Internship", "React, SQL, AWS, Azure, Linux, Docker, NLP, Flask, Django. unpaid", True),
    ]
    got = score.match_postings(filters.filter_postings(postings(spark, rows)), F.array(F.lit("Python"), F.lit("RAG"), F.lit("Machine Learning")))
    got = got.withColumn("flags", filters.red_flags(got)).orderBy("n").collect()
    first = got[0]
    assert first.coverage.matched == ["Machine Learning", "Python", "RAG"] and first.coverage.missing == ["Kubernetes", "TensorFlow"]
    assert first.domain_scores == {"ai_ml": 0.7, "software": 0.1, "research": 0.0} and first.band == "strong"
    assert first.score == pytest.approx(0.45 * 0.6 + 0.25 * 0.7 + 0.15 + 0.10 + 0.05)
    assert first.match_reasons == [
        "skill coverage 60% (3/5 JD terms supported by profile)", "role relevance 0.70 (ai_ml=0.70, software=0.10, research=0.00)", "location fit 1.00: location is in India",
        "window fit 1.00: explicit range Jan-Jun 2026", "seniority fit 1.00: internship", "gaps (never inserted): Kubernetes, TensorFlow", "supported JD terms: Machine Learning, Python, RAG",
    ]
    tea = got[1]
    assert (tea.coverage.matched, tea.coverage.ratio, tea.components.skill_coverage, tea.components.role_relevance, tea.components.window_fit) == ([], 0, 0.5, 0, 0.3)
    assert got[2].flags == [
        "location may not be open to India: remote restricted to non-India region 'france'", "JD asks for 9 skills absent from the profile; these are reported as gaps and were not inserted",
        "low keyword coverage; the resume may not speak to this JD", "posting may be unpaid; confirm",
    ]
    assert got[0].flags == ["remote eligibility is not stated; confirm the work location"] and all(0 <= r.score <= 1 for r in got)


def test_blocking_and_lifecycle(spark):
    limits = Lifecycle()
    apps = spark.createDataFrame(
        [(1, "a", "failed", ""), (2, "b", "manual_required", "capped"), (3, "c", "manual_required", "human_rejected"), (4, "d", "submitted", ""), (5, "d", "failed", ""), (6, "e", "submitting", ""), (7, "c", "manual_required", "config"), (8, "f", "dry_run", "")],
        "id long, stable_id string, status string, review_category string",
    )
    assert {(r.stable_id, r.id) for r in state.blocking(apps, limits).collect()} == {("c", 3), ("d", 4), ("e", 6)}
    day = F.lit("2026-03-20").cast("date")
    rows = [(1, "a", "Zeta", "submitted", "", 0), (2, "b", "beta", "submitted", "Rejected ", 0), (3, "c", "Alpha", "manual_required", None, 2), (4, "d", "Alpha", "submitted", "interview", None), (5, "e", "x", "failed", "", 0)]
    life = spark.createDataFrame(rows, "id long, stable_id string, company string, status string, outcome string, reminders int").withColumns({"last_followup_at": F.lit(None).cast("timestamp"), "submitted_at": F.lit("2026-03-01").cast("timestamp"), "updated_at": F.lit("2026-03-05").cast("timestamp"), "notes": F.lit("")})
    ok = spark.createDataFrame([("c",)], "stable_id string")
    due = reports.quiet_applications(life, ok, day, limits.followup_days, limits.max_reminders)
    assert [r.stable_id for r in due.orderBy(*reports.quiet_order()).collect()] == ["d", "a"]
    stale = reports.quiet_applications(life, ok, day, 15)
    assert {r.stable_id for r in stale.collect()} == {"a", "c", "d"}
    swept = {r.stable_id: r for r in state.sweep_stale(life, stale, F.lit("2026-03-20 00:00:00").cast("timestamp")).collect()}
    assert swept["a"].outcome == "no_response" and swept["a"].notes.endswith("stale resolved no_response after 15 days quiet") and swept["b"].outcome == "Rejected "


def test_guards_in_order(spark):
    w = lambda o: {"label": "x", "confidence": 1.0, "overlaps": o, "detail": ""}
    good = ("lever", False, w(True), "strong", [], True)
    rows = [("linkedin", True, w(None), "x", ["r"], False), ("naukri", True, w(None), "x", [], False), ("lever", True, w(None), "x", [], False), ("lever", False, w(False), "x", [], False), ("lever", False, w(True), "shortlist", ["r"], False), ("lever", False, w(True), "strong", ["r"], False), good, (*good[:5], False), good, good, good]
    df = spark.createDataFrame([(f"p{i:02d}", *r, 1.0 - i / 100) for i, r in enumerate(rows)], "stable_id string, source string, requires_review boolean, window struct<label:string,confidence:double,overlaps:boolean,detail:string>, band string, review_reasons array<string>, can_submit boolean, score double")
    limits = Lifecycle(daily_cap=3, manual_sources=("naukri",))
    known = spark.createDataFrame([("p06",)], "stable_id string")
    used = spark.createDataFrame([(1,)], "n long")
    got = [r.guard for r in select.guard_chain(df, known, used, limits, [F.desc("score"), F.asc("stable_id")]).orderBy("stable_id").collect()]
    assert got == ["linkedin", "manual_source", "generation", "window", "match", "filter", "duplicate", "no_channel", "submit", "submit", "capped"]
    off = select.guard_chain(df, known, used, Lifecycle(armed=False), [F.desc("score")], dry_run=True).orderBy("stable_id").collect()
    assert off[8].guard == "config"


def test_robots(spark):
    body = "User-agent: bot\nUser-agent: other\n\nDisallow: /p*/x$\nAllow: /pub\n# c\nUser-agent: *\nDisallow: /secret%20\nDisallow: /q?\n"
    policies = select.robots_rules(spark.createDataFrame([("a", 200, body), ("b", 404, None), ("c", 500, None), ("d", 200, "<html>oops</html>"), ("e", 200, " "), ("f", None, None)], "host string, status int, body string"))
    urls = [("a", "/pub/y", True), ("a", "/pub/x", False), ("a", "/prv/x", False), ("a", "/prv/xy", True), ("a", "/secret x", False), ("a", "/secret%20x", False), ("a", "/q?a=1", False), ("a", "", True), ("b", "/", True), ("c", "/", False), ("d", "/", False), ("e", "/x", True), ("f", "/", False), ("nowhere", "/", False)]
    df = spark.createDataFrame([(i, h, p) for i, (h, p, _) in enumerate(urls)], "url_id int, host string, path string")
    got = {r.url_id: r.allowed for r in select.robots_allowed(df, policies, "Bot").collect()}
    assert [got[i] for i in range(len(urls))] == [ok for *_, ok in urls]


def test_numbers_and_words_of_facts(spark):
    said = r"Cut \textbf{51/51} of $x^2$ by 94% in C++ and node.js. Up 1,250.50 (re-use)"
    assert one(spark, said, text.numbers_in(F.col("x"))).c0 == ["51/51", "51", "94%", "1250.50"]
    assert one(spark, said, text.content_tokens(F.col("x"))).c0 == ["cut", "of", "by", "in", "c++", "and", "node.js", "up", "re-use"]
    assert one(spark, "e\u0301a", text.nfc(F.col("x"))).c0 == "\u00e9a" and text.string_list([" a", "b", "a", ""]) == ["a", "b"] and text.string_list("x ") == ["x"] and text.string_list(None) == []


def test_id_resolution(spark):
    one_col = lambda ids: spark.createDataFrame([(i,) for i in ids], "stable_id string")
    with_id = lambda rows: spark.createDataFrame(rows, "id long, stable_id string")
    refs = spark.createDataFrame([(" s:1",), ("7",), ("8",), ("s:9",), ("",), ("007",), ("99",)], "ref string")
    got = {r.ref: r.stable_id for r in state.resolve_ids(refs, one_col(["s:1"]), with_id([(7, "q:7")]), with_id([(7, "a:7"), (8, "a:8")])).collect()}
    assert got == {" s:1": "s:1", "7": "q:7", "8": "a:8", "s:9": "", "": "", "007": "q:7", "99": ""}


def test_parameter_files(tmp_path):
    (tmp_path / "x.toml").write_text("")
    assert config.first_existing("x.toml", [str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path / "x.toml") and config.first_existing(" ", []) is None
    with pytest.raises(FileNotFoundError):
        config.first_existing("y.toml", [str(tmp_path)])


def test_borderline_only_if_nothing_is_included(spark):
    rows = [(i, "open", False, "unstated", False, 0.45, float(i)) for i in range(10)]
    cols = "id long, open_state string, excluded boolean, stipend_state string, title_hit boolean, relevance double, score double"
    got = select.buckets(spark.createDataFrame(rows, cols)).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in got} == {"borderline": 8, "held": 2}
    got = select.buckets(spark.createDataFrame([*rows, (99, "open", False, "unstated", False, 0.9, 1.0)], cols)).groupBy("bucket").count().collect()
    assert {r["bucket"]: r["count"] for r in got} == {"included": 1, "held": 10}


def test_upsert_rules(spark):
    old = spark.createDataFrame([("a", 1, "x", "o"), ("b", 2, "y", "o")], "k string, score int, state string, note string")
    new = spark.createDataFrame([("a", 9, "", "n"), ("c", 3, "z", "n")], "k string, score int, state string, note string")
    got = {r.k: tuple(r)[1:] for r in state.upsert(old, new, "k", keep=("score",), fill_empty=("state",)).collect()}
    assert got == {"a": (1, "x", "n", False), "b": (2, "y", "o", False), "c": (3, "z", "n", True)}


def test_survival_folds_quotes_and_composed_letters(spark):
    asked = F.array(*map(F.lit, ('say "yes" - now', "caf\u00e9", "it's", "absent")))
    raw = spark.createDataFrame([("Say \u201cYes\u201d \u2013\u00a0now; cafe\u0301, it\u2019s",)], "x string").select(text.nfc(F.col("x")).alias("x"))
    assert raw.select(facts.survival(F.col("x"), asked)).first()[0] == 0.75


def test_report_conditions(spark):
    df = spark.createDataFrame([(1, True, 0.9), (2, True, None), (3, False, 0.8)], "id int, eligible boolean, score double")
    ids = lambda **c: [r.id for r in reports.postings_where(df, **c).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(eligible=True) == [1, 2] and ids(min_score=0.5) == [1, 3] and ids(eligible=False, min_score=0.5) == [3]
