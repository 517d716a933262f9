"""Queries of profiles, ranking, facts, sinks and reviews over the driver's tables; as in ``queries``, the SQL reads typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions import temporal, text
from postmill.operators import facts, ranking, score, state
from postmill.plans.queries import query
from postmill.session import read_table
from postmill.sources import profiles, sinks

#: Words of the corpus that stand for a lexicon.
LEXICON = {"The": ["the"], "License": ["license"], "Que": ["que"], "Der": ["der", "die"]}


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    """A profile for each customer: contact data, one entry with two bullets, two lines of skills."""
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    lines = [
        F.concat(F.lit("# "), name, F.lit(" — Profile")), F.lit(""), F.concat(F.lit("- **Email:** c"), k, F.lit("@example.com")), F.concat(F.lit("- **Phone:** "), k), F.lit("---"), F.lit("## Experience"),
        F.concat(F.lit("### "), F.col("c_mktsegment"), F.lit(" Clerk — Org "), F.col("c_nationkey").cast("string"), F.lit(" — Jan 2020 – Mar 2021")),
        F.when(F.col("c_custkey") % 2 == 0, "*(non-AI; excluded)*").otherwise(""), F.concat(F.lit("- Kept "), k, F.lit(" `accounts`.")), F.lit("- Repo: example.com/x"), F.lit("- Wrote **reports**."),
        F.lit("## Technical Skills"), F.lit("- **Languages:** SQL, Python; SQL"), F.concat(F.lit("- **Trades:** "), F.col("c_mktsegment"), F.lit(", Sales")),
    ]
    return read_table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.concat_ws("\n", *lines).alias("text"))


@query("profile_contacts", "SELECT c_custkey AS profile_id, c_name AS name, 'c' || c_custkey || '@example.com' AS email, c_custkey::VARCHAR AS phone FROM customer")
def profile_contacts(spark, d):
    return profiles.profile_contacts(profiles.profile_lines(_profiles(spark, d))).select("profile_id", "name", F.col("contact")["email"].alias("email"), F.col("contact")["phone"].alias("phone"))


@query("profile_skills", "SELECT c_custkey AS profile_id, 'Languages' AS category, ['SQL', 'Python'] AS skills FROM customer UNION ALL SELECT c_custkey, 'Trades', [c_mktsegment, 'Sales'] FROM customer")
def profile_skills(spark, d):
    return profiles.profile_skills(profiles.profile_lines(_profiles(spark, d))).select("profile_id", "category", "skills")


@query("profile_entries", "SELECT c_custkey AS profile_id, 'experience' AS section, 1 AS entry, c_mktsegment || ' Clerk' AS title, 'Org ' || c_nationkey AS org, 'Jan 2020 – Mar 2021' AS dates, c_custkey % 2 = 0 AS non_ai, ['Kept ' || c_custkey || ' accounts.', 'Wrote reports.'] AS bullets, 1 AS links FROM customer")
def profile_entries(spark, d):
    return profiles.profile_entries(profiles.profile_lines(_profiles(spark, d))).select("profile_id", "section", "entry", "title", "org", "dates", "non_ai", "bullets", F.size("links").alias("links"))


@query(
    "ranked_entries",
    """WITH s AS (SELECT p_brand, p_partkey, 2.0 * (p_size % 3 = 0)::INT + 0.1 * (1 + (p_size % 2)) AS relevance FROM part)
    SELECT p_brand, p_partkey, rank, round(relevance, 6) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY round(relevance, 6) DESC, p_partkey) AS rank FROM s) WHERE rank <= 4""",
)
def ranked_entries(spark, d):
    words = F.concat_ws(" ", F.when(F.col("p_size") % 3 == 0, "License:").otherwise("(none)"), F.lit("alpha"), F.when(F.col("p_size") % 2 == 1, "beta"))
    asked, known = F.array(F.lit("License")), F.array(F.lit("alpha"), F.lit("beta"))
    rows = read_table(spark, d, "part").select("p_brand", "p_partkey", F.round(ranking.relevance(words, asked, known, LEXICON), 6).alias("relevance"))
    return ranking.best_entries(rows, ["p_brand"], "p_partkey", 4).select("p_brand", "p_partkey", "rank", "relevance")


@query("skills_first", "SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN ['Python', c_mktsegment, 'SQL'] ELSE [c_mktsegment, 'SQL', 'Python'] END AS skills, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS relevance FROM customer")
def skills_first(spark, d):
    skills = F.array(F.col("c_mktsegment"), F.lit("SQL"), F.lit("Python"))
    posting = F.when(F.col("c_nationkey") % 2 == 0, "We use python.").otherwise(F.concat(F.lit("sql and "), F.lower("c_mktsegment")))
    return read_table(spark, d, "customer").select("c_custkey", ranking.skills_first(skills, posting).alias("skills"), ranking.category_relevance(skills, posting).alias("relevance"))


@query("role_description", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'We are ' || p_brand || chr(10) || p_name WHEN p_partkey % 3 = 1 THEN '**Requirements:**' || chr(10) || p_name ELSE 'What you’ll do here' || chr(10) || p_name || chr(10) || 'Requirements' END AS role FROM part")
def role_description(spark, d):
    k = F.col("p_partkey") % 3
    blurb = F.concat(F.lit("We are "), F.col("p_brand"))
    words = F.concat_ws("\n", blurb, F.when(k == 1, "**Requirements:**").when(k == 2, "What you’ll do here"), F.col("p_name"), F.when(k == 2, "Requirements"))
    return read_table(spark, d, "part").select("p_partkey", text.role_description(words).alias("role"))


@query("surface_forms", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['der', 'die', 'Que'] WHEN 1 THEN ['die', 'Que', 'que'] ELSE ['Artikel', 'Que'] END AS forms FROM orders")
def surface_forms(spark, d):
    k = F.col("o_orderkey") % 3
    words = F.when(k == 0, "Die und der").when(k == 1, "die, quE2 & que.").otherwise("derby")
    forms = text.surface_forms(F.array(F.lit("Artikel"), F.lit("Que")), words, {"Artikel": ["der", "die"], "Que": ["que"]})
    return read_table(spark, d, "orders").select("o_orderkey", forms.alias("forms"))


@query("emphasised_figures", r"SELECT p_partkey, 'Cut cost by \textbf{' || p_size || '%} on v2.5x with \textbf{' || p_partkey || '} rows' AS said FROM part")
def emphasised_figures(spark, d):
    return read_table(spark, d, "part").select("p_partkey", text.emphasise(F.concat(F.lit("Cut cost by "), F.col("p_size").cast("string"), F.lit("% on v2.5x with "), F.col("p_partkey").cast("string"), F.lit(" rows"))).alias("said"))


@query(
    "technical_relevance",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_discount AS a, l_returnflag = 'R' AS hit, CASE WHEN l_returnflag = 'R' THEN l_tax ELSE 0 END AS b FROM lineitem)
    SELECT l_orderkey, l_linenumber, greatest(a, b) AS score, CASE WHEN greatest(a, b) <= 0 THEN '' WHEN a >= b THEN 'data' ELSE 'research' END AS domain, hit AS core_hit FROM s""",
)
def technical_relevance(spark, d):
    scores = F.create_map(F.lit("data"), F.col("l_discount"), F.lit("research"), F.col("l_tax"))
    r = score.technical_relevance(scores, F.array(F.col("l_returnflag")), ["data", "research", "unknown"], ["research"], ["R"])
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.score", "r.domain", "r.core_hit")


@query(
    "score_reasons",
    """SELECT p_partkey, ['skill coverage ' || (CASE WHEN p_size % 2 = 0 THEN '50%' ELSE '0%' END) || ' (' || (CASE WHEN p_size % 2 = 0 THEN '1/2' ELSE '0/1' END) || ' JD terms supported by profile)', 'role relevance 0.50', 'gaps (never inserted): ' || p_brand]
      || CASE WHEN p_size % 2 = 0 THEN ['supported JD terms: SQL'] ELSE [] END AS reasons FROM part""",
)
def score_reasons(spark, d):
    matched = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("SQL"))).otherwise(F.array().cast("array<string>"))
    return read_table(spark, d, "part").select("p_partkey", score.reasons(matched, F.array(F.col("p_brand")), [F.lit("role relevance 0.50")]).alias("reasons"))


@query("iso_windows", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN month(o_orderdate) <= 6 OR month(o_orderdate) > month(o_orderdate + INTERVAL 60 DAY) END AS overlaps, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.0 END AS confidence FROM orders")
def iso_windows(spark, d):
    day = lambda n: F.date_format(F.date_add("o_orderdate", n), "yyyy-MM-dd")
    pair = F.concat(day(0), F.lit(" to "), day(60))
    k = F.col("o_orderkey") % 3
    words = F.when(k == 0, F.concat(F.lit("Apply now. The internship runs "), pair, F.lit("; paid."))).when(k == 1, F.concat(F.lit("Internship. Applications: "), pair)).otherwise(pair)
    w = temporal.window(words)
    return read_table(spark, d, "orders").select("o_orderkey", w.alias("w")).select("o_orderkey", "w.overlaps", "w.confidence")


@query("pretty_windows", "SELECT o_orderkey, strftime(o_orderdate, '%b') || '-May ' || year(o_orderdate) AS label FROM orders")
def pretty_windows(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", temporal.pretty_window(F.concat(F.month("o_orderdate").cast("string"), F.lit("-5 "), F.year("o_orderdate").cast("string"))).alias("label"))


@query(
    "fact_violations",
    """WITH t AS (SELECT p_partkey AS id, unnest(CASE p_partkey % 3 WHEN 0 THEN ['zzqua'] WHEN 1 THEN [] ELSE ['zzquaing'] END) AS token FROM part)
    SELECT id, 'unknown-word' AS kind, token FROM t UNION ALL SELECT p_partkey, 'number', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT p_size FROM part)""",
)
def fact_violations(spark, d):
    parts = read_table(spark, d, "part")
    k = F.col("p_partkey") % 3
    said = F.concat_ws(" ", F.lit("Reported"), F.when(k == 0, "zzqua").when(k == 1, "reporting reports").otherwise("zzquaing"), F.col("p_partkey").cast("string"))
    vocabulary = spark.createDataFrame([("report",), ("reported",)], "word string")
    return facts.violations(parts.select(F.col("p_partkey").alias("id"), said.alias("text")), vocabulary, parts.select(F.col("p_size").cast("string").alias("number")))


@query("parseability", "SELECT c_custkey, c_nationkey % 2 = 0 AND c_acctbal >= 0 AS ok, ((c_nationkey % 2 <> 0)::INT + (c_acctbal < 0)::INT) AS problems FROM customer")
def parseability(spark, d):
    words = F.concat_ws("\n", F.col("c_name"), F.when(F.col("c_nationkey") % 2 == 0, "EDUCATION"), F.when(F.col("c_acctbal") >= 0, "Sql and  Python").otherwise("Go"))
    p = facts.parseability(words, ["Education"], F.array(F.lit("SQL"), F.lit("python")), F.array(F.col("c_name")))
    return read_table(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p.ok", F.size("p.problems").alias("problems"))


@query("form_answers", "SELECT c_custkey, 'c' || c_custkey || '@example.com' AS email, 'Customer' AS first, CASE WHEN c_nationkey = 3 THEN 'yes' END AS visa, CASE WHEN c_nationkey = 3 THEN 0 ELSE 1 END AS missing FROM customer")
def form_answers(spark, d):
    book = F.when(F.col("c_nationkey") == 3, F.create_map(F.lit("visa"), F.lit("yes"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    contact = F.create_map(F.lit("email"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@example.com")))
    get = lambda f: facts.answer(F.lit(f), book, F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")), contact)
    rows = read_table(spark, d, "customer").select("c_custkey", get(" E-mail ").alias("email"), get("first_name").alias("first"), get("visa").alias("visa"))
    return rows.withColumn("missing", F.col("visa").isNull().cast("int"))


@query("recipients", "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 10 = 1 THEN 'Jobs1@example.com' END AS address FROM customer")
def recipients(spark, d):
    email = F.concat(F.lit(" Jobs"), (F.col("c_custkey") % 10).cast("string"), F.when(F.col("c_nationkey") % 3 == 0, "@example.com").otherwise("@example"))
    return read_table(spark, d, "customer").select("c_custkey", facts.recipient(email, ["jobs1@example.com"]).alias("address"))


_QUEUE = "SELECT c_custkey AS stable_id, CASE WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'approved' END AS status, c_acctbal AS score, c_mktsegment AS company FROM customer WHERE c_nationkey < 15"


def _queue(spark, d):
    return read_table(spark, d, "customer").where("c_nationkey < 15").select(F.col("c_custkey").alias("stable_id"), F.when(F.col("c_custkey") % 2 == 0, "pending").otherwise("approved").alias("status"), F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("decided_at"), F.col("c_acctbal").alias("score"), F.col("c_mktsegment").alias("company"))


@query(
    "enqueue_reviews",
    f"""WITH q AS ({_QUEUE}), n AS (SELECT c_custkey AS stable_id, c_acctbal + 1 AS score, 'new' AS company FROM customer WHERE c_nationkey >= 10)
    SELECT coalesce(q.stable_id, n.stable_id) AS stable_id, coalesce(q.status, 'pending') AS status, coalesce(n.score, q.score) AS score, coalesce(q.company, n.company) AS company, CASE WHEN q.stable_id IS NULL THEN '2024-02-02' ELSE '2024-01-01' END AS created_at FROM q FULL JOIN n USING (stable_id)""",
)
def enqueue_reviews(spark, d):
    new = read_table(spark, d, "customer").where("c_nationkey >= 10").select(F.col("c_custkey").alias("stable_id"), (F.col("c_acctbal") + 1).alias("score"), F.lit("new").alias("company"))
    return state.enqueue_reviews(_queue(spark, d), new, F.lit("2024-02-02")).select("stable_id", "status", "score", "company", "created_at")


def _applications(spark, d):
    return read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("stable_id"), F.col("event_type").alias("status"), F.lit("").alias("outcome"), F.lit("").alias("error"), F.lit(1).alias("reminders"), F.lit("a").alias("notes"), F.lit("t0").alias("updated_at"), F.lit(None).cast("string").alias("submitted_at"), F.lit(None).cast("string").alias("last_followup_at"))


@query("update_applications", "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'submitted' WHEN event_id % 5 = 1 THEN 'failed' ELSE event_type END AS status, CASE WHEN event_id % 5 = 1 THEN 'e' ELSE '' END AS error, CASE WHEN event_id % 5 < 2 THEN 't1' ELSE 't0' END AS updated_at, CASE WHEN event_id % 5 = 0 THEN 't1' END AS submitted_at FROM events")
def update_applications(spark, d):
    k = F.col("id") % 5
    apps = _applications(spark, d)
    changes = apps.where(k < 2).select("id", F.when(k == 0, "submitted").otherwise("failed").alias("status"), F.lit("").alias("outcome"), F.when(k == 1, "e").otherwise("").alias("error"))
    return state.update_applications(apps, changes, F.lit("t1")).select("id", "status", "error", "updated_at", "submitted_at")


@query("supersede_reviews", f"SELECT stable_id, CASE WHEN status = 'pending' AND stable_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'superseded' ELSE status END AS status FROM ({_QUEUE})")
def supersede_reviews(spark, d):
    apps = _applications(spark, d).withColumn("status", F.when(F.col("status") == "purchase", "submitted").otherwise(F.col("status")))
    return state.supersede_reviews(_queue(spark, d), apps, F.lit("t1")).select("stable_id", "status")


@query(
    "record_outcomes",
    """SELECT event_id AS id, CASE WHEN hit AND user_id % 2 = 0 THEN 'no_response' ELSE '' END AS outcome, 1 + (hit AND user_id % 2 <> 0)::INT AS reminders, CASE WHEN hit THEN 'a' || chr(10) || 't1 n' ELSE 'a' END AS notes, CASE WHEN hit AND user_id % 2 <> 0 THEN 't1' END AS last_followup_at
    FROM (SELECT *, user_id % 3 = 0 AND event_id = max(event_id) OVER (PARTITION BY user_id) AS hit FROM events)""",
)
def record_outcomes(spark, d):
    apps = _applications(spark, d)
    said = apps.where("stable_id % 3 = 0").select("stable_id").distinct().select("stable_id", F.when(F.col("stable_id") % 2 == 0, " No Response ").alias("outcome"), F.lit("n").alias("note"))
    return state.record_outcomes(apps, said, F.lit("t1")).select("id", "outcome", "reminders", "notes", "last_followup_at")


@query("queue_markdown", f"SELECT stable_id, '## ' || company || ' - T (score ' || score::BIGINT || ')' || chr(10) || '- source: s' || chr(10) || '- apply: u' || chr(10) || '- gaps: x, y' AS block FROM ({_QUEUE.replace('c_acctbal', 'floor(c_acctbal)')}) WHERE status = 'pending'")
def queue_markdown(spark, d):
    q = _queue(spark, d).withColumns({"score": F.floor("score"), "title": F.lit("T"), "source": F.lit("s"), "apply_url": F.lit("u"), "matched_keywords": F.lit("no list"), "gaps": F.lit('["x", " y", ""]')})
    items = sinks.queue_items(q)
    return items.select("stable_id", sinks.queue_markdown(items).alias("block"))


@query("packets", "SELECT lower(c_mktsegment) || '-clerk-' || substr(sha1(c_custkey::VARCHAR), 1, 10) AS packet_dir, '{\"stable_id\":\"' || c_custkey || '\",\"company\":\"' || c_mktsegment || '\",\"title\":\"Clerk\"}' AS packet FROM customer")
def packets(spark, d):
    return sinks.packets(read_table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("stable_id"), F.col("c_mktsegment").alias("company"), F.lit("Clerk").alias("title")))


@query("not_archived", "SELECT user_id AS stable_id, min(event_id) AS id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 3000) GROUP BY 1")
def not_archived(spark, d):
    archive = read_table(spark, d, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("stable_id"))
    return sinks.not_archived(read_table(spark, d, "events").select(F.col("user_id").alias("stable_id"), F.col("event_id").alias("id")), archive)
