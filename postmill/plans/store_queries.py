"""Queries of stored state, reports and letters over the driver's tables; as in ``queries``, the SQL reads typed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from postmill.config import Rubric
from postmill.functions import temporal, text
from postmill.lexicon import LEXICON
from postmill.operators import facts, identity, ranking, reports, score, state
from postmill.plans.queries import AS_OF, query
from postmill.session import read_table


def _applications(spark, d):
    return read_table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("s:"), F.col("user_id").cast("string")).alias("stable_id"), F.lit("submitted").alias("status"), F.lit("").alias("outcome"), F.lit(0).alias("reminders"),
        F.lit("").alias("notes"), F.lit("t0").alias("updated_at"), F.lit(None).cast("timestamp_ntz").alias("submitted_at"), F.lit(None).cast("timestamp_ntz").alias("last_followup_at"), "ts",
    )


# references: a stable id on record, one that is not, a review's or else an application's number, with zeros or blanks around, or a word
@query(
    "resolved_ids",
    """WITH q AS (SELECT c_custkey AS id, 's:' || c_custkey AS sid FROM customer WHERE c_custkey % 2 = 0), a AS (SELECT event_id AS id, 's:' || user_id AS sid FROM events),
    r AS (SELECT o_orderkey % 5 AS k, o_custkey AS c FROM orders GROUP BY ALL)
    SELECT CASE k WHEN 0 THEN 's:' || c WHEN 1 THEN ' ' || c || ' ' WHEN 2 THEN '00' || c WHEN 3 THEN 'x:' || c ELSE 'no' || c END AS ref,
      CASE WHEN k = 0 THEN CASE WHEN c % 3 = 0 OR 's:' || c IN (SELECT sid FROM a) THEN 's:' || c ELSE '' END WHEN k < 3 THEN coalesce((SELECT sid FROM q WHERE q.id = c), (SELECT sid FROM a WHERE a.id = c), '') ELSE '' END AS stable_id FROM r""",
)
def resolved_ids(spark, d):
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    refs = read_table(spark, d, "orders").select(F.when(k == 0, F.concat(F.lit("s:"), c)).when(k == 1, F.concat(F.lit(" "), c, F.lit(" "))).when(k == 2, F.concat(F.lit("00"), c)).when(k == 3, F.concat(F.lit("x:"), c)).otherwise(F.concat(F.lit("no"), c)).alias("ref"))
    known = read_table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s:"), F.col("c_custkey").cast("string")).alias("stable_id"))
    return state.resolve_ids(refs, known.where("id % 3 = 0"), known.where("id % 2 = 0"), _applications(spark, d))


# submitted applications, the newest quiet for twelve days or more: closed with a note that says how long
@query(
    "stale_sweep",
    """SELECT event_id AS id, CASE WHEN hit THEN 'no_response' ELSE '' END AS outcome, CASE WHEN hit THEN 't1 stale resolved no_response after ' || days || ' days quiet' ELSE '' END AS notes, CASE WHEN hit THEN 't1' ELSE 't0' END AS updated_at
    FROM (SELECT event_id, days, event_id = max(event_id) OVER (PARTITION BY user_id) AND days >= 12 AS hit FROM (SELECT *, date_diff('day', ts::DATE, DATE '2024-02-10') AS days FROM events))""",
)
def stale_sweep(spark, d):
    apps = _applications(spark, d)
    quiet = reports.quiet_applications(apps.withColumn("updated_at", F.col("ts")), apps.select("stable_id").limit(0), F.lit("2024-02-10").cast("date"), 12)
    return state.sweep_stale(apps, quiet, F.lit("t1")).select("id", "outcome", "notes", "updated_at")


@query(
    "logged_attempts",
    """SELECT event_id AS id, 's:' || user_id AS stable_id, event_type AS status, '2024-01-01' AS day FROM events UNION ALL
    SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY 's:' || c_custkey, c_mktsegment), 's:' || c_custkey, c_mktsegment, '2024-03-09' FROM customer""",
)
def logged_attempts(spark, d):
    log = read_table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("s:"), F.col("user_id").cast("string")).alias("stable_id"), F.lit("web").alias("adapter"), F.col("event_type").alias("status"), F.lit("2024-01-01").alias("day"))
    new = read_table(spark, d, "customer").select(F.concat(F.lit("s:"), F.col("c_custkey").cast("string")).alias("stable_id"), F.lit("mail").alias("adapter"), F.col("c_mktsegment").alias("status"))
    return state.log_attempts(log, new, F.lit("2024-03-09 23:30:00").cast("timestamp_ntz")).select("id", "stable_id", "status", "day")


# a third of the scores is missing; every row of the report carries how many there are beyond its limit
@query(
    "postings_report",
    """SELECT id, score, count(*) OVER () AS total FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS score FROM orders WHERE o_orderstatus = 'F') WHERE score >= 1000 QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 100""",
)
def postings_report(spark, d):
    rows = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("score"), (F.col("o_orderstatus") == "F").alias("eligible"))
    shown, total = reports.listed(reports.postings_where(rows, eligible=True, min_score=1000), [F.desc_nulls_last("score"), F.asc("id")], 100)
    return shown.select("id", "score", F.lit(total).cast("long").alias("total"))


@query("eligible_stored", "SELECT c_custkey, c_acctbal AS score FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
def eligible_stored(spark, d):
    asked = read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    stored = read_table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), (F.col("c_acctbal") > 0).alias("eligible"))
    return reports.postings_where(stored, eligible=True).join(asked, "c_custkey", "left_semi").select("c_custkey", "score")


# a part's bullet names one, two or three skills, of which the posting asks for two
@query(
    "cover_bullets",
    """SELECT p_brand AS posting, p_partkey AS bullet, (p_partkey % 3 > 0)::INT + (p_partkey % 5 = 0)::INT AS relevance, (row_number() OVER (PARTITION BY p_brand ORDER BY (p_partkey % 3 > 0)::INT + (p_partkey % 5 = 0)::INT DESC, p_partkey))::INT AS rank FROM part QUALIFY rank <= 2""",
)
def cover_bullets(spark, d):
    said = F.concat_ws(" and ", F.lit("Wrote Java"), F.when(F.col("p_partkey") % 3 > 0, "sql"), F.when(F.col("p_partkey") % 5 == 0, "docker images"))
    bullets = read_table(spark, d, "part").select(F.col("p_brand").alias("posting"), F.col("p_partkey").alias("bullet"), said.alias("text"))
    wanted = F.array(F.lit("SQL"), F.lit("Docker"))
    return ranking.cover_bullets(bullets, wanted, LEXICON, ["posting"], "bullet").select("posting", "bullet", "relevance", "rank")


@query(
    "followup_letters",
    """SELECT c_custkey, position('Subject: My application for ' || role || chr(10) IN letter) = 1 AND contains(letter, 'Dear ' || team || ' team,') AS fits, len(letter) AS chars FROM (SELECT *, 'Subject: My application for ' || role || chr(10) || chr(10) || 'Dear ' || team || ' team,' || chr(10) || chr(10)
    || 'I am writing to ask how my application for ' || role || ' stands, and whether you need anything else from me.' || chr(10) || chr(10) || 'Kind regards,' || chr(10) || '[name]' AS letter FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'the position' ELSE c_mktsegment END AS role, CASE WHEN c_custkey % 4 = 0 THEN 'hiring' ELSE c_name END AS team FROM customer))""",
)
def followup_letters(spark, d):
    role, team = F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name"))
    told = read_table(spark, d, "customer").select("c_custkey", facts.followup(team, role).alias("letter"), F.coalesce(F.nullif(role, F.lit("")), F.lit("the position")).alias("role"), F.coalesce(team, F.lit("hiring")).alias("team"))
    fits = F.col("letter").startswith(F.concat(F.lit("Subject: My application for "), F.col("role"), F.lit("\n"))) & F.contains("letter", F.concat(F.lit("Dear "), F.col("team"), F.lit(" team,")))
    return told.select("c_custkey", fits.alias("fits"), F.length("letter").cast("long").alias("chars"))


# letters with their accents apart, curly quotes, dashes and no-break spaces
@query(
    "composed_text",
    """SELECT c_custkey, nfc_normalize('Cafe' || chr(769) || ' ' || c_name || ' u' || chr(776) || 'ber') AS composed, c_name || ' “' || c_mktsegment || '” – ‘x’' AS clean, (1 + (c_custkey % 2 = 0)::INT) / 2.0::DOUBLE AS survived FROM customer""",
)
def composed_text(spark, d):
    raw = F.concat(F.lit("Cafe\u0301 "), F.col("c_name"), F.lit(" u\u0308ber"))
    loose = F.concat(F.lit("\u00a0 "), F.col("c_name"), F.lit("\t\n“"), F.col("c_mktsegment"), F.lit("”\u00a0–  ‘x’ "))
    asked = F.array(F.concat(F.lit('"'), F.lower("c_mktsegment"), F.lit("\" - 'X'")), F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise("absent"))
    return read_table(spark, d, "customer").select("c_custkey", text.nfc(raw).alias("composed"), text.clean_whitespace(loose).alias("clean"), facts.survival(loose, asked).alias("survived"))


@query("truth_values", "SELECT c_custkey, c_custkey % 8 < 3 AS yes FROM customer")
def truth_values(spark, d):
    said = F.get(F.array(*map(F.lit, ("yes", " TRUE ", "1", "", "0", " False", "No", "null"))), (F.col("c_custkey") % 8).cast("int"))
    return read_table(spark, d, "customer").select("c_custkey", text.truthy(said).alias("yes"))


# registration ends a day's part before or after noon UTC, told with an offset, with Z, or malformed
@query(
    "registration_times",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'open' WHEN 2 THEN 'closed' ELSE 'unverified' END AS state FROM customer""",
)
def registration_times(spark, d):
    ends = F.get(F.array(*map(F.lit, ("2026-03-01T17:00:00+05:30", "2026-03-01T18:00:00+05:30", "2026-03-01T11:59:59Z", "2026-13-01T99:00"))), (F.col("c_custkey") % 4).cast("int"))
    raw = F.to_json(F.struct(F.lit(True).alias("regn_open"), ends.alias("end_regn_dt")))
    noon = F.lit("2026-03-01T12:00:00Z").cast("timestamp")
    return read_table(spark, d, "customer").select("c_custkey", temporal.open_state(F.col("c_name"), F.lit(""), raw, noon)["state"].alias("state"))


@query(
    "deadline_labels",
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderdate::DATE < DATE '{AS_OF}' THEN ' (expired)' WHEN o_orderdate::DATE <= DATE '{AS_OF}' + 7 THEN ' (closing soon)' ELSE ' (open)' END END AS label FROM orders""",
)
def deadline_labels(spark, d):
    value = F.when(F.col("o_orderkey") % 4 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read_table(spark, d, "orders").select("o_orderkey", temporal.deadline_label(value, F.lit(AS_OF).cast("date")).alias("label"))


@query("withheld_bands", "SELECT c_custkey, CASE WHEN c_acctbal >= 6800 AND c_nationkey < 10 THEN 'strong band withheld: role relevance 0.' || lpad((c_nationkey * 5)::VARCHAR, 2, '0') || ' is below the 0.50 minimum for the configured target domains (' ELSE '' END AS note, CASE WHEN c_acctbal >= 6800 AND c_nationkey >= 10 THEN 'strong' WHEN c_acctbal >= 4200 THEN 'shortlist' ELSE 'reject' END AS band FROM customer")
def withheld_bands(spark, d):
    total, relevant = F.col("c_acctbal") / 10000, F.col("c_nationkey") * 0.05
    note = F.coalesce(F.regexp_extract(score.band_note(total, relevant, Rubric()), r"^[^(]*\(", 0), F.lit(""))
    return read_table(spark, d, "customer").select("c_custkey", note.alias("note"), score.band(total, relevant, Rubric()).alias("band"))


@query(
    "first_per_query",
    "SELECT c_nationkey || 'x' AS job_id, min(c_custkey) AS row_ord FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1 UNION ALL SELECT '', min(c_custkey) FROM customer WHERE c_nationkey % 2 = 1",
)
def first_per_query(spark, d):
    rows = read_table(spark, d, "customer").select(F.lit("b").alias("source"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("x"))).otherwise("").alias("job_id"), F.col("c_custkey").alias("row_ord"))
    return identity.union_queries([("all", rows), ("again", rows)])[0].select("job_id", "row_ord")


_QUIET = "SELECT user_id, ts, event_id, date_diff('day', ts::DATE, DATE '2024-02-10') AS quiet FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query("followup_order", f"SELECT 's:' || user_id AS stable_id, quiet::BIGINT AS quiet_days, company, row_number() OVER (ORDER BY quiet DESC, lower(company), 's:' || user_id) AS place FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'beta' WHEN 1 THEN 'Alpha' ELSE '' END AS company FROM ({_QUIET}) WHERE quiet >= 12) QUALIFY place <= 100")
def followup_order(spark, d):
    """The hundred applications that have been quiet longest, by place."""
    user = F.expr("cast(substring(stable_id, 3) as bigint)") % 3
    apps = _applications(spark, d).withColumn("updated_at", F.col("ts")).withColumn("company", F.when(user == 0, "beta").when(user == 1, "Alpha"))
    quiet = reports.quiet_applications(apps, apps.select("stable_id").limit(0), F.lit("2024-02-10").cast("date"), 12)
    return reports.quiet_listed(quiet, 100).select("stable_id", F.col("quiet_days").cast("long").alias("quiet_days"), F.coalesce("company", F.lit("")).alias("company"), "place")
