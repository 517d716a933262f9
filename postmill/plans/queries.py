"""Queries over the driver's tables that exercise every operator, each with the same result in DuckDB SQL.

The SQL reads typed columns and states expected values; it shares no pattern with the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postmill.config import Lifecycle, Rubric, Rules
from postmill.functions import money, temporal, text
from postmill.operators import filters, identity, reports, score, select, state
from postmill.plans.registry import ORACLE_SQL, QUERIES
from postmill.session import read_table, spread
from postmill.sources.readers import manual_row

AS_OF = "1998-06-01"
#: Words of the corpus that stand for a lexicon.
LEXICON = {"The": ["the"], "And": ["and"], "Of": ["of"], "License": ["license", "mit license"], "Que": ["que"], "Der": ["der", "die"], "El": ["el", "los"]}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return read_table(spark, d, name)


def _costly(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of typed columns for costly work on each row: its file is one split, so it is dealt by rows."""
    return spread(_t(spark, d, name))


def _day(c: str):
    return F.to_date(F.col(c))


# ---- heat map, latest, anti and semi joins over events and documents ----

_APPS = "SELECT user_id AS stable_id, event_id AS id, event_type AS status, ts, (abs(value) % 1.0) AS score FROM events"


def _applications(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").alias("stable_id"), F.col("event_id").alias("id"), F.col("event_type").alias("status"), "ts", (F.abs("value") % 1.0).alias("score"), F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(
    "gap_heatmap",
    """WITH a AS (SELECT * FROM (SELECT user_id AS sid, abs(value) % 1.0 AS score, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1),
    p AS (SELECT doc_id AS sid, CASE WHEN l.quality IS NULL THEN NULL ELSE l.quality * 0.5 END AS score, source, lang FROM documents LEFT JOIN labels l USING (doc_id) WHERE doc_id NOT IN (SELECT sid FROM a)),
    r AS (SELECT score, event_type AS skill, 'application' AS source FROM a UNION ALL SELECT score, 'apply', 'application' FROM a
      UNION ALL SELECT score, lang, 'posting' FROM p UNION ALL SELECT score, source, 'posting' FROM p UNION ALL SELECT score, 'apply', 'posting' FROM p)
    SELECT skill, count(*) AS jobs, round(sum(1 - least(greatest(score, 0), 1)), 6) AS weight, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r WHERE score IS NOT NULL GROUP BY skill""",
)
def gap_heatmap(spark, d):
    apps = _applications(spark, d).withColumn("gaps", F.array("status", F.lit("apply")))
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    posts = docs.select(F.col("doc_id").alias("stable_id"), (F.col("quality") * 0.5).alias("score"), F.array("lang", "source", F.lit("apply")).alias("gaps"))
    return reports.gap_heatmap(apps, posts)


@query(
    "gap_heatmap_top",
    """SELECT rpad(c, 24, ' ') || lpad(n::VARCHAR, 6, ' ') || lpad(printf('%.2f', n * 1.0), 10, ' ') AS line FROM (SELECT source AS c, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, lower(c) LIMIT 5) UNION ALL SELECT '... ' || (count(DISTINCT source) - 5) || ' more' FROM documents""",
)
def gap_heatmap_top(spark, d):
    heat = _t(spark, d, "documents").groupBy(F.col("source").alias("skill")).agg(F.count("*").alias("jobs"), (F.count("*") * 1.0).cast("double").alias("weight"))
    return reports.heatmap_lines(heat, 5)


@query("latest_per_key", "SELECT user_id AS stable_id, max(event_id) AS id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return identity.latest(_applications(spark, d), ["stable_id"], "id").select("stable_id", "id", "status")


# events as applications: purchases are submitted, clicks under way, views left to a person, for a passing reason or not
_BLOCKING = "SELECT user_id AS stable_id, event_id AS id, CASE event_type WHEN 'purchase' THEN 'submitted' WHEN 'click' THEN 'submitting' ELSE 'manual_required' END AS status FROM events WHERE event_type IN ('purchase', 'click') OR (event_type = 'view' AND event_id % 3 <> 0)"


def _blocking(spark, d) -> DataFrame:
    kind = F.col("status")
    status = F.when(kind == "purchase", "submitted").when(kind == "click", "submitting").when(kind == "view", "manual_required").when(kind == "error", "failed").otherwise("dry_run")
    reason = F.when((kind == "view") & (F.col("id") % 3 == 0), F.when(F.col("id") % 2 == 0, "capped").otherwise("config")).otherwise("human_rejected")
    return state.blocking(_applications(spark, d).withColumns({"review_category": reason, "status": status}), Lifecycle())


@query("first_blocking", f"SELECT stable_id, max(id) AS id, arg_max(status, id) AS status FROM ({_BLOCKING}) GROUP BY 1")
def first_blocking(spark, d):
    return _blocking(spark, d)


@query("first_seen_exact_copies", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def first_seen_exact_copies(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    n = docs.groupBy("key").agg(F.count("*").alias("copies"))
    return identity.first_seen(docs, ["key"], ["doc_id"]).join(n, "key").select("doc_id", "copies")


@query("union_first_seen", "SELECT doc_id, 0 AS source_ord FROM documents UNION ALL SELECT page_id + 1000000000, 1 FROM pages")
def union_first_seen(spark, d):
    docs, pages = _t(spark, d, "documents").select("doc_id"), _t(spark, d, "pages").select((F.col("page_id") + 1_000_000_000).alias("doc_id"))
    return identity.first_seen(identity.union_sources([docs, pages, docs]), ["doc_id"], ["source_ord"]).select("doc_id", "source_ord")


@query("per_query_new_rows", """WITH f AS (SELECT lang AS query, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE lang WHEN 'fr' THEN 1 WHEN 'en' THEN 2 ELSE 3 END, doc_id) AS n FROM documents WHERE lang IN ('fr', 'en', 'de'))
    SELECT query, count(f.n) FILTER (f.n = 1) AS new_rows FROM (VALUES ('none'), ('fr'), ('en'), ('de')) q(query) LEFT JOIN f USING (query) GROUP BY 1""")
def per_query_new_rows(spark, d):
    docs = _t(spark, d, "documents").select(F.lit("board").alias("source"), F.sha2("text", 256).alias("job_id"), F.col("doc_id").alias("row_ord"), "lang")
    return identity.union_queries([(q, docs.where(F.col("lang") == q).drop("lang")) for q in ("none", "fr", "en", "de")])[1]


@query(
    "queue_with_latest_route",
    """SELECT o_orderkey, c_name, e.status FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS status FROM events WHERE event_type = 'purchase' GROUP BY 1) e ON e.user_id = o_custkey WHERE o_orderstatus = 'P'""",
)
def queue_with_latest_route(spark, d):
    queue = _t(spark, d, "orders").where("o_orderstatus = 'P'")
    last = identity.latest(_applications(spark, d).where("status = 'purchase'"), ["stable_id"], "id")
    out = queue.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(last, F.col("o_custkey") == F.col("stable_id"), "left")
    return out.select("o_orderkey", "c_name", "status")


@query("tracked_semi", "SELECT event_id AS id FROM events WHERE event_type = 'signup' OR user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def tracked_semi(spark, d):
    ok = _t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("stable_id")).distinct().withColumn("ok", F.lit(True))
    return _applications(spark, d).join(ok, "stable_id", "left").where((F.col("status") == "signup") | F.col("ok")).select("id")


@query("not_applied_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def not_applied_anti(spark, d):
    return _t(spark, d, "customer").join(_applications(spark, d), F.col("c_custkey") == F.col("stable_id"), "left_anti").select("c_custkey")


@query(
    "exclusion_list",
    """WITH p AS (SELECT page_id, lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '')) AS base, CASE WHEN contains(split_part(url, '#', 1), '?') THEN array_to_string(list_sort(list_filter(string_split(substr(split_part(url, '#', 1), strpos(split_part(url, '#', 1), '?') + 1), '&'), lambda x: x <> '')), '&') ELSE '' END AS q FROM pages),
    k AS (SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM p),
    e AS (SELECT key, min(page_id) AS ord FROM k WHERE page_id % 7 = 0 GROUP BY 1)
    SELECT page_id, min(ord) AS ord FROM (SELECT k.page_id, e.ord FROM k JOIN e USING (key) UNION ALL SELECT page_id, page_id FROM k WHERE page_id % 7 = 0) GROUP BY 1""",
)
def exclusion_list(spark, d):
    pages = _t(spark, d, "pages").select("page_id", text.norm_url(F.col("url")).alias("key"))
    # entries as a person would type them: other case, a slash and a fragment more
    typed = _t(spark, d, "pages").where("page_id % 7 = 0").select(F.col("page_id").alias("ord"), text.norm_url(F.concat(F.col("url"), F.lit("#applied"))).alias("e_key"))
    return identity.excluded_by(pages, typed, {"url": (F.col("key"), F.col("e_key")), "id": (F.col("page_id"), F.col("ord"))}, "page_id")


@query("manual_ids", "SELECT page_id, 'manual-' || substr(sha1(trim(url)), 1, 16) AS job_id FROM pages")
def manual_ids(spark, d):
    row = manual_row(F.lit("web"), F.col("url"), F.lit("t"), F.lit("c"))
    return _t(spark, d, "pages").select("page_id", row["job_id"].alias("job_id"))


# ---- keyed state ----


@query(
    "upsert_snapshot",
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, o_orderpriority AS prio FROM orders WHERE o_orderkey % 3 <> 0),
    n AS (SELECT o_orderkey AS k, 'N' AS status, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_totalprice + 1 END AS price, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'new' END AS prio FROM orders WHERE o_orderkey % 4 <> 1)
    SELECT coalesce(o.k, n.k) AS k, coalesce(o.status, n.status) AS status, coalesce(n.price, o.price) AS price, coalesce(nullif(n.prio, ''), o.prio) AS prio, o.k IS NULL AS is_new FROM o FULL JOIN n ON o.k = n.k""",
)
def upsert_snapshot(spark, d):
    o = _t(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("prio"))
    new = o.where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("k"), F.lit("N").alias("status"), F.when(F.col("o_orderkey") % 2 != 0, F.col("o_totalprice") + 1).alias("price"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("new").alias("prio"))
    return state.upsert(old, new, "k", keep=("status",), coalesce=("price",), fill_empty=("prio",))


@query("decide_reviews", "SELECT event_id AS id, CASE WHEN event_type = 'view' THEN 'manual_required' ELSE event_type END AS status, CASE WHEN event_type = 'view' AND user_id % 2 = 0 THEN 'human_approved' ELSE 'band' END AS review_category FROM events")
def decide_reviews(spark, d):
    return _decided(spark, d)[1].select("id", "status", "review_category")


@query("decided_reviews", "SELECT DISTINCT user_id AS stable_id, CASE WHEN user_id % 2 = 0 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN user_id % 2 = 0 THEN 't1' END AS decided_at FROM events")
def decided_reviews(spark, d):
    return _decided(spark, d)[0].select("stable_id", "status", "decided_at")


def _decided(spark, d):
    apps = _applications(spark, d).withColumns({"status": F.when(F.col("status") == "view", "manual_required").otherwise(F.col("status")), "review_category": F.lit("band")})
    ids = apps.select("stable_id").distinct()
    queue = ids.withColumns({"status": F.lit("pending"), "decided_at": F.lit(None).cast("string")})
    return state.decide_reviews(queue, apps, ids.where("stable_id % 2 = 0").withColumn("decision", F.lit("approved")), F.lit("t1"))


@query("blocking_keys", f"SELECT DISTINCT stable_id FROM ({_BLOCKING})")
def blocking_keys(spark, d):
    return _blocking(spark, d).select("stable_id")


@query("attempts_on_day", "SELECT count(DISTINCT user_id) AS n FROM events WHERE ts::DATE = DATE '2024-01-15' AND event_type IN ('purchase', 'signup', 'click')")
def attempts_on_day(spark, d):
    rows = _applications(spark, d).withColumn("day", _day("ts").cast("string"))
    return reports.attempts_on(rows, "2024-01-15", ("purchase", "signup", "click"))


# outcomes by the newest event's number: every fifth is final
_QUIET = """SELECT stable_id, quiet_days, company, (row_number() OVER (ORDER BY quiet_days DESC, company, stable_id))::INT AS place FROM (SELECT user_id AS stable_id, date_diff('day', max_by(ts, event_id)::DATE, DATE '2024-02-10') AS quiet_days, max_by(event_type, event_id) AS status, max_by((props->>'k')::BIGINT, event_id) AS k, max(event_id) AS id, 'c' || (user_id % 7) AS company FROM events GROUP BY user_id)
    WHERE (status = 'purchase' OR stable_id % 3 = 0) AND id % 5 <> 0 AND quiet_days >= {days} {more}"""


def _quiet(spark, d, days, most):
    none = F.lit(None).cast("timestamp_ntz")
    final = F.array(*map(F.lit, Lifecycle().final))
    outcome = F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 2 == 0, "interview")).otherwise(F.get(final, (F.col("id") / 5 % 5).cast("int")))
    apps = _applications(spark, d).select("stable_id", "id", F.when(F.col("status") == "purchase", "submitted").otherwise(F.col("status")).alias("status"), outcome.alias("outcome"), none.alias("last_followup_at"), none.alias("submitted_at"), F.col("ts").alias("updated_at"), F.col("k").alias("reminders"), F.concat(F.lit("C"), (F.col("stable_id") % 7).cast("string")).alias("company"))
    due = reports.quiet_applications(apps, apps.where("stable_id % 3 = 0").select("stable_id"), F.lit("2024-02-10").cast("date"), days, most)
    ranked = due.withColumn("place", F.row_number().over(Window.orderBy(*reports.quiet_order(), "stable_id")))  # rows of a report that a person reads
    return ranked.select("stable_id", "quiet_days", F.lower("company").alias("company"), "place")


@query("followups_due", _QUIET.format(days=10, more="AND k < 50"))
def followups_due(spark, d):
    return _quiet(spark, d, 10, 50)


@query("stale_applications", _QUIET.format(days=12, more=""))
def stale_applications(spark, d):
    return _quiet(spark, d, 12, None)


@query(
    "daily_cap",
    """SELECT o_orderkey AS stable_id, NOT (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 2 <= 5) AS capped FROM orders""",
)
def daily_cap(spark, d):
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("stable_id"), F.col("o_totalprice").alias("score"))
    return state.within_cap(rows, spark.range(1).select(F.lit(2).alias("n")), Lifecycle().daily_cap, [F.desc("score"), F.asc("stable_id")]).select("stable_id", "capped")


@query("append_with_ids", "SELECT event_id AS id, user_id FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY c_custkey), c_custkey FROM customer WHERE c_acctbal < 0")
def append_with_ids(spark, d):
    log = _t(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    return state.append_with_ids(log, _t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id")), ["user_id"])


# ---- temporal extraction: text is made from typed columns, the SQL reads the columns ----


@query(
    "deadline_status",
    f"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS deadline, CASE WHEN o_orderdate::DATE < DATE '{AS_OF}' THEN 'expired' WHEN o_orderdate::DATE <= DATE '{AS_OF}' + 7 THEN 'closing_soon' ELSE 'open' END AS status FROM orders""",
)
def deadline_status(spark, d):
    day = F.col("o_orderdate")
    n = F.col("o_orderkey") % 5
    words = (
        F.when(n == 0, F.concat(F.lit("Great role. Apply by "), F.date_format(day, "MMMM d, yyyy"), F.lit(".")))
        .when(n == 1, F.concat(F.lit("Deadline: "), F.date_format(day, "yyyy-MM-dd"), F.lit(" at noon; starts June 1, 2030")))
        .when(n == 2, F.concat(F.lit("Last date to apply - "), F.date_format(day, "d MMM yyyy")))
        .when(n == 3, F.concat(F.lit("Applications open January 1, 1990 to "), F.date_format(day, "MMMM d yyyy")))
        .otherwise(F.concat(F.lit("Applications close on "), F.date_format(day, "MMM d, yyyy"), F.lit("!")))
    )
    rows = _costly(spark, d, "orders").select("o_orderkey", temporal.deadline(words).alias("deadline"))
    return rows.withColumn("status", temporal.deadline_status(F.col("deadline"), F.lit(AS_OF).cast("date")))


@query(
    "staleness",
    f"SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') AS days, date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') > 30 AS stale FROM orders",
)
def staleness(spark, d):
    published = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string"))
    rows = _t(spark, d, "orders").select("o_orderkey", temporal.staleness_days(published, F.lit(AS_OF).cast("date")).alias("days"))
    return rows.withColumn("stale", F.col("days") > 30)


@query(
    "month_window",
    """WITH m AS (SELECT l_orderkey, l_linenumber, month(l_shipdate) AS a, (month(l_shipdate) + l_linenumber - 1) % 12 + 1 AS b, year(l_shipdate) AS y FROM lineitem),
    r AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 OR a <= b THEN a ELSE b END AS lo, CASE WHEN l_orderkey % 2 = 0 OR a <= b THEN b ELSE a END AS hi FROM m)
    SELECT l_orderkey, l_linenumber, CASE WHEN lo <= hi THEN lo <= 6 ELSE true END AS overlaps, 1.0 AS confidence,
      (CASE lo WHEN 5 THEN '5' ELSE strftime(make_date(2000, lo, 1), '%b') END) || '-' || (CASE hi WHEN 5 THEN '5' ELSE strftime(make_date(2000, hi, 1), '%b') END) || ' ' || y AS label FROM r""",
)
def month_window(spark, d):
    rows = _costly(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.month("l_shipdate").alias("a"), ((F.month("l_shipdate") + F.col("l_linenumber") - 1) % 12 + 1).alias("b"), F.year("l_shipdate").cast("string").alias("y"))
    name = lambda c: F.date_format(F.make_date(F.lit(2000), F.col(c), F.lit(1)), "MMMM")
    by_name = F.concat(F.lit("Join us "), name("a"), F.lit(" to "), name("b"), F.lit(" "), F.col("y"), F.lit(" for an internship"))
    by_number = F.concat(F.lit("Term "), F.lpad(F.col("a").cast("string"), 2, "0"), F.lit("/"), F.col("y"), F.lit(" - "), F.col("b").cast("string"), F.lit("/"), F.col("y"))
    w = temporal.window(F.when(F.col("l_orderkey") % 2 == 0, by_name).otherwise(by_number))
    return rows.select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.overlaps", "w.confidence", "w.label")


@query(
    "open_state",
    f"""SELECT o_orderkey, CASE k WHEN 0 THEN 'closed' WHEN 1 THEN CASE WHEN past THEN 'closed' ELSE 'open' END WHEN 2 THEN CASE WHEN past_day THEN 'closed' ELSE 'unverified' END WHEN 4 THEN 'closed' WHEN 5 THEN CASE WHEN begun THEN 'unverified' ELSE 'closed' END ELSE 'unverified' END AS state,
      CASE k WHEN 0 THEN 'the posting states the application is closed' WHEN 1 THEN CASE WHEN past THEN 'registration closed ' || iso ELSE '' END WHEN 2 THEN CASE WHEN past_day THEN 'registration ended ' || substr(iso, 1, 10) ELSE '' END
      WHEN 4 THEN 'registration is not open (regn_open is false)' WHEN 5 THEN CASE WHEN begun THEN '' ELSE 'registration opens later (' || iso || ')' END ELSE '' END AS reason
      FROM (SELECT o_orderkey, o_orderkey % 6 AS k, o_orderdate < TIMESTAMP '{AS_OF}' AS past, o_orderdate <= TIMESTAMP '{AS_OF}' AS begun, o_orderdate::DATE < DATE '{AS_OF}' AS past_day, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso FROM orders)""",
)
def open_state(spark, d):
    # 2 and 3 hold an end date alone, which counts on the typed board only; 4 holds a flag that is there but null
    day, n = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.col("o_orderkey") % 6
    raw = (
        F.when(n == 1, F.to_json(F.struct(F.lit(1).alias("regn_open"), F.struct(day.alias("end_regn_dt")).alias("regnRequirements"))))
        .when(n.isin(2, 3), F.to_json(F.struct(day.alias("end_date"))))
        .when(n == 4, '{"regn_open":null}')
        .when(n == 5, F.to_json(F.struct(day.alias("start_regn_dt"))))
        .otherwise("{}")
    )
    words = F.when(n == 0, "Applications are now closed.").otherwise("Join the team.")
    o = temporal.open_state(words, F.lit(""), raw, F.lit(AS_OF).cast("timestamp"), F.when(n == 2, "unstop").otherwise("lever"))
    return _costly(spark, d, "orders").select("o_orderkey", o.alias("o")).select("o_orderkey", "o.state", "o.reason")


# ---- money ----


@query(
    "stipends",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN 'unpaid' WHEN 4 THEN 'unstated' ELSE CASE WHEN low >= 1200 THEN 'confirmed_ge_floor' ELSE 'confirmed_below_floor' END END AS state,
      CASE WHEN p_partkey % 6 NOT IN (3, 4) THEN low END AS amount, CASE WHEN p_partkey % 6 NOT IN (3, 4) THEN high END AS amount_high
    FROM (SELECT *, CASE p_partkey % 6 WHEN 1 THEN (n * 12 + 5) // 12 WHEN 5 THEN n * 100000 // 12 ELSE n END::INT AS low, CASE p_partkey % 6 WHEN 1 THEN (n * 12 + 5) // 12 WHEN 2 THEN n + 500 WHEN 5 THEN n * 100000 // 12 ELSE n END::INT AS high
      FROM (SELECT p_partkey, CASE WHEN p_partkey % 6 = 5 THEN p_size ELSE floor(p_retailprice)::BIGINT END AS n FROM part))""",
)
def stipends(spark, d):
    kind = F.col("p_partkey") % 6
    n = F.when(kind == 5, F.col("p_size").cast("long")).otherwise(F.floor("p_retailprice"))
    f = lambda x: F.format_number(x, 0)
    words = (
        F.when(kind == 0, F.concat(F.lit("Stipend: INR "), f(n), F.lit(" per month")))
        .when(kind == 1, F.concat(F.lit("The stipend is ₹"), f(n * 12 + 5), F.lit(" per annum.")))
        .when(kind == 2, F.concat(F.lit("Stipend range- Rs "), f(n), F.lit(" - Rs "), f(n + 500)))
        .when(kind == 3, F.lit("This is an unpaid internship."))
        .when(kind == 4, F.concat(F.lit("Stipend: $"), f(n), F.lit(" per month")))
        .otherwise(F.concat(F.lit("Stipend: ₹"), n.cast("string"), F.lit(" LPA")))
    )
    s = money.stipend(words, 1200)
    return _costly(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.state", "s.amount", "s.amount_high")


@query("stipend_labels", "SELECT p_partkey, '₹' || (CASE WHEN p_retailprice >= 1000 THEN printf('%d,%03d', floor(p_retailprice)::BIGINT // 1000, floor(p_retailprice)::BIGINT % 1000) ELSE floor(p_retailprice)::BIGINT::VARCHAR END) || '/mo ' || CASE WHEN floor(p_retailprice) >= 1200 THEN 'confirmed' ELSE 'below floor' END AS label FROM part")
def stipend_labels(spark, d):
    words = F.concat(F.lit("Stipend: Rs. "), F.floor("p_retailprice").cast("string"), F.lit("/month"))
    return _costly(spark, d, "part").select("p_partkey", money.stipend_label(money.stipend(words, 1200)).alias("label"))


@query("salary_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Stipend: Unpaid' ELSE 'Stipend: ₹' || p_size || CASE WHEN p_partkey % 3 = 2 THEN ' - ₹' || (p_size + 1) ELSE '' END || ' per ' || CASE WHEN p_partkey % 2 = 0 THEN 'month' ELSE 'annum' END END AS said FROM part")
def salary_text(spark, d):
    k = F.col("p_partkey")
    detail = F.struct(F.when(k % 3 == 0, "unpaid").otherwise("paid").alias("paid_unpaid"), F.lit("INR").alias("currency"), F.col("p_size").cast("string").alias("min_salary"), F.when(k % 3 == 2, (F.col("p_size") + 1).cast("string")).alias("max_salary"), F.when(k % 2 == 0, F.lit(None)).otherwise("Per Year").alias("pay_in"), F.lit("1").alias("show_salary"), F.lit(None).cast("string").alias("not_disclosed"))
    return _t(spark, d, "part").select("p_partkey", money.salary_text(detail).alias("said"))


# ---- text ----


def _bounded(word: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"


@query("first_listed_term", f"SELECT doc_id, CASE WHEN {_bounded('license')} THEN 'license' WHEN {_bounded('the')} THEN 'the' WHEN {_bounded('que')} THEN 'que' WHEN {_bounded('der')} THEN 'der' END AS term FROM documents")
def first_listed_term(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.find_term(F.col("text"), ["license", "the", "que", "der"]).alias("term"))


def _at(phrases: list[str]) -> str:
    # a boundary class without lookaround: the phrase's place is one behind the group before it, if that is not empty
    t = "regexp_replace(translate(lower(text), '’–—', '''--'), '[\\s\\x{A0}\\x{2028}\\x{2029}\\x{85}]+', ' ', 'g')"
    return "least(" + ", ".join(f"nullif(strpos(' ' || regexp_replace({t}, '[^a-z0-9+]', ' ', 'g') || ' ', ' {p} '), 0)" for p in phrases) + (", NULL)" if len(phrases) == 1 else ")")


@query("terms_in_text", "SELECT doc_id, list_transform(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_at([p for p in dict.fromkeys([k.lower(), *v])])} IS NOT NULL THEN {{'at': {_at([p for p in dict.fromkeys([k.lower(), *v])])}, 'size': {-max(len(p) for p in [k, *v])}, 'rank': {i}, 'term': '{k}'}} END" for i, (k, v) in enumerate(LEXICON.items())) + "], lambda x: x IS NOT NULL)), lambda x: x.term) AS terms FROM documents")
def terms_in_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.extract_terms(F.col("text"), LEXICON).alias("terms"))


@query(
    "term_coverage",
    f"SELECT doc_id, ({_bounded('the')}::INT + {_bounded('license')}::INT) AS matched, ({_bounded('and')}::INT + {_bounded('of')}::INT) AS missing, round(coalesce(({_bounded('the')}::INT + {_bounded('license')}::INT) / nullif({_bounded('the')}::INT + {_bounded('license')}::INT + {_bounded('and')}::INT + {_bounded('of')}::INT, 0), 0), 4) AS ratio FROM documents",
)
def term_coverage(spark, d):
    terms = text.extract_terms(F.regexp_replace("text", r"\+", " "), {k: LEXICON[k][:1] for k in ("The", "And", "Of", "License")})
    s = text.term_split(terms, F.array(F.lit("The"), F.lit("License")))
    return _t(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s.matched").alias("matched"), F.size("s.missing").alias("missing"), F.round("s.ratio", 4).alias("ratio"))


@query("normalised_urls", """SELECT page_id, base || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM (SELECT page_id, lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '')) AS base,
    CASE WHEN contains(split_part(url, '#', 1), '?') THEN array_to_string(list_sort(list_filter(string_split(substr(split_part(url, '#', 1), strpos(split_part(url, '#', 1), '?') + 1), '&'), lambda x: x <> '')), '&') ELSE '' END AS q FROM pages)""")
def normalised_urls(spark, d):
    return _t(spark, d, "pages").select("page_id", text.norm_url(F.col("url")).alias("url"))


@query("slugs", "SELECT c_custkey, coalesce(nullif(trim(regexp_replace(lower(c_name || '  ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') AS slug FROM customer")
def slugs(spark, d):
    return _t(spark, d, "customer").select("c_custkey", text.slug(F.concat_ws("  ", "c_name", "c_mktsegment")).alias("slug"))


# words as the rules cut them, without LaTeX
_WORDS = r"list_filter(list_transform(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(text, '\$[^$]*\$', ' ', 'g'), '\\[A-Za-z@]+\*?', ' ', 'g'), '[\\{}$&~]', ' ', 'g')), '[a-z][a-z0-9+#.\-]*'), lambda x: trim(x, '.-')), lambda x: len(x) > 1)"


@query("unknown_words", f"""WITH b AS (SELECT DISTINCT unnest({_WORDS}) AS w FROM benchmark), t AS (SELECT doc_id, unnest(list_distinct({_WORDS})) AS w FROM documents)
    SELECT doc_id, count(*) AS unknown FROM t ANTI JOIN b USING (w) GROUP BY 1""")
def unknown_words(spark, d):
    known = _t(spark, d, "benchmark").select(F.explode(text.content_tokens(F.col("text"))).alias("w")).distinct()
    each = _t(spark, d, "documents").select("doc_id", F.explode(text.content_tokens(F.col("text"))).alias("w"))
    return each.join(known, "w", "left_anti").groupBy("doc_id").agg(F.count("*").alias("unknown"))


@query("numbers_in_text", "SELECT o_orderkey, list_sort(list_distinct([floor(o_totalprice)::BIGINT || '.00', o_orderkey::VARCHAR, '7%', '3/4', '3', '4'])) AS numbers FROM orders")
def numbers_in_text(spark, d):
    words = F.concat(F.lit("Paid "), F.format_number(F.floor("o_totalprice"), 0), F.lit(".00 for order "), F.col("o_orderkey").cast("string"), F.lit(r" and 7 %, \textbf{3 / 4} of $5x$"))
    return _t(spark, d, "orders").select("o_orderkey", F.array_sort(text.numbers_in(words)).alias("numbers"))


@query("json_lists", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN [event_type, 'x'] ELSE [] END AS items FROM events")
def json_lists(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('[" '), F.col("event_type"), F.lit('", "", "x"]'))).when(F.col("event_id") % 3 == 1, "not json")
    return _t(spark, d, "events").select("event_id", text.json_list(raw).alias("items"))


@query("page_text_lines")
def page_text_lines(spark, d):
    """Visible text of every page; checked against the parser in tests."""
    return _t(spark, d, "pages").select("page_id", text.html_to_text("html").alias("text"))


@query("html_lines", "SELECT c_custkey, c_name || ' & <co>' || chr(10) || 'in ' || c_mktsegment || chr(10) || 'no. ' || c_nationkey || chr(10) || 'end' AS text FROM customer")
def html_lines(spark, d):
    page = F.concat(F.lit("<html><style>p {}</style><h1>"), F.col("c_name"), F.lit(" &amp; &lt;co&gt;</h1><ul><li> in&nbsp; <b>"), F.col("c_mktsegment"), F.lit("</b></li>\n<li>no. "), F.col("c_nationkey").cast("string"), F.lit("</li></ul><script>var x = '<p>y</p>';</script>\n\n<br>end"))
    return _costly(spark, d, "customer").select("c_custkey", text.html_to_text(page).alias("text"))


@query("role_relevance", f"""SELECT doc_id, round(least(1, CASE WHEN doc_id % 3 = 0 THEN 0.5 ELSE 0 END + least(0.4, 0.1 * ({_bounded('the')}::INT + {_bounded('license')}::INT))), 4) AS relevance FROM documents""")
def role_relevance(spark, d):
    title = F.when(F.col("doc_id") % 3 == 0, "Some License").otherwise("licensed")
    scores = score.role_relevance(title, F.col("text"), {"a": ["the", "license"], "b": ["nothing of it"]})
    return _t(spark, d, "documents").select("doc_id", score.best_domain(scores).alias("relevance"))


# ---- filters, score, selection ----

#: Places with the rule's verdict: score, eligible, needs a person (expected values of the ladder).
PLACES = [
    ("Bengaluru, India", None, "", 1.0, True, True), ("Remote - Worldwide", True, "", 0.95, True, True), ("San Francisco, United States", None, "", 0.0, False, True),
    ("Remote, US", None, "", 0.1, False, True), ("", None, "", 0.0, False, True), ("", True, "", 0.85, True, True), ("Remote", None, "Work with our India team", 0.9, True, True),
    ("Atlantis", True, "", 0.5, True, False), ("Atlantis", None, "", 0.2, False, True), ("Remote", None, "You must be located in Ohio", 0.85, True, False), ("security clearance site", None, "", 0.0, False, True),
    ("Remote", True, "We are a team in Germany", 0.85, True, False), ("", None, "American citizens preferred", 0.5, True, False), ("Remote, Work From Home", None, "", 0.85, True, True), ("Fully Remote", None, "", 0.95, True, True), ("Pune", None, "Requires US citizenship", 0.0, False, True),
]


@query("location_ladder", "SELECT o_orderkey, " + "CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN {p[3]}" for i, p in enumerate(PLACES)) + " END::DOUBLE AS score, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN {p[4]}" for i, p in enumerate(PLACES)) + " END AS eligible, CASE o_orderkey % 16 " + " ".join(f"WHEN {i} THEN {p[5]}" for i, p in enumerate(PLACES)) + " END AS auto_ok FROM orders")
def location_ladder(spark, d):
    n = F.col("o_orderkey") % 16
    pick = lambda j, kind: F.element_at(F.array(*(F.lit(p[j]).cast(kind) for p in PLACES)), (n + 1).cast("int"))
    rows = _costly(spark, d, "orders").select("o_orderkey", pick(0, "string").alias("location"), pick(1, "boolean").alias("is_remote"), pick(2, "string").alias("description"))
    return filters.with_place(rows, Rules()).select("o_orderkey", "place.score", "place.eligible", "place.auto_ok")


def _postings(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return _costly(spark, d, "orders").select(
        k.alias("id"),
        F.when(k % 2 == 0, "Data Science Intern").when(k % 3 == 0, "Senior Engineer").otherwise("Analyst").alias("title"),
        F.lit("Acme").alias("company"),
        F.when(k % 5 == 0, "San Francisco, United States").otherwise("Pune, India").alias("location"),
        F.when(k % 7 == 0, "FullTime").otherwise("Internship").alias("employment_type"),
        F.when(k % 4 == 0, "Stipend: INR 45,000 per month. January 2026 - June 2026").when(k % 4 == 1, "Stipend: INR 5,000 per month").when(k % 4 == 2, "September to December 2026").otherwise("").alias("description"),
        F.lit(None).cast("boolean").alias("is_remote"),
        F.struct(F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").otherwise("unverified").alias("state"), F.when(F.col("o_orderstatus") == "F", "the posting states the application is closed").otherwise("").alias("reason")).alias("open"),
        F.lit("").alias("apply_url"),
        F.col("o_orderpriority").alias("source"),
        F.col("o_totalprice").alias("price"),
    )


_REASONS = """SELECT o_orderkey AS id, o_orderpriority AS source, list_filter([
    CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 <> 0 THEN 'internship: not identifiable as an internship' END, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 <> 0 THEN 'fulltime: full-time signal ''fulltime''' END,
    CASE WHEN o_orderkey % 2 <> 0 AND o_orderkey % 3 = 0 THEN 'seniority: seniority keyword ''senior'' in title' END, CASE WHEN o_orderkey % 5 = 0 THEN 'india_eligible: onsite location abroad (''united states'')' END,
    CASE WHEN o_orderstatus = 'F' THEN 'application_open: the posting states the application is closed' END, CASE WHEN o_orderkey % 4 = 1 THEN 'stipend: ₹5,000/mo below floor' END,
    CASE WHEN o_orderkey % 4 = 2 THEN 'window: explicit range Sep-Dec 2026 does not overlap Jan-Jun' END], lambda x: x IS NOT NULL) AS reasons,
    list_filter([CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'ambiguous: internship title with full-time signal ''fulltime''; review before applying' END, CASE WHEN o_orderkey % 4 > 1 THEN 'stipend not stated; verify before applying' END], lambda x: x IS NOT NULL) AS review FROM orders"""


@query("filter_reasons", f"SELECT id, reasons, len(reasons) = 0 AS eligible FROM ({_REASONS})")
def filter_reasons(spark, d):
    out = filters.filter_postings(_postings(spark, d))
    return out.select("id", F.col("reject_reasons").alias("reasons"), "eligible")


@query("review_reasons", f"SELECT id, review FROM ({_REASONS})")
def review_reasons(spark, d):
    return filters.filter_postings(_postings(spark, d)).select("id", F.col("review_reasons").alias("review"))


@query("rejection_breakdown", f"SELECT split_part(r, ': ', 1) AS reason, count(*) AS rows FROM (SELECT unnest(reasons) AS r FROM ({_REASONS})) GROUP BY 1")
def rejection_breakdown(spark, d):
    return reports.rejections(filters.filter_postings(_postings(spark, d)))


@query("rejection_matrix", f"SELECT source, reason, CASE grouping_id(source, reason) WHEN 0 THEN 'cell' WHEN 1 THEN 'group' WHEN 2 THEN 'reason' ELSE 'all' END AS level, count(*) AS rows FROM (SELECT nullif(source, '5-LOW') AS source, split_part(unnest(reasons), ': ', 1) AS reason FROM ({_REASONS})) GROUP BY GROUPING SETS ((source, reason), (source), (reason), ())")
def rejection_matrix(spark, d):
    rows = _postings(spark, d).withColumn("source", F.nullif("source", F.lit("5-LOW")))
    return reports.rejection_matrix(filters.filter_postings(rows), "source")


@query("source_funnel", f"SELECT source, count(*) AS discovered, count(*) FILTER (len(reasons) = 0) AS eligible, count(*) FILTER (len(reasons) = 1) AS one_reason FROM ({_REASONS}) GROUP BY 1")
def source_funnel(spark, d):
    return reports.funnel(filters.filter_postings(_postings(spark, d)), ["source"], eligible=F.col("eligible"), one_reason=F.size("reject_reasons") == 1)


# postings with a role part: what the score sees of them is known from the key
_MATCH = """SELECT id, k, t, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.3 END AS win, greatest(CASE WHEN t = 0 THEN 0.5 ELSE 0.0 END, CASE WHEN k = 0 THEN 0.3 ELSE 0.0 END) AS rel,
    CASE WHEN t = 0 THEN ['Machine Learning', 'Deep Learning'] ELSE [] END || CASE k WHEN 0 THEN ['Docker', 'SQL', 'Flask'] WHEN 1 THEN [] ELSE ['AWS', 'Azure', 'Linux', 'React', 'GraphQL', 'Kubernetes', 'Java', 'Agile'] END AS terms
    FROM (SELECT o_orderkey AS id, o_orderkey % 3 AS k, o_orderkey // 3 % 2 AS t FROM orders)"""
_MATCHED = f"""SELECT *, 0.45 * CASE WHEN len(terms) = 0 THEN 0.5 ELSE len(matched) / len(terms) END + 0.25 * rel + 0.15 + 0.10 * win + 0.05 AS score
    FROM (SELECT *, list_filter(terms, lambda x: x IN ('Docker', 'SQL', 'Machine Learning')) AS matched, list_filter(terms, lambda x: x NOT IN ('Docker', 'SQL', 'Machine Learning')) AS missing FROM ({_MATCH}))"""


def _matches(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    k, t = key % 3, F.floor(key / 3) % 2
    about = F.lit("We do machine learning in Python.\nResponsibilities:\n")
    body = F.when(k == 0, "Docker, SQL and Flask. January to June 2026").when(k == 1, "Be there. July to September 2026").otherwise("AWS, Azure, Linux, React, GraphQL, Kubernetes, Java, Agile. Unpaid")
    rows = _costly(spark, d, "orders").select(
        key.alias("id"), key.cast("string").alias("stable_id"), F.when(t == 0, "ML Intern, Deep Learning").otherwise("Intern").alias("title"), F.lit("Acme").alias("company"), F.lit("Pune").alias("location"), F.lit("Internship").alias("employment_type"),
        F.concat(about, body).alias("description"), F.when(k == 1, True).alias("is_remote"), F.struct(F.lit("unverified").alias("state"), F.lit("").alias("reason")).alias("open"),
    )
    return score.match_postings(filters.filter_postings(rows), F.array(F.lit("Docker"), F.lit("SQL"), F.lit("Machine Learning")))


@query(
    "match_postings",
    f"""SELECT id, round(score, 6) AS score, CASE WHEN round(score, 9) >= 0.68 AND rel >= 0.5 THEN 'strong' WHEN round(score, 9) >= 0.42 THEN 'shortlist' ELSE 'reject' END AS band, matched, missing,
    'window fit ' || CASE k WHEN 0 THEN '1.00: explicit range Jan-Jun 2026' WHEN 1 THEN '0.00: explicit range Jul-Sep 2026' ELSE '0.30: no timing signal found' END AS reason FROM ({_MATCHED})""",
)
def match_postings(spark, d):
    return _matches(spark, d).select("id", F.round("score", 6).alias("score"), "band", "coverage.matched", "coverage.missing", F.get("match_reasons", 3).alias("reason"))


@query(
    "red_flags",
    f"""SELECT id, list_filter([CASE WHEN k <> 1 THEN 'remote eligibility is not stated; confirm the work location' END, CASE WHEN len(missing) >= 8 THEN 'JD asks for ' || len(missing) || ' skills absent from the profile; these are reported as gaps and were not inserted' END,
    CASE WHEN len(terms) > 0 AND len(matched) / len(terms) < 0.25 THEN 'low keyword coverage; the resume may not speak to this JD' END, CASE WHEN k = 2 THEN 'posting may be unpaid; confirm' END], lambda x: x IS NOT NULL) AS flags FROM ({_MATCHED})""",
)
def red_flags(spark, d):
    out = _matches(spark, d)
    return out.select("id", filters.red_flags(out).alias("flags"))


@query("save_matches", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 1 THEN -1 ELSE 0.15 END AS score, CASE WHEN o_orderkey % 3 = 1 THEN 'old' ELSE 'new' END AS band, CASE WHEN o_orderkey % 3 <> 1 THEN 't1' END AS scored_at, 'kept' AS title FROM orders")
def save_matches(spark, d):
    key = F.col("o_orderkey")
    stored = _t(spark, d, "orders").select(key.alias("id"), key.cast("string").alias("stable_id"), F.lit("kept").alias("title"), F.lit(-1.0).alias("score"), F.lit("old").alias("band"), F.lit(None).cast("string").alias("scored_at"))
    matches = stored.where(F.col("id") % 3 != 1).select("stable_id", F.lit(0.15).alias("score"), F.lit("new").alias("band"))
    return state.save_matches(stored, matches, F.lit("t1")).select("id", "score", "band", "scored_at", "title")


_SCORED = "SELECT l_orderkey, l_linenumber, (0.45 * (l_quantity / 50) + 0.25 * (l_discount * 10) + 0.15 * (1 - l_tax * 10) + 0.10 * (l_linenumber / 7) + 0.05 * 1.0) AS score, l_discount * 10 AS rel FROM lineitem"


def _scored(spark, d) -> DataFrame:
    parts = {"skill_coverage": F.col("l_quantity") / 50, "role_relevance": F.col("l_discount") * 10, "location_fit": 1 - F.col("l_tax") * 10, "window_fit": F.col("l_linenumber") / 7, "seniority_fit": F.lit(1.0)}
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.rubric_score(parts, Rubric()).alias("score"), (F.col("l_discount") * 10).alias("rel"))


@query("rubric_bands", f"SELECT l_orderkey, l_linenumber, round(score, 4) AS score, CASE WHEN round(score, 6) >= 0.68 AND round(rel, 6) >= 0.5 THEN 'strong' WHEN round(score, 6) >= 0.42 THEN 'shortlist' ELSE 'reject' END AS band FROM ({_SCORED})")
def rubric_bands(spark, d):
    return _scored(spark, d).select("l_orderkey", "l_linenumber", F.round("score", 4).alias("score"), score.band(F.round("score", 6), F.round("rel", 6), Rubric()).alias("band"))


@query("shortlist_top", f"SELECT l_orderkey, l_linenumber, round(score, 4) AS score FROM ({_SCORED}) WHERE round(score, 6) >= 0.42 ORDER BY round(score, 6) DESC, l_orderkey * 10 + l_linenumber LIMIT 50")
def shortlist_top(spark, d):
    rows = _scored(spark, d).withColumn("score", F.round("score", 6)).withColumn("ord", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return score.shortlist(rows, 0.42, 50).select("l_orderkey", "l_linenumber", F.round("score", 4).alias("score"))


@query("present_buckets", """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'closed' WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'already applied' WHEN c_acctbal < 0 THEN 'stipend' WHEN c_mktsegment = 'MACHINERY' THEN 'non-technical title' END AS why, c_acctbal / 20000 AS rel FROM customer)
    SELECT id, coalesce(why, CASE WHEN rel < 0.3 THEN 'low relevance' ELSE '' END) AS reason, CASE WHEN why IS NOT NULL THEN 'excluded' WHEN rel >= 0.4 THEN 'included' WHEN rel >= 0.3 THEN 'held' ELSE 'excluded' END AS bucket FROM r""")
def present_buckets(spark, d):
    applied = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).distinct().withColumn("excluded", F.lit(True))
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, "closed").otherwise("open").alias("open_state"), F.when(F.col("c_acctbal") < 0, "unpaid").otherwise("unstated").alias("stipend_state"), (F.col("c_mktsegment") == "MACHINERY").alias("title_hit"), (F.col("c_acctbal") / 20000).alias("relevance"), F.col("c_acctbal").alias("score"))
    rows = rows.join(applied, "id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    return select.buckets(rows, 0.4, 0.3).select("id", "reason", "bucket")


@query(
    "routes",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'linkedin' WHEN c_mktsegment = 'MACHINERY' THEN 'linkout' WHEN c_acctbal > 5000 AND c_custkey % 3 = 0 THEN 'auto' ELSE 'review' END AS route,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '' WHEN c_acctbal > 5000 THEN CASE c_custkey % 3 WHEN 0 THEN 'once that condition clears' WHEN 1 THEN 'routed it to review: window' ELSE 'routed it to review: it said so' END ELSE 'Band ''shortlist'' is review-only' END AS says FROM customer""",
)
def routes(spark, d):
    k = F.col("c_custkey") % 3
    source = F.when(F.col("c_mktsegment") == "BUILDING", "linkedin").otherwise(F.col("c_mktsegment"))
    band = F.when(F.col("c_acctbal") > 5000, "strong").otherwise("shortlist")
    r = select.route(source, band, F.when(k == 0, "capped").otherwise("window"), F.when(k == 2, "it said so").otherwise(""), Lifecycle(manual_sources=("MACHINERY",)))
    rows = _t(spark, d, "customer").select("c_custkey", r.alias("r"))
    return rows.select("c_custkey", "r.route", F.regexp_extract("r.detail", "(Band '[a-z]*' is review-only|routed it to review: [a-z ]+|once that condition clears)", 1).alias("says"))


# the window overlaps for k % 3 = 0; every eleventh key is submitted already
_GUARDS = """SELECT id, price, CASE WHEN prio = '1-URGENT' THEN 'linkedin' WHEN prio = '2-HIGH' THEN 'manual_source' WHEN id % 9 = 0 THEN 'generation' WHEN id % 3 <> 0 THEN 'window' WHEN price < 100000 THEN 'match' WHEN id % 5 = 0 THEN 'filter' WHEN id % 11 = 0 THEN 'duplicate' WHEN id % 2 = 0 THEN 'no_channel' ELSE 'submit' END AS guard
    FROM (SELECT o_orderkey AS id, o_orderpriority AS prio, o_totalprice AS price FROM orders)"""


@query("guard_chain", f"SELECT id AS o_orderkey, CASE WHEN guard = 'submit' AND row_number() OVER (PARTITION BY guard ORDER BY price DESC, id) > 3 THEN 'capped' ELSE guard END AS guard FROM ({_GUARDS})")
def guard_chain(spark, d):
    key = F.col("o_orderkey")
    w = temporal.window(F.when(key % 3 == 0, "January to June 2026").when(key % 3 == 1, "July to August 2026").otherwise("some day"))
    source = F.when(F.col("o_orderpriority") == "1-URGENT", "linkedin").when(F.col("o_orderpriority") == "2-HIGH", "naukri").otherwise("lever")
    plans = _t(spark, d, "orders").select(
        key.alias("stable_id"), source.alias("source"), (key % 9 == 0).alias("requires_review"), w.alias("window"), F.when(F.col("o_totalprice") < 100000, "shortlist").otherwise("strong").alias("band"),
        F.when(key % 5 == 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>")).alias("review_reasons"), (key % 2 != 0).alias("can_submit"), F.col("o_totalprice").alias("score"),
    )
    known = plans.where("stable_id % 11 = 0").select("stable_id")
    out = select.guard_chain(plans, known, spark.range(1).select(F.lit(2).alias("n")), Lifecycle(manual_sources=("naukri",)), [F.desc("score"), F.asc("stable_id")])
    return out.select(F.col("stable_id").alias("o_orderkey"), "guard")


@query("robots", "SELECT page_id AS url_id, CASE page_id % 5 WHEN 0 THEN NOT (page_id % 3 = 0 AND page_id % 4 <> 0) WHEN 1 THEN true ELSE false END AS allowed FROM pages")
def robots(spark, d):
    k = F.col("page_id")
    host = F.element_at(F.array(*map(F.lit, ("rules", "missing", "failed", "silent", "no policy"))), (k % 5 + 1).cast("int"))
    urls = _t(spark, d, "pages").select(k.alias("url_id"), host.alias("host"), F.concat(F.when(k % 3 == 0, "/priv%61te/").otherwise("/jobs/"), F.when(k % 4 == 0, "open/").otherwise("x/"), k.cast("string"), F.lit(".html")).alias("path"))
    body = "# policy\nUser-agent: *\nDisallow: /private/\n\nAllow: /private/open/\nUser-agent: bot\nDisallow: /*.pdf$\nAllow: /\n"
    policies = spark.createDataFrame([("rules", 200, body), ("missing", 404, None), ("failed", 503, None), ("no policy", 200, "<html>welcome</html>")], "host string, status int, body string")
    return select.robots_allowed(urls, select.robots_rules(policies), "bot")


@query("ranked_sections", "SELECT rank, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey < 12, c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 40")
def ranked_sections(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") < 12).alias("section"), "c_acctbal")
    return select.sectioned_rank(rows, "section", "c_acctbal", "c_custkey", 40).select("rank", "c_custkey")


@query("weakest_bullets", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS n FROM lineitem) WHERE n > 1 ORDER BY l_quantity, l_orderkey, l_linenumber LIMIT 30")
def weakest_bullets(spark, d):
    return select.weakest(_t(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_linenumber", 30).select("l_orderkey", "l_linenumber")


@query("queue_by_score", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 4000 AND c_mktsegment = 'BUILDING'")
def queue_by_score(spark, d):
    return _t(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal >= 4000").select("c_custkey", "c_acctbal").orderBy(F.desc_nulls_last("c_acctbal"))


@query("opening_turns", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1")
def opening_turns(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, d, "conversations").withColumn("n", F.row_number().over(w)).where("n = 1").select("conv_id", "text")
