"""Queries of whole runs: a feed is written from the orders, scanned, judged, stored and counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import Rubric
from postmill.operators import run as runs
from postmill.plans.queries import _MATCHED, query
from postmill.plans.source_queries import by_file, put_files
from postmill.session import read_table, scratch_folder
from postmill.sources.store import SnapshotStore

_AT = "2026-01-01 00:00:00"
#: Orders by number: every fifth deadline is over; the text decides the rest as in the query match_postings.
_RUN = f"SELECT *, id % 5 = 0 AS late, k = 0 AND id % 5 <> 0 AS eligible FROM ({_MATCHED})"
_BAND = "CASE WHEN round(score, 9) >= 0.68 AND rel >= 0.5 THEN 'strong' WHEN round(score, 9) >= 0.42 THEN 'shortlist' ELSE 'reject' END"


def _run(spark: SparkSession, d: str) -> tuple[runs.Run, DataFrame]:
    key = F.col("o_orderkey")
    k, t = key % 3, F.floor(key / 3) % 2
    body = F.when(k == 0, "Docker, SQL and Flask. January to June 2026").when(k == 1, "Be there. July to September 2026").otherwise("AWS, Azure, Linux, React, GraphQL, Kubernetes, Java, Agile. Unpaid")
    late = F.when(key % 5 == 0, "\nDeadline: 1990-01-01").otherwise("")
    job = F.struct(
        key.cast("string").alias("id"), F.when(t == 0, "ML Intern, Deep Learning").otherwise("Intern").alias("title"), F.lit("Acme").alias("company"), F.lit("Pune").alias("location"), F.lit("Internship").alias("employment_type"),
        F.concat(F.lit("We do machine learning in Python.\nResponsibilities:\n"), body, late).alias("description"), F.when(k == 1, True).alias("is_remote"),
    )
    root = scratch_folder(spark, "run")
    put_files(by_file(read_table(spark, d, "orders"), "o_orderkey", 5000).agg(F.to_json(F.collect_list(job)).alias("value")), f"{root}/feed")
    known = F.array(F.lit("Docker"), F.lit("SQL"), F.lit("Machine Learning"))
    store, log = SnapshotStore(spark, f"{root}/postings", "stable_id", 16), SnapshotStore(spark, f"{root}/runs", "id", 1)
    feeds = [("local", {"path": f"{root}/feed"}), ("local", {"path": f"{root}/gone"}), ("lever", {"enabled": False, "company": "C"})]
    done = runs.run(spark, feeds, store, known, F.lit(_AT).cast("timestamp"), runs=log, mode="query")
    return done, store.read()


@query(
    "run_postings",
    f"SELECT 'local:' || id AS stable_id, eligible, CASE WHEN late THEN 'closed' ELSE 'unverified' END AS open_state, CASE WHEN late THEN '1990-01-01' END AS deadline, CASE WHEN eligible THEN round(score, 6) END AS score, CASE WHEN eligible THEN {_BAND} END AS band FROM ({_RUN})",
)
def run_postings(spark, d):
    """The store after a run."""
    return _run(spark, d)[1].select("stable_id", "eligible", "open_state", "deadline", F.round("score", 6).alias("score"), "band")


@query("run_shortlist", f"SELECT 'local:' || id AS stable_id, {_BAND} AS band, row_number() OVER (ORDER BY round(score, 9) DESC, 'local:' || id) AS place FROM ({_RUN}) WHERE eligible AND round(score, 9) >= {Rubric().shortlist} QUALIFY place <= 20")
def run_shortlist(spark, d):
    """The twenty best of a run, by place."""
    best = _run(spark, d)[1].where("shortlisted").orderBy(F.desc(F.round("score", 9)), "stable_id").limit(20)
    listed = best.agg(F.sort_array(F.collect_list(F.struct((-F.round("score", 9)).alias("o"), "stable_id", "band"))).alias("l"))
    return listed.select(F.posexplode("l").alias("i", "r")).select("r.stable_id", "r.band", (F.col("i") + 1).cast("long").alias("place"))


@query(
    "run_counters",
    f"SELECT 1::BIGINT AS id, 'query' AS mode, true AS finished, name, n::BIGINT AS n FROM (SELECT unnest(['discovered', 'new', 'rows', 'eligible', 'shortlisted', 'strong', 'sources_ok', 'sources_failed', 'sources_skipped']) AS name, "
    f"unnest([count(*), count(*), count(*), count(*) FILTER (eligible), count(*) FILTER (eligible AND round(score, 9) >= {Rubric().shortlist}), count(*) FILTER (eligible AND {_BAND} = 'strong'), 1, 1, 1]) AS n FROM ({_RUN}))",
)
def run_counters(spark, d):
    """The table of runs: counters observed while the store was written."""
    done, _ = _run(spark, d)
    return done.runs.select("id", "mode", F.col("finished_at").isNotNull().alias("finished"), F.explode("stats").alias("name", "n"))


@query("store_upserts", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_nationkey = 3 THEN 'second' ELSE 'first' END AS title, CASE WHEN c_nationkey = 3 THEN c_name END AS note, 1::BIGINT AS first_seen FROM customer UNION ALL SELECT 's' || s_suppkey, 'third', s_name, 3 FROM supplier")
def store_upserts(spark, d):
    """Three upserts into buckets: all customers, those of one nation with a new column, all suppliers."""
    store = SnapshotStore(spark, f"{scratch_folder(spark, 'snapshots')}/table", "id", 8)
    c, s = read_table(spark, d, "customer"), read_table(spark, d, "supplier")
    store.upsert(c.select(F.col("c_custkey").cast("string").alias("id"), F.lit("first").alias("title"), F.lit(1).cast("long").alias("first_seen")))
    store.upsert(c.where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("id"), F.lit("second").alias("title"), F.col("c_name").alias("note"), F.lit(2).cast("long").alias("first_seen")), keep=("first_seen",))
    store.upsert(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("third").alias("title"), F.col("s_name").alias("note"), F.lit(3).cast("long").alias("first_seen")), keep=("first_seen",))
    return store.read().select("id", "title", "note", "first_seen")
