"""One run from feeds to a shortlist: scan, deadlines, open state, filters, scores, the store, and the run's counters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.config import Rubric, Rules
from postmill.functions.temporal import deadline, open_state, registration
from postmill.operators.filters import filter_postings
from postmill.operators.score import match_postings, shortlist
from postmill.session import ROWS_A_TASK, scratch_folder, spread
from postmill.sources.readers import scan_feeds
from postmill.sources.scan import Scan, first_rows
from postmill.sources.store import SnapshotStore

RUNS = "id long, mode string, started_at timestamp, finished_at timestamp, stats map<string,bigint>"
#: Columns of the common shape that the store keeps, and what a run adds to them.
KEPT = ("source", "job_id", "company", "title", "url", "location", "description", "employment_type", "published_at", "deadline", "apply_url", "apply_email", "is_remote")
#: Columns of the common shape that decide how a posting is judged; of raw only what :func:`registration` leaves.
JUDGED_BY = ("source", "title", "company", "location", "description", "employment_type", "deadline", "is_remote", "raw")
#: What a judgement adds to a posting in the store.
JUDGEMENT = ("eligible", "reject_reasons", "open_state", "window_label", "stipend_state", "score", "band", "gaps", "shortlisted")


def judged(postings: DataFrame, known: Column, as_of: Column, rules: Rules | None = None, rubric: Rubric | None = None) -> DataFrame:
    """Postings of the common shape with stable_id, as filtered and scored: a missing deadline is read from the text, then its open state, all filters, and the score.

    Adds what :func:`filter_postings` and :func:`match_postings` add, shortlisted, and null score and band for rows that a filter rejects.
    """
    r = rubric or Rubric()
    words = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif("description", F.lit("")))
    df = postings.withColumn("deadline", F.coalesce(F.nullif("deadline", F.lit("")), deadline(words), F.lit("")))
    df = df.withColumn("open", open_state(words, F.col("deadline"), F.col("raw"), as_of, F.col("source")))
    df = match_postings(filter_postings(df, rules), known, r)
    only = lambda c: F.when(F.col("eligible"), F.col(c))
    df = df.withColumns({"score": only("score"), "band": only("band")})
    return df.withColumn("shortlisted", F.coalesce(F.col("score") >= r.shortlist, F.lit(False)))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as it was written below ``path``, so that nothing of its plan is computed again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def judged_once(postings: DataFrame, known: Column, as_of: Column, folder: str, rules: Rules | None = None, rubric: Rubric | None = None) -> DataFrame:
    """stable_id, :data:`KEPT` and :data:`JUDGEMENT` of postings, by :func:`judged`; postings that are equal in :data:`JUDGED_BY` are judged once.

    Postings, their distinct contents and the judgements are kept below ``folder``. Contents are dealt into tasks by their
    number, and joined to the postings by equality of all their columns, so a posting has the judgement of its own content and no other.
    """
    rows = _kept(postings.select("stable_id", *KEPT, "raw"), f"{folder}/rows")
    contents = _kept(rows.select(*JUDGED_BY).distinct(), f"{folder}/contents")
    found = judged(spread(contents).withColumns({f"__{c}": F.col(c) for c in JUDGED_BY}), known, as_of, rules, rubric).select(
        *(f"__{c}" for c in JUDGED_BY), "deadline", "eligible", "reject_reasons", F.col("open.state").alias("open_state"), F.col("window.label").alias("window_label"), F.col("stipend.state").alias("stipend_state"),
        "score", "band", F.col("coverage.missing").alias("gaps"), "shortlisted",
    )
    found = _kept(found, f"{folder}/judgements")
    if found.count() > ROWS_A_TASK:  # texts that are much alike are small as a file, by which Spark would broadcast them, and large in memory
        found = found.hint("merge")
    # the hash sorts and deals long texts cheaply; the columns themselves decide
    of = lambda cols: F.xxhash64(*cols)
    same = reduce(lambda a, b: a & b, (rows[c].eqNullSafe(found[f"__{c}"]) for c in JUDGED_BY), of(rows[c] for c in JUDGED_BY) == of(found[f"__{c}"] for c in JUDGED_BY))
    return rows.join(found, same, "left").select("stable_id", *(found[c] if c == "deadline" else rows[c] for c in KEPT), *JUDGEMENT)


@dataclass
class Run:
    """scan: what the feeds gave; postings: the rows judged, as stored; shortlisted: the best, in order; stats: the counters; runs: the table of runs with this one."""

    scan: Scan
    postings: DataFrame
    shortlisted: DataFrame
    stats: dict[str, int]
    runs: DataFrame


def start_run(runs: DataFrame | None, spark: SparkSession, mode: str, at: Column) -> DataFrame:
    """One row for the run that begins: the next number, its mode and its time."""
    last = F.lit(0).cast("long") if runs is None else None
    row = spark.range(1) if runs is None else runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))
    row = row.select(last.alias("id")) if last is not None else row
    return row.select((F.col("id") + 1).cast("long").alias("id"), F.lit(mode).alias("mode"), at.cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("map<string,bigint>").alias("stats"))


def finish_run(run: DataFrame, stats: dict[str, int], at: Column) -> DataFrame:
    """A run's row with its end and its counters."""
    counters = F.create_map(*(F.lit(x) for k, v in stats.items() for x in (k, int(v)))).cast("map<string,bigint>")
    return run.withColumns({"finished_at": at.cast("timestamp"), "stats": counters})


def run(spark: SparkSession, feeds: list[tuple[str, dict]], store: SnapshotStore, known: Column, as_of: Column, *, runs: SnapshotStore | None = None, mode: str = "run", limit: int | None = None, rules: Rules | None = None, rubric: Rubric | None = None) -> Run:
    """Scan the feeds, judge all postings, bring them into the store, and pick the shortlist.

    Postings and judgements are kept in the shared folder first, as the store reads them twice: for the buckets that they fall into, and to
    write these, in the pass of which the counters are observed. The shortlist and the rows of the result are then read from the store. first_seen and the score of a known
    posting are kept where this run has none. ``runs`` takes the run's row at its start, and again, with counters, at its end: a run that
    dies leaves a row without an end.
    """
    found = scan_feeds(spark, feeds)
    begun = None
    if runs is not None:
        begun = spark.createDataFrame(start_run(runs.read(), spark, mode, as_of).collect(), RUNS)  # one row; its number must not change later
        runs.upsert(begun)
    # what is not judged by goes before the rows are shuffled
    first = first_rows(found.every.drop("salary").withColumn("raw", registration(F.col("raw"))))
    stored = judged_once(first, known, as_of, scratch_folder(spark, "judged"), rules, rubric)
    stored = stored.withColumns({"first_seen": as_of.cast("timestamp"), "updated_at": as_of.cast("timestamp")})
    counters = {"discovered": F.count(F.lit(1)), "eligible": F.count_if("eligible"), "shortlisted": F.count_if("shortlisted"), "strong": F.count_if(F.col("shortlisted") & (F.col("band") == "strong"))}
    told = store.upsert(stored, observe=counters, keep=("first_seen",), coalesce=("score", "band"), fill_empty=("deadline",))
    outcomes = {r["status"]: r["n"] for r in found.outcomes.groupBy("status").agg(F.count("*").alias("n")).collect()}
    names = {"ok": "sources_ok", "error": "sources_failed", "skipped": "sources_skipped"}
    stats = {k: told[k] or 0 for k in (*counters, "new", "rows")} | {v: outcomes.get(k, 0) for k, v in names.items()}
    if limit is not None:
        stats["shortlisted"] = min(limit, stats["shortlisted"])
    if runs is not None:
        runs.upsert(finish_run(begun, stats, as_of))
    now = store.read().where(F.col("updated_at") == as_of.cast("timestamp"))
    best = shortlist(now.where("shortlisted"), 0.0, limit, order="stable_id")
    return Run(found, now, best, stats, runs.read() if runs is not None else None)
