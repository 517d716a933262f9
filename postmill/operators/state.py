"""Keyed state as versioned snapshots: each function gives the next version as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.config import Lifecycle
from postmill.operators.identity import latest


def upsert(old: DataFrame, new: DataFrame, key: str, *, keep: tuple[str, ...] = (), coalesce: tuple[str, ...] = (), fill_empty: tuple[str, ...] = ()) -> DataFrame:
    """``old`` updated by ``new``: one full outer join on the key.

    Columns of ``keep`` stay as they are for known keys; those of ``coalesce`` take a new value
    unless it is null, ``fill_empty`` unless it is null or empty; all others are overwritten.
    is_new tells which keys were not there.
    """
    o, n = old.alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh, known = F.coalesce(F.col("n.__new"), F.lit(False)), F.col(f"o.{key}").isNotNull()
    out = [F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in [c for c in old.columns if c != key]:
        was = F.col(f"o.{c}")
        if c not in new.columns:
            value = was
        else:
            now = F.col(f"n.{c}")
            if c in keep:
                value = F.when(known, was).otherwise(now)
            elif c in coalesce:
                value = F.coalesce(now, was)
            elif c in fill_empty:
                value = F.coalesce(F.nullif(now, F.lit("")), was)
            else:
                value = F.when(fresh, now).otherwise(was)
        out.append(value.alias(c))
    return joined.select(*out, (fresh & ~known).alias("is_new"))


def append_with_ids(log: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """``log`` with rows of ``new`` numbered on from its highest id, in ``order``.

    The new rows are sorted by ranges and numbered within these; each range begins where those
    before it end. So no task holds more than a range, and only its count goes further.
    """
    last = log.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__last"))
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that both readers of the ranges see the same ones
    ranged = new.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    within = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("__part").agg(F.count("*").alias("__c")).select("__part", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"))
    numbered = within.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(last))
    return log.unionByName(numbered.withColumn(id_col, (F.col("__last") + F.col("__before") + F.col("__n")).cast("long")).drop("__n", "__last", "__before", "__part"), allowMissingColumns=True)


def save_matches(postings: DataFrame, matches: DataFrame, at: Column) -> DataFrame:
    """``postings`` with the scored columns of ``matches`` (stable_id, ...) and the time they were scored; other rows and columns stay."""
    scored = [c for c in matches.columns if c != "stable_id" and c in postings.columns]
    m = matches.select("stable_id", *(F.col(c).alias(f"__{c}") for c in scored), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    times = {c: F.when(hit, at).otherwise(F.col(c)) for c in ("scored_at", "updated_at") if c in postings.columns}
    out = postings.join(m, "stable_id", "left")
    return out.withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in scored} | times).select(postings.columns)


def decide_reviews(queue: DataFrame, applications: DataFrame, decisions: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Queue and applications after ``decisions`` (stable_id, decision).

    The review takes the decision as its status, and the time; every application left to a person
    gets review_category human_<decision>, while its status stays.
    """
    d = decisions.select("stable_id", F.col("decision").alias("__d"))
    made = F.col("__d").isNotNull()
    q = queue.join(d, "stable_id", "left").withColumns({"status": F.coalesce("__d", "status"), "decided_at": F.when(made, at).otherwise(F.col("decided_at"))}).select(queue.columns)
    hit = (F.col("status") == "manual_required") & made
    changed = {"review_category": F.when(hit, F.concat(F.lit("human_"), "__d")).otherwise(F.col("review_category"))}
    if "updated_at" in applications.columns:
        changed["updated_at"] = F.when(hit, at).otherwise(F.col("updated_at"))
    return q, applications.join(d, "stable_id", "left").withColumns(changed).select(applications.columns)


def enqueue_reviews(queue: DataFrame, plans: DataFrame, at: Column) -> DataFrame:
    """The queue with ``plans``: new ones are pending since ``at``; known ones take scores, lists and files but keep status, time, company, title and links."""
    fixed = tuple(c for c in ("status", "created_at", "source", "company", "title", "url", "apply_url") if c in queue.columns)
    return upsert(queue, plans.withColumns({"status": F.lit("pending"), "created_at": at}), "stable_id", keep=fixed)


def update_applications(applications: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """``applications`` with the status, outcome and error of ``changes`` (id, ...); submitted_at is set when a status becomes submitted, and kept else."""
    c = changes.select("id", *(F.col(x).alias(f"__{x}") for x in ("status", "outcome", "error")), F.lit(True).alias("__hit"))
    hit = F.col("__hit").isNotNull()
    out = applications.join(c, "id", "left").withColumns({x: F.when(hit, F.col(f"__{x}")).otherwise(F.col(x)) for x in ("status", "outcome", "error")})
    out = out.withColumns({"updated_at": F.when(hit, at).otherwise(F.col("updated_at")), "submitted_at": F.when(hit & (F.col("status") == "submitted"), at).otherwise(F.col("submitted_at"))})
    return out.select(applications.columns)


def supersede_reviews(queue: DataFrame, applications: DataFrame, at: Column) -> DataFrame:
    """Pending reviews of postings that have been submitted become superseded, decided at ``at``."""
    done = applications.where("status = 'submitted'").select("stable_id").distinct().withColumn("__done", F.lit(True))
    out = queue.join(done, "stable_id", "left").withColumn("__done", F.col("__done").isNotNull() & (F.col("status") == "pending"))
    return out.withColumns({"status": F.when(F.col("__done"), "superseded").otherwise(F.col("status")), "decided_at": F.when(F.col("__done"), at).otherwise(F.col("decided_at"))}).select(queue.columns)


def record_outcomes(applications: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """``events`` (stable_id, outcome, note; one a posting) on each posting's newest application.

    A null outcome is a follow-up: it adds a reminder and its time. Outcomes are written lower-case
    with underscores; notes are appended with the time.
    """
    newest = applications.groupBy("stable_id").agg(F.max("id").alias("id"))
    e = events.select("stable_id", F.replace(F.lower(F.trim("outcome")), F.lit(" "), F.lit("_")).alias("__outcome"), F.col("note").alias("__note")).join(newest, "stable_id").drop("stable_id").withColumn("__hit", F.lit(True))
    out = applications.join(e, "id", "left")
    hit, follow = F.col("__hit").isNotNull(), F.col("__hit").isNotNull() & F.col("__outcome").isNull()
    line = F.concat(at.cast("string"), F.lit(" "), F.trim("__note"))
    notes = F.when(F.coalesce("notes", F.lit("")) == "", line).otherwise(F.concat("notes", F.lit("\n"), line))
    out = out.withColumns(
        {
            "outcome": F.coalesce("__outcome", "outcome"),
            "reminders": F.coalesce("reminders", F.lit(0)) + follow.cast("int"),
            "last_followup_at": F.when(follow, at).otherwise(F.col("last_followup_at")),
            "notes": F.when(hit & (F.coalesce("__note", F.lit("")) != ""), notes).otherwise(F.col("notes")),
            "updated_at": F.when(hit, at).otherwise(F.col("updated_at")),
        }
    )
    return out.select(applications.columns)


def blocking(applications: DataFrame, limits: Lifecycle) -> DataFrame:
    """stable_id, id and status of the newest application that keeps each posting from being applied to again.

    Those are submissions under way or done, and those left to a person for a reason that lasts
    (review_category, else review_reason). Failed ones and those that wait for a passing reason
    keep nothing.
    """
    text = lambda c: F.nullif(F.col(c), F.lit("")) if c in applications.columns else F.lit(None).cast("string")
    lasting = ~F.coalesce(text("review_category"), text("review_reason"), F.lit("")).isin(*limits.transient)
    held = applications.where(F.col("status").isin("submitting", "submitted") | ((F.col("status") == "manual_required") & lasting))
    return latest(held, ["stable_id"], "id").select("stable_id", "id", "status")


def sweep_stale(applications: DataFrame, stale: DataFrame, at: Column) -> DataFrame:
    """``applications`` in which the newest one of each stale posting (stable_id, quiet_days) has got the outcome no_response and a note that says why."""
    note = F.format_string("stale resolved no_response after %d days quiet", "quiet_days")
    return record_outcomes(applications, stale.select("stable_id", F.lit("no_response").alias("outcome"), note.alias("note")), at)


def log_attempts(attempts: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """``attempts`` with those of ``new`` (stable_id, adapter, status, detail), numbered on, with their time and its day in UTC."""
    timed = new.withColumns({"attempted_at": at, "day": F.date_format(at, "yyyy-MM-dd")})
    return append_with_ids(attempts, timed, ["stable_id", "status"])


def resolve_ids(refs: DataFrame, postings: DataFrame, queue: DataFrame, applications: DataFrame) -> DataFrame:
    """(ref, stable_id): a reference is a stable id on record, else a review's number, else an application's; empty if it is none.

    References of digits alone are looked up as numbers; one with a colon is a stable id or nothing.
    """
    r = refs.select("ref", F.trim(F.coalesce("ref", F.lit(""))).alias("__r")).distinct()
    own = postings.select("stable_id").union(applications.select("stable_id")).distinct().select(F.col("stable_id").alias("__own"))
    by = lambda t, name: t.select(F.col("id").cast("string").alias("__k"), F.col("stable_id").alias(name)).dropDuplicates(["__k"])
    number = F.when(F.col("__r").rlike(r"^\d+$"), F.regexp_replace("__r", r"^0+(?=\d)", ""))
    out = r.join(own, F.col("__r") == F.col("__own"), "left").withColumn("__n", number)
    out = out.join(by(queue, "__review"), F.col("__n") == F.col("__k"), "left").drop("__k").join(by(applications, "__app"), F.col("__n") == F.col("__k"), "left").drop("__k")
    return out.select("ref", F.coalesce("__own", "__review", "__app", F.lit("")).alias("stable_id"))


def within_cap(candidates: DataFrame, used_today: DataFrame, cap: int, order: list[Column | str]) -> DataFrame:
    """``candidates`` with capped: those that come after the day's remaining submissions in the given order.

    ``used_today`` has one row, n. Only the first ``cap`` rows need an order, so they are taken by a top-k, not a global window.
    """
    first = candidates.orderBy(*order).limit(cap).withColumn("rn", F.row_number().over(Window.orderBy(*order)))
    admitted = first.crossJoin(F.broadcast(used_today)).where(F.col("rn") + F.col("n") <= cap).select("stable_id", F.lit(False).alias("capped"))
    return candidates.join(admitted, "stable_id", "left").withColumn("capped", F.coalesce("capped", F.lit(True)))
