"""Aggregations and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.config import Lifecycle
from postmill.functions.temporal import quiet_days
from postmill.operators.identity import latest


def gap_heatmap(applications: DataFrame, postings: DataFrame) -> DataFrame:
    """skill, jobs, weight and sources of what is missing.

    Both tables have stable_id, score and gaps; applications id as well. The newest application of a
    posting counts instead of the posting, even without a score; rows without a score add nothing,
    a skill listed twice counts twice, and a row weighs 1 - score within 0 and 1.
    """
    newest = latest(applications, ["stable_id"], "id")
    rest = postings.join(newest.select("stable_id"), "stable_id", "left_anti")
    rows = newest.select("score", "gaps", F.lit("application").alias("source")).unionByName(rest.select("score", "gaps", F.lit("posting").alias("source")))
    each = rows.where("score is not null").select((1 - F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0))).alias("w"), "source", F.explode("gaps").alias("skill"))
    return each.groupBy("skill").agg(F.count("*").alias("jobs"), F.round(F.sum("w"), 6).alias("weight"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))


def heatmap_order() -> list[Column]:
    return [F.desc("weight"), F.desc("jobs"), F.asc(F.lower("skill"))]


def funnel(df: DataFrame, by: list[str], **stages: Column) -> DataFrame:
    """Rows of each group that reach each stage."""
    return df.groupBy(*by).agg(F.count("*").alias("discovered"), *(F.count_if(c).alias(k) for k, c in stages.items()))


def rejections(df: DataFrame, reasons: str = "reject_reasons") -> DataFrame:
    """How many rows each reason rejects; a row counts for all of its reasons."""
    return df.select(F.explode_outer(reasons).alias("r")).where("r is not null").groupBy(F.split("r", ": ")[0].alias("reason")).agg(F.count("*").alias("rows"))


def rejection_matrix(df: DataFrame, by: str, reasons: str = "reject_reasons") -> DataFrame:
    """How many rows each reason rejects in each group ``by``, with totals, in one pass of grouping sets (an extension).

    level tells what a row stands for: cell, group (all reasons), reason (all groups) or all, so that a null group is not
    taken for a total. Totals count reasons, so a row of two counts twice.
    """
    each = df.select(F.col(by).alias("grp"), F.explode_outer(reasons).alias("r")).where("r is not null").select("grp", F.split("r", ": ")[0].alias("reason"))
    sets = [["grp", "reason"], ["grp"], ["reason"], []]
    summed = each.groupingSets([[F.col(c) for c in s] for s in sets], F.col("grp"), F.col("reason")).agg(F.count("*").alias("rows"), F.grouping_id().alias("g"))
    level = F.get(F.array(*map(F.lit, ("cell", "group", "reason", "all"))), F.col("g").cast("int"))
    return summed.select(F.col("grp").alias(by), "reason", level.alias("level"), "rows")


def attempts_on(attempts: DataFrame, day: str, statuses: tuple[str, ...]) -> DataFrame:
    """n: distinct postings attempted on a day."""
    return attempts.where((F.col("day") == F.lit(day)) & F.col("status").isin(*statuses)).agg(F.countDistinct("stable_id").alias("n"))


def quiet_applications(applications: DataFrame, approved: DataFrame, as_of: Column, days: int, max_reminders: int | None = None, limits: Lifecycle | None = None) -> DataFrame:
    """Each posting's newest application, if tracked, open and quiet for ``days``: submitted, or approved by a person, and without a final outcome.

    With ``max_reminders``, only those reminded less often. For a report sort by :func:`quiet_order`.
    """
    newest = latest(applications, ["stable_id"], "id")
    open_ = newest.where(~is_final(F.col("outcome"), limits or Lifecycle())) if "outcome" in applications.columns else newest
    known = open_.join(approved.select("stable_id").distinct().withColumn("__ok", F.lit(True)), "stable_id", "left")
    tracked = known.where((F.col("status") == "submitted") | F.col("__ok")).drop("__ok")
    quiet = tracked.withColumn("quiet_days", quiet_days(as_of, F.col("last_followup_at"), F.col("submitted_at"), F.col("updated_at")))
    out = quiet.where(F.col("quiet_days") >= days)
    return out.where(F.coalesce("reminders", F.lit(0)) < max_reminders) if max_reminders is not None else out


def is_final(outcome: Column, limits: Lifecycle) -> Column:
    """Whether an outcome closes an application; everything else, nothing at all included, leaves it open."""
    return F.lower(F.trim(F.coalesce(outcome, F.lit("")))).isin(*limits.final)


def quiet_order() -> list[Column]:
    """Longest quiet first, then by company."""
    return [F.desc("quiet_days"), F.asc(F.lower(F.coalesce("company", F.lit(""))))]


def quiet_listed(quiet: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of :func:`quiet_applications` for a report, with ``place``, from 1; ties of the order go by stable_id."""
    order = [*quiet_order(), F.asc("stable_id")]
    first = quiet.orderBy(*order).limit(top)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


def heatmap_lines(heat: DataFrame, top: int) -> DataFrame:
    """The first rows of a heat map as text of fixed width, and a line that counts the others."""
    n = heat.count()
    line = F.concat(F.rpad("skill", 24, " "), F.lpad(F.col("jobs").cast("string"), 6, " "), F.lpad(F.replace(F.format_number("weight", 2), F.lit(","), F.lit("")), 10, " "))
    shown = heat.orderBy(*heatmap_order()).limit(top).select(line.alias("line"))
    return shown if n <= top else shown.union(heat.sparkSession.range(1).select(F.lit(f"... {n - top} more").alias("line")))


def postings_where(df: DataFrame, eligible: bool | None = None, min_score: float | None = None) -> DataFrame:
    """Stored postings by the conditions that are given, for a report in order of ``F.desc_nulls_last("score")``; a row without a score reaches no least score."""
    if eligible is not None:
        df = df.where(F.col("eligible") == F.lit(eligible))
    return df if min_score is None else df.where(F.col("score") >= min_score)


def listed(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, int]:
    """The first rows of a report, and how many rows it has in all."""
    return df.orderBy(*order).limit(limit), df.count()


def source_outcomes(outcomes: DataFrame) -> DataFrame:
    """Counts of the outcomes (source, status, ...) of a scan: ok, failed, skipped."""
    return outcomes.agg(*(F.count_if(F.col("status") == s).alias(name) for s, name in (("ok", "ok"), ("error", "failed"), ("skipped", "skipped"))))
