"""Sinks: the review queue as JSON lines or Markdown, packets, and an archive that never overwrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import json_list, slug

#: Columns of a queue that hold JSON lists.
LISTS = ("reasons", "matched_keywords", "gaps")


def queue_items(queue: DataFrame, status: str = "pending") -> DataFrame:
    """Rows of one status, JSON columns decoded, best score first and null scores last."""
    lists = {c: json_list(F.col(c)) for c in LISTS if c in queue.columns}
    return queue.where(F.col("status") == status).withColumns(lists).orderBy(F.desc_nulls_last("score"), "stable_id")


def queue_markdown(items: DataFrame) -> Column:
    """An item of :func:`queue_items` as a section of text; lists end after 15 words, empty ones are left out."""
    said = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"- {name}: "), F.array_join(F.slice(c, 1, 15), ", ")))
    head = F.concat(F.lit("## "), items["company"], F.lit(" - "), items["title"], F.lit(" (score "), items["score"].cast("string"), F.lit(")"))
    return F.concat_ws("\n", head, F.concat(F.lit("- source: "), items["source"]), F.concat(F.lit("- apply: "), items["apply_url"]), said("matched", items["matched_keywords"]), said("gaps", items["gaps"]))


def write_queue(queue: DataFrame, path: str, form: str = "json", status: str = "pending") -> None:
    """Write the queue below ``path`` as JSON lines (json), one JSON array (array) or Markdown (md).

    An array is one value, so it gathers the queue in one task: for queues that a person reads.
    """
    items = queue_items(queue, status)
    if form == "array":
        one = items.agg(F.to_json(F.sort_array(F.collect_list(F.struct((-F.coalesce("score", F.lit(float("-inf")))).alias("o"), F.col("stable_id").alias("k"), F.struct(*items.columns).alias("r"))))["r"]).alias("value"))
        one.write.mode("overwrite").text(path)
        return
    if form == "md":
        items.select(queue_markdown(items).alias("value")).write.mode("overwrite").text(path, lineSep="\n\n")
    else:
        items.write.mode("overwrite").json(path)


def packets(plans: DataFrame) -> DataFrame:
    """packet_dir and packet (a JSON object of all columns) for each row of ``plans`` (company, title, stable_id, ...)."""
    where = F.concat(slug(F.concat_ws("-", "company", "title"), 48), F.lit("-"), F.substring(F.sha1("stable_id"), 1, 10))
    return plans.select(where.alias("packet_dir"), F.to_json(F.struct(*plans.columns)).alias("packet"))


def not_archived(rows: DataFrame, archive: DataFrame, key: str = "stable_id") -> DataFrame:
    """Rows whose key the archive lacks, the first of each key by all columns: appending them never overwrites."""
    fresh = rows.join(archive.select(key).distinct(), key, "left_anti")
    return fresh.groupBy(key).agg(F.min(F.struct(*(c for c in rows.columns if c != key))).alias("r")).select(key, "r.*")
