"""Streaming forms of the batch operators: extensions, as records may arrive late and twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postmill.operators.identity import latest
from postmill.operators.state import upsert


def first_seen_stream(rows: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; a repeat within ``late`` of it is dropped, and state is kept no longer."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_attempts(rows: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """About how many keys a day were attempted, by event time."""
    return rows.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day"), "status").agg(F.approx_count_distinct("stable_id").alias("postings"))


def upsert_stream(rows: DataFrame, snapshots: str, key: str, order: str, checkpoint: str, **rules) -> StreamingQuery:
    """Apply each micro-batch to the latest snapshot below ``snapshots`` and write the next one.

    The batch's number names the snapshot, so a batch that is repeated after a failure writes the same one again.
    """

    def apply(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, [key], order)
        out = new.drop(order) if n == 0 else upsert(spark.read.parquet(f"{snapshots}/v={n - 1}"), new.drop(order), key, **rules).drop("is_new")
        out.write.mode("overwrite").parquet(f"{snapshots}/v={n}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
