"""Identity: first seen, latest, exclusion lists, shadowed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_seen(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given total order; partial aggregation keeps a hot key out of one task.

    ``order`` holds columns or expressions that sort ascending.
    """
    by = [c if isinstance(c, Column) else F.col(c) for c in order]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(by)))).alias("__r")).select("__r.*")


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Each key's row of the greatest ``by``; partial aggregation keeps a hot key out of one task."""
    return df.groupBy(*keys).agg(F.max_by(F.struct("*"), by).alias("__r")).select("__r.*")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Sources in order, with source_ord; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.withColumn("source_ord", F.lit(i)) for i, p in enumerate(parts)))


def excluded_by(df: DataFrame, entries: DataFrame, keys: dict[str, tuple[Column, Column]], row: str) -> DataFrame:
    """(row, ord) for each row of ``df`` that any key of an entry matches; ord is the first such entry's.

    ``keys`` gives for each kind of key its column on either side. Rows and entries become (kind, key)
    pairs, so a disjunction of equalities is one equi-join.
    """
    pairs = lambda d, side, *more: d.select(*more, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c[side].cast("string").alias("key")) for k, c in keys.items()))).alias("k")).select(*more, "k.kind", "k.key").where("key is not null and key <> ''")
    left, right = pairs(df, 0, row), pairs(entries, 1, "ord").groupBy("kind", "key").agg(F.min("ord").alias("ord"))
    return left.join(right, ["kind", "key"]).groupBy(row).agg(F.min("ord").alias("ord"))


def union_queries(parts: list[tuple[str, DataFrame]], order: str = "row_ord") -> tuple[DataFrame, DataFrame]:
    """The queries of one source in order as one table, and (query, new_rows) for each query.

    The first row of each job_id, or stable_id where that is empty, is kept; a query counts the rows
    that none before it had, and stays in the counts if there are none.
    """
    spark = parts[0][1].sparkSession
    rows = reduce(lambda a, b: a.unionByName(b), (p.withColumns({"query_ord": F.lit(i), "query": F.lit(q)}) for i, (q, p) in enumerate(parts)))
    keyed = rows.withColumn("__key", F.coalesce(F.nullif("job_id", F.lit("")), F.concat_ws(":", "source", "job_id")))
    first = first_seen(keyed, ["__key"], ["query_ord", order]).drop("__key")
    names = spark.createDataFrame(list(enumerate(q for q, _ in parts)), "query_ord int, query string")
    n = first.groupBy("query_ord").agg(F.count("*").alias("n"))
    return first.drop("query"), names.join(n, "query_ord", "left").select("query", F.coalesce("n", F.lit(0)).alias("new_rows"))
