"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour, or to itself if that is less."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. Takes edges with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    ``edges`` has two columns of node ids; direction, repeats and loops do not matter, nulls are
    left out, and no edges give no rows. Each round is two aggregations and two joins on a node,
    so a node with very many edges is pre-aggregated or split by AQE's skew join; rounds grow with
    the logarithm of the longest path. Every round is written to the shared folder; nothing but
    two numbers a round reaches the driver.
    """
    a, b = edges.columns
    now = scratch.keep(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        found = now.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
        if not found[0] or found == before:
            break
        before = found
        after = scratch.keep(_small_star(_large_star(now).distinct()).distinct(), "edges")
        scratch.drop(now)
        now = after
    # at rest every component is a star, so each edge names its node's component
    return scratch.keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), "components")
