"""Pages of a search that landed in any order, put into the order in which their tokens name each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.session import scratch_folder
from postmill.sources import readers, scan


def page_order(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(query, token, page_no, status) of the pages (query, token, next_token) of several searches.

    List ranking by pointer doubling: each page points to the one before it, and in each round to where that one
    points, so that n pages take log2(n) rounds of one join, in whatever order they landed. Only pages that do not yet point to
    their first join, which no two do on one page; both sides are shuffled, as a broadcast would pass all pages through the driver. A page whose chain begins with the
    empty token is ``ok`` and counted from 0; where a page before it has not landed it is in a ``gap``, counted
    from that; pages that name each other in a ring are a ``cycle`` without a number.

    Null tokens are empty. A page that landed twice counts once; of several that name the same next page the one of the least token counts.
    """
    root = scratch_folder(spark, "pages")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    own = pages.select("query", text("token"), text("next_token")).groupBy("query", "token").agg(F.max("next_token").alias("next_token"))
    before = own.where("next_token <> ''").groupBy("query", F.col("next_token").alias("token")).agg(F.min("token").alias("up"))
    # a first page points to itself at distance 0
    now = own.select("query", "token").join(before.hint("merge"), ["query", "token"], "left").select("query", "token", F.coalesce("up", "token").alias("up"), F.col("up").isNotNull().cast("long").alias("dist"), F.col("up").isNull().alias("settled"))
    rounds = None
    for i in range(64):
        path = f"{root}/{i}"
        now.write.parquet(path)
        now = spark.read.schema(now.schema).parquet(path)
        n, open_ = now.agg(F.count("*"), F.count_if(~F.col("settled"))).first()
        rounds = math.ceil(math.log2(max(2, n))) + 1 if rounds is None else rounds
        if not open_ or i > rounds:
            break
        to = now.select("query", F.col("token").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("settled").alias("settled2"))
        step = now.where(~F.col("settled")).join(to.hint("merge"), ["query", "up"], "left")
        step = step.select("query", "token", F.coalesce("up2", "up").alias("up"), (F.col("dist") + F.coalesce("dist2", F.lit(0))).alias("dist"), F.coalesce("settled2", F.lit(True)).alias("settled"))
        now = now.where("settled").unionByName(step)
    status = F.when(~F.col("settled"), "cycle").when(F.col("up") == "", "ok").otherwise("gap")
    return now.select("query", "token", F.when(F.col("settled"), F.col("dist")).alias("page_no"), status.alias("status"))


def landed_postings(spark: SparkSession, path: str, max_pages: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings of the board's search from its landed pages, row_ord by page and position; and (token, page_no, status) of each page.

    A page names itself by pageToken, the first by none, and the next by nextPageToken. The search ends at its first page
    without jobs, at ``max_pages``, or at a gap; pages beyond give no postings.
    """
    kind = f"struct<pageToken:string,nextPageToken:string,jobs:array<{readers.workable_global.item}>>"
    read = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("p")).select(F.lit("").alias("query"), F.coalesce("p.pageToken", F.lit("")).alias("token"), F.coalesce("p.nextPageToken", F.lit("")).alias("next_token"), F.coalesce("p.jobs", F.array().cast(f"array<{readers.workable_global.item}>")).alias("jobs"))
    order = page_order(spark, read.select("query", "token", "next_token")).drop("query")
    paged = read.join(order, "token").where("status = 'ok'")
    # the first page without jobs ends the search
    end = paged.where("size(jobs) = 0").agg(F.min("page_no").alias("end"))
    kept = paged.join(F.broadcast(end)).where("page_no < coalesce(end, page_no + 1)")
    kept = kept.where(F.col("page_no") < max_pages) if max_pages is not None else kept
    rows = kept.select("page_no", F.posexplode("jobs").alias("pos", "j")).select("page_no", "pos", "j.*")
    shaped = readers.workable_global.shape(rows.withColumn("file", F.lpad(F.col("page_no").cast("string"), 20, "0")).drop("page_no"))
    return shaped.withColumn("row_ord", scan.place(page=F.col("row_ord.file").cast("long"), pos=F.col("row_ord.pos"))), order
