"""Mixing sources to target weights: temperature by section search, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .sharding import running_sum

#: Most repetitions of a document, for the query and for the pipeline; documents of a block.
REPEATS, PIPELINE_REPEATS, BLOCK_DOCS = 2.0, 1.25, 1000
#: Sections that a round of the search cuts its interval into, and rounds: the interval shrinks by both's power, 2**-25.
SECTIONS, ROUNDS = 32, 5


def n_tokens() -> Column:
    """Tokens of a text for the purpose of weights: runs of anything but blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _source() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def solve_exponent(stats: DataFrame, *, max_repeats: float | None = None, min_entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent from 0 (even weights) to 1 (natural shares) that meets a limit, by repeated sectioning of the interval.

    With ``max_repeats``, the least exponent under which no source is repeated more often than that
    (relative to the source repeated least, or to ``budget`` tokens in all); with ``min_entropy`` (in
    nats), the greatest under which the weights' entropy is at least that. Both are monotone in the
    exponent. A round is one aggregation over sources and sections; the driver sees its few sums.
    """
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("one of max_repeats and min_entropy is needed")
    p = stats.where("tokens > 0").select((F.col("tokens") / F.lit(float(stats.agg(F.sum("tokens")).first()[0] or 1))).alias("p"), "tokens")
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(SECTIONS)))).withColumn("t", F.lit(lo) + F.col("i") * F.lit((hi - lo) / SECTIONS))
        w = F.pow("p", F.col("t"))
        ratio = F.pow("p", F.col("t") - 1)  # proportional to the repetitions of a source
        sums = grid.groupBy("i", "t").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("wl"), F.max(ratio).alias("most"), F.min(ratio).alias("least"), F.sum("tokens").alias("all"))
        rows = sorted(sums.collect(), key=lambda r: r["i"])
        if not rows:
            return 1.0
        if max_repeats is not None:
            ok = [r["most"] / r["least"] <= max_repeats if budget is None else r["most"] / r["z"] * budget / r["all"] <= max_repeats for r in rows]
            i = next((r["i"] for r, good in zip(rows, ok, strict=True) if good), SECTIONS)  # the first that is good
            lo, hi = rows[max(0, i - 1)]["t"], rows[i]["t"]
        else:
            ok = [math.log(r["z"]) - r["wl"] / r["z"] >= min_entropy for r in rows]
            i = max((r["i"] for r, good in zip(rows, ok, strict=True) if good), default=0)  # the last that is good
            lo, hi = rows[i]["t"], rows[min(SECTIONS, i + 1)]["t"]
        if lo == hi:
            break
    return hi if max_repeats is not None else lo


def source_budgets(stats: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """(src, tokens, docs, weight, budget): each source's normalised weight and its tokens to draw.

    Without a total ``budget`` the least one is taken under which every document is drawn at least once.
    """
    powered = stats.where("tokens > 0").withColumn("w", F.pow(F.col("tokens").cast("double") / F.lit(float(stats.agg(F.sum("tokens")).first()[0] or 1)), F.lit(exponent)))
    total = powered.agg(F.sum("w").alias("z"), F.max(F.col("tokens") / F.col("w")).alias("cover"))
    z, cover = total.first()
    if not z:
        return stats.withColumn("weight", F.lit(0.0)).withColumn("budget", F.lit(0).cast("long"))
    whole = cover * z if budget is None else budget
    return powered.select("src", "tokens", "docs", (F.col("w") / z).alias("weight"), F.round(F.col("w") / z * whole).cast("long").alias("budget"))


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_tokens and mix_nth instead of other columns named mix_*: what :func:`mix` takes once it is written, so that texts are read once.

    mix_nth tells rows without an id apart.
    """
    return docs.select([c for c in docs.columns if not c.startswith("mix_")]).withColumns({"mix_tokens": n_tokens(), "mix_nth": F.monotonically_increasing_id()})


def mix(spark: SparkSession, docs: DataFrame, *, max_repeats: float | None = REPEATS, min_entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The documents of :func:`counted` (doc_id, source, mix_tokens, ...) drawn to their sources' weights, with mix_epoch and mix_offset.

    Every source is read in whole epochs and a part of one more, until its budget is full. In each
    epoch its documents fall by hash into blocks of about BLOCK_DOCS; blocks come in a permuted
    order, and so do the documents of a block. mix_offset is the number of the source's tokens that
    come before: sorting by mix_offset over the source's budget interleaves the sources.

    Running sums are taken within blocks, over bins of blocks and over the bins' sums, so a source
    with a third of all documents is spread like any other. ``docs`` is read several times: give a
    written table.

    Edge cases: a null source counts as the source named by the empty string. Texts without tokens,
    null ones included, are drawn once, in epoch 1. Null ids and repeated rows are drawn like other
    rows, each apart. An empty table gives no rows.
    """
    scratch = Scratch(spark, "mix")
    stats = scratch.keep(docs.groupBy(_source().alias("src")).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    exponent = solve_exponent(stats, max_repeats=max_repeats, min_entropy=min_entropy, budget=budget)
    budgets = source_budgets(stats, exponent, budget).select(F.col("src").alias("mix_src"), F.col("tokens").alias("mix_all"), F.col("budget").alias("mix_budget"), F.ceil(F.col("docs") / BLOCK_DOCS).alias("mix_blocks"))
    rows = docs.withColumn("mix_src", _source())
    rows = rows.join(budgets, "mix_src", "left").withColumns({"mix_all": F.coalesce("mix_all", F.lit(1)), "mix_budget": F.coalesce("mix_budget", F.lit(0)), "mix_blocks": F.coalesce("mix_blocks", F.lit(1))})
    epochs = F.when(F.col("mix_tokens") > 0, F.ceil(F.col("mix_budget") / F.col("mix_all"))).otherwise(F.lit(1))
    rows = rows.where((F.col("mix_tokens") == 0) | (F.col("mix_budget") > 0)).withColumn("mix_epoch", F.explode(F.sequence(F.lit(1).cast("long"), epochs.cast("long"))))
    # rows without an id are told apart by their place, rows of one id by their tokens: neither makes a block of many
    own = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("mix_nth").cast("string")))
    rows = rows.withColumn("mix_key", F.md5(F.concat_ws("-", own, F.col("mix_epoch").cast("string"), F.col("mix_tokens").cast("string"))))
    rows = rows.withColumn("mix_block", F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("long") % F.col("mix_blocks"))

    unit = ["mix_src", "mix_epoch", "mix_block"]
    blocks = rows.groupBy(*unit).agg(F.sum("mix_tokens").alias("mix_sum"))
    blocks = blocks.withColumn("mix_turn", F.md5(F.concat_ws("-", "mix_src", F.col("mix_epoch").cast("string"), F.col("mix_block").cast("string"))))
    blocks = running_sum(blocks, ["mix_src", "mix_epoch"], F.substring("mix_turn", 1, 3), ["mix_turn", "mix_block"], "mix_sum", "mix_start")
    starts = scratch.keep(blocks.select(*unit, "mix_start"), "blocks")
    within = Window.partitionBy(*unit).orderBy("mix_key", "doc_id", "mix_nth").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(starts, unit).withColumn("mix_offset", (F.col("mix_epoch") - 1) * F.col("mix_all") + F.col("mix_start") + F.coalesce(F.sum("mix_tokens").over(within), F.lit(0)))
    drawn = placed.where((F.col("mix_tokens") == 0) | (F.col("mix_offset") + F.col("mix_tokens") <= F.col("mix_budget")) | (F.col("mix_epoch") * F.col("mix_all") <= F.col("mix_budget")))
    return drawn.select(*docs.columns, "mix_epoch", "mix_offset").drop("mix_nth")


def mixing_stage(spark: SparkSession, docs: DataFrame, *, max_repeats: float = PIPELINE_REPEATS) -> DataFrame:
    """``docs`` with rows repeated to their sources' weights: every document stays, none oftener than ``max_repeats`` on a source's average.

    Columns of ``docs`` named mix_* are kept under their names. An empty table gives none.
    """
    # under names that nothing else has: a prefix longer than any name
    free = "kept" + "_" * max(map(len, docs.columns))
    own = {c: f"{free}{i}" for i, c in enumerate(docs.columns) if c.startswith("mix_")}
    table = Scratch(spark, "mixing").keep(counted(docs.withColumnsRenamed(own)), "counted")
    return mix(spark, table, max_repeats=max_repeats).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def _oracle() -> str:
    rounds = ["b0 AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi)"]
    for r in range(ROUNDS):
        rounds.append(
            f"""g{r} AS (SELECT i, lo + i * ((hi - lo) / {SECTIONS}) AS t, max(pow(p, lo + i * ((hi - lo) / {SECTIONS}) - 1)) / min(pow(p, lo + i * ((hi - lo) / {SECTIONS}) - 1)) <= {REPEATS} AS ok
  FROM b{r}, range({SECTIONS + 1}) x(i), p GROUP BY ALL),
c{r} AS (SELECT coalesce(min(i) FILTER (ok), {SECTIONS}) AS i FROM g{r}),
b{r + 1} AS (SELECT (SELECT t FROM g{r} WHERE g{r}.i = greatest(c{r}.i - 1, 0)) AS lo, (SELECT t FROM g{r} WHERE g{r}.i = c{r}.i) AS hi FROM c{r})"""
        )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS nth, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS docs FROM d GROUP BY 1),
p AS (SELECT source, tokens, docs, tokens::DOUBLE / (SELECT sum(tokens) FROM s)::DOUBLE AS p FROM s WHERE tokens > 0),
{', '.join(rounds)},
w AS (SELECT *, pow(p, (SELECT hi FROM b{ROUNDS})) AS w FROM p),
u AS (SELECT source, tokens, docs, round(w / (SELECT sum(w) FROM w) * ((SELECT max(tokens / w) FROM w) * (SELECT sum(w) FROM w)))::BIGINT AS budget FROM w),
r AS (SELECT d.*, coalesce(tokens, 1) AS tokens, coalesce(budget, 0) AS budget, coalesce(ceil(docs / {BLOCK_DOCS}), 1)::BIGINT AS blocks FROM d LEFT JOIN u USING (source)),
e AS (SELECT *, unnest(range(1, CASE WHEN n > 0 THEN ceil(budget / tokens)::BIGINT ELSE 1 END + 1)) AS epoch FROM r),
k AS (SELECT *, md5(coalesce(doc_id::VARCHAR, 'row ' || nth) || '-' || epoch || '-' || n) AS key FROM e),
l AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % blocks AS block FROM k),
m AS (SELECT *, md5(source || '-' || epoch || '-' || block) AS turn FROM l),
o AS (SELECT *, (epoch - 1) * tokens + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY turn, block, key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT doc_id, source, epoch::BIGINT AS epoch, n AS n_tokens, before::BIGINT AS offset_tokens FROM o
WHERE n = 0 OR before + n <= budget OR epoch * tokens <= budget
"""


ORACLE = _oracle()
