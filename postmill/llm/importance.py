"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, pieces, text_bytes

#: Buckets of hashed word unigrams and bigrams, additive smoothing, share of the documents that is drawn.
BUCKETS, SMOOTH, KEEP_SHARE, SEED = 1 << 14, 1.0, 0.8, 11
#: Bound of the labelled sample that stands for the target distribution.
TARGET_DOCS = 10_000
#: Bins of a histogram round, and rows of a bin from which the threshold is read off.
_BINS, _FEW = 4096, 50_000


def buckets(data: bytes | None) -> np.ndarray:
    """The bucket of every word and every pair of neighbours; words are runs of non-blanks, A-Z lower-cased."""
    words = data.lower().split() if data else []
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    both = (h[:-1] * np.uint32(0x9E3779B1)) ^ (h[1:] * np.uint32(0x85EBCA77) + np.uint32(1))
    both ^= both >> np.uint32(15)
    return np.concatenate([h, both]) % np.uint32(BUCKETS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(target, text) to (bucket, raw, target), summed over what the task has read."""
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in pieces(batches, "text"):
        target = np.array(batch.column(0).to_pylist(), bool)
        each = [buckets(t) for t in text_bytes(batch.column(1))]
        total[0] += np.bincount(np.concatenate(each), minlength=BUCKETS)
        if target.any():
            total[1] += np.bincount(np.concatenate([each[i] for i in np.flatnonzero(target)]), minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], ["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability of each bucket; zeros without a target document.

    The raw model counts all of ``docs``. The target model counts a bounded sample, drawn by the
    hash of the id: about TARGET_DOCS documents that ``labels`` gives quality 1.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    n = good.count()
    sample = good.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < min(1.0, TARGET_DOCS / max(1, n)) * 1_000_000)
    marked = docs.select("doc_id", "text").join(F.broadcast(sample.withColumn("target", F.lit(True))), "doc_id", "left")
    counts = (
        marked.select(F.coalesce("target", F.lit(False)).alias("target"), "text")
        .mapInArrow(_count, "bucket int, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        .toPandas()
    )
    total = np.zeros((2, BUCKETS))
    total[:, counts["bucket"]] = counts[["raw", "target"]].to_numpy().T
    if not total[1].sum():
        return np.zeros(BUCKETS)
    p = (total + SMOOTH) / (total.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)
    return np.log(p[1] / p[0])


def _weigh(ratios: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            each = [buckets(t) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(b) for b in each], pa.int64()), pa.array([float(ratios[b].sum()) for b in each])],
                ["doc_id", "n_grams", "log_weight"],
            )

    return run


def _ordinal(x: float) -> int:
    """The place of a finite float64 among all of them in order."""
    n = int(np.float64(x + 0.0).view(np.int64))
    return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """Exactly the k-th largest value of a finite column; None if there are fewer.

    Histograms narrow the range it lies in, so that only a bounded number of counts and at most
    _FEW rows are ever ordered or sent to the driver, whatever the size of ``df``. A range that
    holds no more than _BINS different floats is counted value by value.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if k < 1 or n < k:
        return None
    above = 0  # rows over hi
    while hi > lo and n > _FEW:
        inside, fine = df.where(F.col(column).between(lo, hi)), _ordinal(hi) - _ordinal(lo) <= _BINS
        width = (hi - lo) / _BINS
        b = F.col(column) if fine else F.least(F.floor((F.col(column) - lo) / width), F.lit(_BINS - 1))
        # each bin's own least and largest values, so that rounding of its edges doesn't matter
        found = sorted(inside.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect(), key=lambda r: -r["bin"])
        for r in found:
            if above + r["n"] >= k:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            above += r["n"]
    if hi <= lo:
        return hi
    return df.where(F.col(column).between(lo, hi)).select(column).orderBy(F.desc(column)).limit(k - above).agg(F.min(column)).first()[0]


def importance_resample(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, keep_share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, n_grams, log_weight, sampling_key and selected for every row of ``docs`` (doc_id, text).

    log_weight is the logarithm of a document's importance weight, the ratio of the target's to the
    raw model's probability of its n-grams. With a Gumbel variable drawn from its id added, the
    ``keep_share`` of the rows with the highest keys is a sample without replacement in proportion
    to the weights.

    Edge cases: null and empty texts have no n-grams and weight 0. Without target documents all
    weights are 0 and the draw is uniform. Rows whose key ties with the last one drawn are all
    selected, so repeated rows share their fate. A null doc_id draws as one more id. Extra columns
    are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "importance")
    ratios = log_ratios(docs, labels)
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_weigh(ratios), "doc_id long, n_grams long, log_weight double")
    u = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    key = F.col("log_weight") - F.log(-F.log(u))
    keyed = scratch.keep(weighed.withColumn("sampling_key", key), "keyed")
    last = kth_largest(keyed, "sampling_key", round(keep_share * keyed.count()))
    return keyed.withColumn("selected", F.col("sampling_key") >= last if last is not None else F.lit(False))
