"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman scores the passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, mix64, pieces, text_bytes, word_hashes

#: Words of a seed, distinct seeds that make a candidate, similarity from which a passage counts as a copy.
SEED_WORDS, SEEDS, SIMILARITY = 3, 2, 0.45
#: Words' worth of an alignment, net of its edits, that counts as a copy of a part, however long the item.
LONG = 20
#: Alignment: gain of equal words, cost of a different word and of a word too many.
MATCH, MISMATCH, GAP = 2.0, 1.0, 1.0
#: Places of the filter of seeds that every task holds: 16 a seed, a power of two between 4 and 16 million (2 MB sent, 16 MB held). Beyond a
#: million seeds its chance hits grow, and with them the passages that are looked at, not the result.
_LEAST_PLACES, _MOST_PLACES, _PLACES_A_SEED = 1 << 22, 1 << 24, 16

# A-Z to a-z; what is neither letter nor digit in ASCII to a blank
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words(data: bytes | None) -> np.ndarray:
    """Hashes of a text's words; case and punctuation in ASCII do not count."""
    return word_hashes(data.translate(_NORMAL).split() if data else [])


def seeds(h: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """Hashes of the n-grams of a sequence of words."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = mix64(out * GOLDEN + h[i : i + m])
    return out


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [words(t) for t in text_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(x) for x in h], pa.int32()), pa.array([x.tobytes() for x in h], pa.binary()), pa.array([np.unique(seeds(x)).view(np.int64) for x in h], pa.list_(pa.int64()))],
            ["item_id", "n_words", "words", "seeds"],
        )


def _places(s: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each seed in a filter of ``n``."""
    return s % np.uint64(n), (s >> np.uint64(32)) % np.uint64(n)


def _set_places(n: int):
    """Seeds to the places that they set in the filter, distinct in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_places(batch.column(0).to_numpy().view(np.uint64), n))).astype(np.int32))], ["place"])

    return run


def _filter_of(seeds: DataFrame) -> np.ndarray:
    """The filter of a column of seeds as packed bits; the driver gets at most _MOST_PLACES numbers."""
    n = min(_MOST_PLACES, max(_LEAST_PLACES, 1 << (_PLACES_A_SEED * max(1, seeds.count()) - 1).bit_length()))
    bits = np.zeros(n, bool)
    bits[seeds.mapInArrow(_set_places(n), "place int").distinct().toPandas()["place"].to_numpy()] = True
    return np.packbits(bits)


def _passages(packed: np.ndarray, longest: int, least: int):
    """(doc_id, text) to passages around seeds: doc_id, first word, a 128-bit digest, the words' hashes, the seeds found.

    Seeds of the filter, the odd chance hit included, that stand within ``longest`` words of each
    other form a passage, which reaches that many words further on both sides. A passage with
    fewer than ``least`` distinct seeds can make no candidate and is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.unpackbits(packed).view(bool)
        for batch in pieces(batches, "text"):
            ids, start, key, passage, found = [], [], [], [], []
            for d, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                h = words(t)
                s = seeds(h)
                first, second = _places(s, len(filter_))
                at = np.flatnonzero(filter_[first])
                at = at[filter_[second[at]]]
                if not len(at):
                    continue
                for group in np.split(at, np.flatnonzero(np.diff(at) > longest) + 1):
                    own = np.unique(s[group])
                    if len(own) < least:
                        continue
                    lo, hi = max(0, group[0] - longest), min(len(h), group[-1] + SEED_WORDS + longest)
                    ids.append(d)
                    start.append(lo)
                    passage.append(h[lo:hi].tobytes())
                    key.append(xxhash.xxh3_128_digest(passage[-1]))
                    found.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start, pa.int64()), pa.array(key, pa.binary()), pa.array(passage, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "start", "key", "passage", "seeds"])

    return run


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman score of each item within its passage, and the passage's word after the alignment's last."""
    n, rows, cols = len(items), max(map(len, items), default=0), max(map(len, passages), default=0)
    a, b = np.zeros((n, rows), np.uint64), np.zeros((n, cols), np.uint64)
    real_a, real_b = np.zeros((n, rows), bool), np.zeros((n, cols), bool)
    for i, (x, y) in enumerate(zip(items, passages, strict=True)):
        a[i, : len(x)], real_a[i, : len(x)] = x, True
        b[i, : len(y)], real_b[i, : len(y)] = y, True
    h = np.zeros((n, cols + 1), np.float32)
    ramp = (GAP * np.arange(cols + 1)).astype(np.float32)
    best, end = np.zeros(n, np.float32), np.zeros(n, np.int64)
    for r in range(rows):
        equal = (a[:, r : r + 1] == b) & real_b & real_a[:, r : r + 1]
        t = np.maximum(h - np.float32(GAP), 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(equal, MATCH, -MISMATCH).astype(np.float32))
        h = np.maximum.accumulate(t + ramp, axis=1) - ramp  # words of the passage that the item lacks
        at = h.argmax(axis=1)
        top = h[np.arange(n), at]
        better = (top > best) & real_a[:, r]
        best, end = np.where(better, top, best), np.where(better, at, end)
    return best, end


def _align(similarity: float):
    """Pairs of a passage and an item to their score, if it reaches ``similarity`` or is worth LONG words, and the passage's words up to the copy's end.

    No alignment matches more words of an item than those that stand anywhere in the passage: where
    these reach neither, nothing is aligned and nothing lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = [np.frombuffer(x, np.uint64) for x in batch.column(3).to_pylist()]
            passage = [np.frombuffer(x, np.uint64) for x in batch.column(4).to_pylist()]
            able = [i for i in range(len(item)) if np.isin(item[i], passage[i]).sum() >= min(LONG, similarity * len(item[i]))]
            order = sorted(able, key=lambda i: (len(passage[i]), len(item[i])))
            score, end, long = np.zeros(len(item)), np.zeros(len(item), np.int64), np.zeros(len(item), bool)
            at = 0
            while at < len(order):  # about four million cells at once
                n = max(1, min(len(order) - at, 4_000_000 // max(1, len(passage[order[min(len(order) - 1, at + 255)]]) * 16), 256))
                ids = order[at : at + n]
                s, e = align([item[i] for i in ids], [passage[i] for i in ids])
                score[ids] = s / [MATCH * max(1, len(item[i])) for i in ids]
                end[ids], long[ids] = e, s >= MATCH * LONG
                at += n
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(score), pa.array(end)], ["key", "item", "n_seeds", "score", "end"])
            yield out.filter(pa.array(long | (score >= similarity)))

    return run


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_seeds, score, end_word): the documents that hold a copy of a test item.

    score is the best local alignment's share of the item's own score against itself, 1 for a
    verbatim copy; end_word counts the document's words up to the copy's end. Paraphrased copies
    match as long as SEEDS seeds of SEED_WORDS words survive and the alignment reaches ``similarity``.
    A part of a long item, whose share is less, matches if its alignment is worth LONG equal words after
    the cost of its edits.

    1. A task scans its documents once, with a fixed-size filter of all seeds, and emits only the
       passages around seeds; the documents' text is not shuffled.
    2. Equal passages are collapsed, so that what is copied with its surroundings is aligned once.
    3. All passages and items that share SEEDS seeds (all, if the item has fewer) are aligned, and the scores join
       the documents. They meet in rare seeds only: an item's seeds are ordered by the number of passages that hold
       them, and its SEEDS - 1 commonest are not joined, as whoever shares SEEDS of its seeds shares
       one of the others. So a phrase that all have costs no pairs unless a second, rarer seed is shared too, and a
       document's result depends neither on the other documents nor on their number.

    Edge cases: null and empty texts, and items of fewer than SEED_WORDS words, match nothing. Items
    with equal words are aligned once and reported each. Rows with a null doc_id are not reported,
    repeated rows once. Extra columns are ignored; an empty table on either side gives no rows.
    """
    scratch = Scratch(spark, "decontaminate")
    items = scratch.keep(
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_of_items, "item_id long, n_words int, words binary, seeds array<long>").where(f"n_words >= {SEED_WORDS} and item_id is not null"), "items"
    )
    one = items.groupBy("words").agg(F.min("item_id").alias("item"), F.first("seeds").alias("seeds"), F.first("n_words").alias("n_words"))
    one = scratch.keep(one, "distinct-items")
    of_item = one.select("item", F.explode("seeds").alias("seed"))
    packed = _filter_of(of_item.select("seed").distinct())
    longest, least = one.agg(F.max("n_words"), F.min(F.size("seeds"))).first()
    if longest is None:
        longest, least = 1, 1

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    found = scratch.keep(text.mapInArrow(_passages(packed, longest, min(SEEDS, least)), "doc_id long, start long, key binary, passage binary, seeds array<long>"), "passages")
    passages = scratch.keep(found.groupBy("key").agg(F.first("passage").alias("passage"), F.first("seeds").alias("seeds")), "distinct-passages")
    held = passages.select("key", F.explode("seeds").alias("seed"))
    common = scratch.keep(of_item.join(held.groupBy("seed").agg(F.count("*").alias("df")), "seed", "left").fillna(0, ["df"]), "frequencies")
    listed = common.groupBy("item").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "seed"))), lambda x: x["seed"]).alias("by_df"))  # one item's seeds
    rare = scratch.keep(listed.select("item", F.explode(F.slice("by_df", 1, F.size("by_df") - F.least(F.lit(SEEDS), F.size("by_df")) + 1)).alias("seed")), "rare-seeds")
    pairs = held.join(rare, "seed").select("key", "item").distinct()
    pairs = pairs.join(one.select("item", "words", F.col("seeds").alias("own")), "item").join(passages.select("key", "passage", "seeds"), "key")
    pairs = pairs.withColumn("n_seeds", F.size(F.array_intersect("seeds", "own")).cast("long")).where(F.col("n_seeds") >= F.least(F.lit(SEEDS), F.size("own")))
    aligned = pairs.select("key", "item", "n_seeds", "words", "passage").mapInArrow(_align(similarity), "key binary, item long, n_seeds long, score double, end long")
    copies = found.select("key", "doc_id", "start").join(aligned, "key").withColumn("end_word", F.col("start") + F.col("end"))
    best = copies.groupBy("doc_id", "item").agg(F.max(F.struct("score", "n_seeds", "end_word")).alias("b"))
    twins = items.join(one.select("words", "item"), "words").select("item", "item_id").distinct()
    return best.join(twins, "item").select("doc_id", "item_id", "b.n_seeds", "b.score", "b.end_word")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that hold a copy of a test item; rows with a null doc_id stay."""
    bad = Scratch(spark, "contaminated").keep(contamination(spark, docs, benchmark, similarity=similarity).select("doc_id").distinct())
    return docs.join(bad, "doc_id", "left_anti").select(docs.columns)
