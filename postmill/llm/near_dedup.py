"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GOLDEN, Scratch, fresh, golden, mix64, pieces, text_bytes, word_hashes
from .components import connected_components

#: Slots of a signature, rows of a band, and bits of each slot kept for estimates.
SLOTS, ROWS, PLANES = 128, 4, 4
#: Bits of a set's parity sketch: equal parities of its elements' places.
PARITY = 1024
#: Nodes of a mixed bucket that one task compares with all of it.
ROOM = 512
#: A link at the threshold is missed by banding with at most this probability.
MISS = 1e-5

_DENSE_FROM = 6


def bands_for(similarity: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave at most ``miss`` for a pair at the threshold to share none; ValueError if a signature has fewer."""
    bands = max(1, math.ceil(math.log(miss) / math.log(1 - similarity**rows))) if similarity < 1 else 1
    if bands > SLOTS // rows:
        raise ValueError(f"a similarity of {similarity} needs {bands} bands of {rows} slots; a signature of {SLOTS} has {SLOTS // rows}")
    return bands


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles.

    A-Z is lower-cased; words are runs of anything but space and \\t-\\r. With fewer than ``size``
    words the whole sequence is one shingle; without words or text there is none.
    """
    words = data.lower().split() if data else []
    if not words:
        return np.empty(0, np.uint64)
    h, n = word_hashes(words), min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * GOLDEN + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures of ``n_sets`` sets at once, one row each.

    ``elements`` holds the sets' hashes one set after another and ``owner`` the index of each one's
    set; no set may be empty. Element by element a random permutation of the slots is drawn by a
    Fisher-Yates shuffle; the j-th slot drawn gets j plus a uniform number if that is less than
    what it has. Drawing runs in step for all elements, and a set stops as soon as no slot of it
    can still go down, which is after a few draws for all but small sets.
    """
    h = np.full(n_sets * slots, np.inf)
    base, x = owner.astype(np.int64) * slots, elements
    drawn: list[tuple[np.ndarray, np.ndarray]] = []  # of each draw so far: the place swapped, and what came there
    order = None
    for j in range(slots):
        u = mix64(x + golden(j + 1))
        r = (u >> np.uint64(40)).astype(np.float64) * 2.0**-24
        k = j + (((u & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot, moved = k.copy(), np.full(len(x), j, np.int64)
            for place, came in drawn:
                slot = np.where(place == k, came, slot)
                moved = np.where(place == j, came, moved)
            drawn.append((k, moved))
        else:
            rows = np.arange(len(x))
            slot, moved = order[rows, k].astype(np.int64), order[:, j].copy()
            order[rows, k] = moved
        np.minimum.at(h, base + slot, j + r)
        open_ = h.reshape(n_sets, slots).max(axis=1) >= j + 1
        if not open_.any():
            break
        keep = open_[owner]
        if keep.mean() < 0.8:
            owner, base, x = owner[keep], base[keep], x[keep]
            drawn = [(p[keep], c[keep]) for p, c in drawn]
            order = order[keep] if order is not None else None
        if order is None and j + 1 == _DENSE_FROM:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int64), (len(x), 1))
            rows = np.arange(len(x))
            for place, came in drawn:
                order[rows, place] = came
            drawn = []
    return h.reshape(n_sets, slots)


def _longs(rows: np.ndarray) -> pa.ListArray:
    flat = np.ascontiguousarray(rows).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(flat.ravel()))


def _sign(size: int, bands: int):
    """A mapInArrow function: (id, text) to set size, fingerprint of the set, band keys, bit planes of the signature, parity sketch."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in text_bytes(batch.column(1))]
        n = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(n)
        fp = np.zeros((len(sets), 2), np.uint64)
        keys, planes = np.zeros((len(sets), bands), np.uint64), np.zeros((len(sets), PLANES * SLOTS // 64), np.uint64)
        parity = np.zeros((len(sets), PARITY // 64), np.uint64)
        if len(full):
            x = np.concatenate([sets[i] for i in full])
            starts = np.cumsum(n[full]) - n[full]
            for c in (0, 1):
                fp[full, c] = np.add.reduceat(mix64(x ^ golden(2 * c + 3)), starts)
            code = mix64(superminhash(x, np.repeat(np.arange(len(full)), n[full]), len(full)).view(np.uint64))
            for b in range(bands):
                key = np.full(len(full), b + 1, np.uint64)
                for i in range(b * ROWS, (b + 1) * ROWS):
                    key = mix64(key * GOLDEN + code[:, i])
                keys[full, b] = key
            bits = [np.packbits((code >> np.uint64(7 + p)).astype(np.uint8) & 1, axis=1, bitorder="little").view(np.uint64) for p in range(PLANES)]
            planes[full] = np.concatenate(bits, axis=1)
            bit = mix64(x ^ golden(9)) % np.uint64(PARITY)
            np.bitwise_xor.at(parity, (np.repeat(full, n[full]), (bit // np.uint64(64)).astype(np.int64)), np.uint64(1) << (bit % np.uint64(64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n), pa.array(fp[:, 0].view(np.int64)), pa.array(fp[:, 1].view(np.int64)), _longs(keys), _longs(planes), _longs(parity)],
            ["doc_id", "n_shingles", "fp_a", "fp_b", "bands", "planes", "parity"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            yield one(batch)

    return run


def _shared(size: int):
    """A mapInArrow function: (x, p, text_x, text_p) to the sizes of both sets and of their intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, None
        for batch in pieces(batches, "text_x"):
            out = []
            for x, p in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True):
                if of_last is None or p != last:
                    last, of_last = p, shingles(p, size)
                s = shingles(x, size)
                at = np.searchsorted(of_last, s)
                out.append((len(s), len(of_last), int((of_last[np.minimum(at, len(of_last) - 1)] == s).sum()) if len(of_last) and len(s) else 0))
            a = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(a[:, i]) for i in range(3))], ["x", "p", "n_x", "n_p", "both"])

    return run


def _estimate(a: str, b: str):
    """Similarity of two signatures by the slots whose kept bits agree, less chance agreement."""
    words = SLOTS // 64
    differ = None
    for w in range(words):
        mask = None
        for p in range(PLANES):
            d = F.col(a)[p * words + w].bitwiseXOR(F.col(b)[p * words + w])
            mask = d if mask is None else mask.bitwiseOR(d)
        differ = F.bit_count(mask) if differ is None else differ + F.bit_count(mask)
    chance = 2.0**-PLANES
    return (1 - differ / F.lit(float(SLOTS)) - chance) / (1 - chance)


def _differences(a: str, b: str):
    """A lower bound of how many elements stand in one of two sets only: the bits in which their parity sketches differ.

    Elements of both sets cancel out, so the bound is close while the sets' difference is small
    against PARITY, however large the sets are; it is never too high.
    """
    out = None
    for w in range(PARITY // 64):
        n = F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
        out = n if out is None else out + n
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their sets of word shingles is at least
    ``similarity`` (in hundredths, compared exactly in integers); component_id is the smallest
    doc_id reachable over links, and kept marks the document that bears it.

    1. Each text gets its set's size, a 128-bit fingerprint of the set, a SuperMinHash signature,
       band keys and some bits of the signature. Equal sets collapse into one node.
    2. In every bucket each node meets one pivot, the node with most copies. Of a node's pivots
       the one estimated closest is verified on full sets: linear in the rows of a bucket.
    3. Links so far are contracted. Only buckets that still hold two components are joined with
       themselves, on nodes of different components, whose sizes, parity sketches and estimates
       allow a link; those pairs are verified as well. The parity sketch bounds the sets' difference
       from below without error, and closely where it matters, so few pairs pass that are no links.
       A bucket of many nodes is dealt to as many tasks as its pairs need.
    4. Components come from alternating star contractions over the verified links.

    A pair just at the threshold shares no bucket with probability below 1e-5, and an estimate
    leaves out a linked pair with about the same (four standard deviations).

    Edge cases: null, empty and blank texts have an empty set, n_shingles 0, and are linked with
    nothing. A null doc_id is linked with nothing: component_id null, kept true. Rows that repeat
    a doc_id each get a row; they are one document, so different texts of theirs are linked. Other
    columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(spark, "near-dedup")
    percent, bands = round(similarity * 100), bands_for(similarity)
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>, planes array<long>, parity array<long>"
    signed = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sign(shingle_words, bands), schema), "signatures")

    named = signed.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.keep(named.groupBy("fp_a", "fp_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "classes")
    own = named.join(classes, ["fp_a", "fp_b", "n_shingles"])
    nodes = own.where("doc_id = rep").dropDuplicates(["fp_a", "fp_b", "n_shingles"])
    nodes = scratch.keep(nodes.select("rep", "copies", "n_shingles", "bands", "planes", "parity"), "nodes")
    # an id with several texts links their classes; such ids are few or none
    several = own.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("doc_id")
    same_id = own.select("doc_id", "rep").join(several, "doc_id").select(F.col("doc_id").alias("x"), F.col("rep").alias("p"))

    # 2. each bucket's pivot; buckets of one node are left out
    entries = nodes.select("rep", "copies", F.explode("bands").alias("key"))
    pivots = entries.groupBy("key").agg(F.max(F.struct("copies", "rep")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", F.col("top.rep").alias("p"))
    members = scratch.keep(entries.select("rep", "key").join(pivots, "key"), "members")
    sketch = nodes.select("rep", "n_shingles", "planes", "parity")
    met = members.where("rep <> p").select(F.col("rep").alias("x"), "p").distinct()
    met = met.join(sketch.select(F.col("rep").alias("x"), F.col("n_shingles").alias("n_x"), F.col("planes").alias("s_x")), "x")
    met = met.join(sketch.select(F.col("rep").alias("p"), F.col("n_shingles").alias("n_p"), F.col("planes").alias("s_p")), "p")
    margin = 4 * math.sqrt(similarity * (1 - similarity) / SLOTS)
    sizes_allow = F.least("n_x", "n_p") * 100 >= F.greatest("n_x", "n_p") * percent
    near = scratch.keep(met.withColumn("est", _estimate("s_x", "s_p")).where(F.col("est") >= 0.5).select("x", "p", "est", sizes_allow.alias("fits")), "near")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """(rep, text), all different texts of an id; hashed by id at any size, so that the plan does not change as ``ids`` grows."""
        found = docs.where("doc_id is not null").join(ids.hint("merge"), F.col("doc_id") == F.col("rep"))
        return scratch.keep(found.groupBy("rep", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")).drop("h"), name)

    texts = texts_of(near.select(F.col("x").alias("rep")).union(near.select("p")).distinct(), "texts")

    def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        both = pairs.join(texts.select(F.col("rep").alias("x"), F.col("text").alias("text_x")), "x")
        both = both.join(texts.select(F.col("rep").alias("p"), F.col("text").alias("text_p")), "p")
        both = both.select("x", "p", "text_x", "text_p").mapInArrow(_shared(shingle_words), "x long, p long, n_x long, n_p long, both long")
        return both.where(F.col("both") * 100 >= (F.col("n_x") + F.col("n_p") - F.col("both")) * percent).select("x", "p")

    first = near.where(F.col("fits") & (F.col("est") >= similarity - margin)).groupBy("x").agg(F.max(F.struct("est", "p")).alias("top")).select("x", F.col("top.p").alias("p"))
    links = scratch.keep(verified(first, texts).union(same_id), "links")
    stars = connected_components(spark, links, scratch)

    # 3. what stands in one bucket but not yet in one component
    where = members.join(stars, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = where.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.ceil(F.count("*") / ROOM).cast("int").alias("parts")).where("a <> b").select("key", "parts")
    rows = scratch.keep(where.join(mixed, "key").join(sketch, "rep"), "mixed")
    left, right = (rows.select("key", "parts", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "c", "n_shingles", "planes", "parity"))) for s in "xp")
    left = left.withColumn("part", F.pmod(F.xxhash64("rep_x"), F.col("parts")).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cross = (
        left.join(
            right,
            (left["key"] == right["key"])
            & (left["part"] == right["part"])
            & (F.col("rep_x") < F.col("rep_p"))
            & (F.col("c_x") != F.col("c_p"))
            & (F.least("n_shingles_x", "n_shingles_p") * 100 >= F.greatest("n_shingles_x", "n_shingles_p") * percent)
            & (_differences("parity_x", "parity_p") * (100 + percent) <= (F.col("n_shingles_x") + F.col("n_shingles_p")) * (100 - percent))
            & (_estimate("planes_x", "planes_p") >= similarity - margin),
        )
        .select(F.col("rep_x").alias("x"), F.col("rep_p").alias("p"))
        .distinct()
    )
    cross = scratch.keep(cross, "cross")
    missing = cross.select(F.col("x").alias("rep")).union(cross.select("p")).distinct().join(texts, "rep", "left_anti")
    if not missing.isEmpty():
        texts = texts.unionByName(texts_of(missing, "more-texts"))
    late = verified(cross, texts)
    label = lambda c: F.coalesce(F.col(f"c_{c}.component"), F.col(c))
    over = late.join(stars.alias("c_x"), F.col("x") == F.col("c_x.node"), "left").join(stars.alias("c_p"), F.col("p") == F.col("c_p.node"), "left")
    merged = connected_components(spark, over.select(label("x").alias("x"), label("p").alias("p")), scratch)

    alone = merged.select("node").join(stars.select("node"), "node", "left_anti")  # in no component before
    final = stars.select("node", "component").union(alone.select("node", F.col("node").alias("component")))
    final = final.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(F.col("node").alias("rep"), F.coalesce("top", "component").alias("component"))
    of_class = classes.join(final, "rep", "left").select("fp_a", "fp_b", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "fp_a", "fp_b").join(of_class, ["fp_a", "fp_b", "n_shingles"], "left")
    found = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def dedup_stage(spark: SparkSession, docs: DataFrame, *, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest doc_id.

    All columns of ``docs`` stay, whatever their names. An empty table gives none; empty and blank texts are copies of nothing. Of rows that repeat a kept doc_id with the same text one stays, those
    with different texts all do; rows whose doc_id is null all stay, as they belong to no group.
    """
    kept = near_duplicates(spark, docs, shingle_words=shingle_words, similarity=similarity).where("kept and doc_id is not null").select("doc_id").distinct()
    digest = fresh(docs, "__text")
    named = docs.withColumn(digest, F.xxhash64("text"))
    one = named.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", digest]).select(docs.columns)
    return one.unionByName(docs.where("doc_id is null"))
