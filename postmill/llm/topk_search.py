"""Exact top-k inner products: cover trees over queries and data, searched together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Results for a query, components of a block of vectors, and the fewest vectors of one.
K, BLOCK_CELLS, FEWEST = 10, 1 << 18, 64
#: Queries and data vectors of a leaf, children of a node.
QUERY_LEAF, DATA_LEAF, FAN = 64, 256, 8
#: Bounds of what the cells of the table are fitted on: rows, centres, and lengths of vectors that get any.
SAMPLE_ROWS, CENTRES, LENGTHS = 4096, 512, 16

_LEAST, _MOST = -(2**63), 2**63 - 1


def farthest_first(x: np.ndarray, most: int) -> np.ndarray:
    """Places of at most ``most`` rows, each the farthest from those before: every prefix is a coarser cover."""
    chosen, cover = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(chosen) < most and cover.max() > 0:
        chosen.append(int(cover.argmax()))
        cover = np.minimum(cover, np.sqrt(((x - x[chosen[-1]]) ** 2).sum(axis=1)))
    return np.array(chosen)


class CoverTree:
    """A cover tree over the rows of a matrix: nodes with a centre, a radius that covers them, and children whose radius is about half.

    Children's centres are chosen farthest first until they cover the node at half its radius, or
    there are FAN of them; radii are measured, so bounds hold in any case. Rows are reordered so
    that each node is a slice.
    """

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.leaf, self.order = x, leaf, np.arange(len(x))
        self.nodes: list[tuple[int, int, np.ndarray, float, float, list[int]]] = []  # from, to, centre, its norm, radius, children
        if len(x):
            self._grow(0, len(x))

    def _grow(self, lo: int, hi: int) -> int:
        x = self.x[self.order[lo:hi]]
        centre = x.mean(axis=0)
        d = np.sqrt(((x - centre) ** 2).sum(axis=1))
        radius, at = float(d.max()), len(self.nodes)
        self.nodes.append((lo, hi, centre, float(np.sqrt((centre**2).sum())), radius, []))
        if hi - lo <= self.leaf or radius == 0:
            return at
        centres, near, cover = 1, np.zeros(hi - lo, np.int64), np.sqrt(((x - x[0]) ** 2).sum(axis=1))
        while centres < FAN and (centres < 2 or cover.max() > radius / 2):
            e = np.sqrt(((x - x[cover.argmax()]) ** 2).sum(axis=1))
            near[e < cover] = centres
            cover = np.minimum(cover, e)
            centres += 1
        by = np.argsort(near, kind="stable")
        self.order[lo:hi] = self.order[lo:hi][by]
        ends = np.searchsorted(near[by], np.arange(centres + 1))
        if ends.max() == hi - lo and (np.diff(ends) == hi - lo).any():  # rounding tells no rows apart
            return at
        for i in range(centres):
            if ends[i] < ends[i + 1]:
                self.nodes[at][5].append(self._grow(lo + ends[i], lo + ends[i + 1]))
        return at


class Block:
    """Some vectors as doubles for bounds and products, and as whole numbers of any size where doubles do not hold the products.

    Components are floor(scale * x). Where that is beyond 2**400 all of the block are divided by a
    power of two, which doubles do without error.
    """

    def __init__(self, ids: np.ndarray, e: np.ndarray, counts: np.ndarray, scale: int, leaf: int):
        self.scale, self.shift = scale, 0
        top = float(np.abs(e).max()) if e.size else 0.0
        if top > 2.0**400:
            self.shift = int(math.frexp(top)[1]) - 300
            small = np.abs(e) < 2.0**400
            x = np.where(small, np.ldexp(np.floor(np.where(small, e, 0) * scale), -self.shift), np.ldexp(e, -self.shift) * scale)
        else:
            x = np.floor(e * scale)
        self.most = float(np.abs(x).max()) if x.size else 0.0
        self.tree = CoverTree(x, leaf)
        o = self.tree.order
        self.ids, self.x, self.e, self.counts = ids[o], x[o], e[o], counts[o]
        self.norms = np.sqrt((self.x**2).sum(axis=1))
        self._whole: dict[int, list[int]] = {}

    def whole(self, i: int) -> list[int]:
        """A vector's components as Python integers."""
        if i not in self._whole:
            self._whole[i] = [math.floor(v * self.scale) if abs(v) < 2.0**400 else int(v) * self.scale for v in self.e[i].tolist()]
        return self._whole[i]


def _fewest(ids: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """Places of those rows that can be among anyone's k best: of equal vectors the k + 1 with the smallest ids. An id and vector stand together once, with a count."""
    _, which = np.unique(e, axis=0, return_inverse=True) if e.shape[1] else (None, np.zeros(len(e), np.int64))
    by = np.lexsort((ids, which.ravel()))
    w = which.ravel()[by]
    return by[np.arange(len(w)) - np.searchsorted(w, w, side="left") <= k]


def _pairs(q: Block, r: Block, worst: np.ndarray, slack: float, visit) -> None:
    """Visit the pairs of leaves in which a product may reach the worst k-th score of the query node, most promising first.

    |q.r - c.d| <= R|d| + S|c| + RS for centres c, d and radii R, S; ``slack`` covers rounding.
    """
    qt, rt = q.tree.nodes, r.tree.nodes

    def bound(a: int, b: int) -> float:
        _, _, c, c_norm, big, _ = qt[a]
        _, _, d, d_norm, small, _ = rt[b]
        return float(c @ d) + big * d_norm + small * c_norm + big * small + slack * (c_norm + big) * (d_norm + small)

    stack = [(bound(0, 0), 0, 0)] if qt and rt else []
    while stack:
        top, a, b = stack.pop()
        qlo, qhi, _, _, q_radius, q_kids = qt[a]
        rlo, rhi, _, _, r_radius, r_kids = rt[b]
        if top < worst[qlo:qhi].min():
            continue
        if not q_kids and not r_kids:
            visit(qlo, qhi, rlo, rhi)
        elif q_kids and (not r_kids or q_radius > r_radius):
            stack += sorted((bound(c, b), c, b) for c in q_kids)
        else:
            stack += sorted((bound(a, c), a, c) for c in r_kids)


def search(q: Block, r: Block, floors: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """(query id, id, score, count) of each query's k best among the rows of ``r`` that have another id and reach its floor.

    Where doubles hold all products exactly, one search is all. Else the first search keeps lower
    bounds of the k best scores, a second gathers all that may reach them, and those few are
    multiplied as whole numbers.
    """
    dim = q.x.shape[1]
    exact = not q.shift and not r.shift and dim * q.most * r.most < 2.0**53
    error = 0.0 if exact else (dim + 8) * 2.0**-52
    slack = (dim + 8) * 2.0**-50
    order = q.tree.order
    low = np.ldexp(floors[order], -(q.shift + r.shift))  # -inf where there is none
    low = np.where(np.isneginf(low), low, low - np.abs(low) * 2.0**-40)
    score = np.full((len(q.ids), k), -np.inf)
    found = np.full((len(q.ids), k), -1)
    worst = low.copy()

    def products(qlo: int, qhi: int, rlo: int, rhi: int) -> tuple[np.ndarray, np.ndarray | float]:
        s = q.x[qlo:qhi] @ r.x[rlo:rhi].T
        s[q.ids[qlo:qhi, None] == r.ids[rlo:rhi]] = -np.inf
        return s, error * q.norms[qlo:qhi, None] * r.norms[rlo:rhi] if error else 0.0

    def keep(qlo: int, qhi: int, rlo: int, rhi: int) -> None:
        s, e = products(qlo, qhi, rlo, rhi)
        s = s - e
        good = (s >= worst[qlo:qhi, None]) & (s > -np.inf)
        for i in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[i])
            all_s, all_i = np.concatenate([score[qlo + i], s[i, at]]), np.concatenate([found[qlo + i], at + rlo])
            best = np.lexsort((np.where(all_i < 0, _MOST, r.ids[all_i]), -all_s))[:k]
            score[qlo + i], found[qlo + i] = all_s[best], all_i[best]
            worst[qlo + i] = max(worst[qlo + i], all_s[best[-1]])

    _pairs(q, r, worst, slack, keep)
    if exact:
        a, b = np.nonzero(found >= 0)
        return list(zip(q.ids[a].tolist(), r.ids[found[a, b]].tolist(), score[a, b].astype(np.int64).tolist(), r.counts[found[a, b]].tolist(), strict=True))

    able: list[tuple[int, int]] = []

    def gather(qlo: int, qhi: int, rlo: int, rhi: int) -> None:
        s, e = products(qlo, qhi, rlo, rhi)
        a, b = np.nonzero((s + e >= worst[qlo:qhi, None]) & (s > -np.inf))
        able.extend(zip((a + qlo).tolist(), (b + rlo).tolist(), strict=True))

    _pairs(q, r, worst, slack, gather)
    best: dict[int, list[tuple[int, int, int]]] = {}
    for i, j in able:
        best.setdefault(i, []).append((-sum(map(int.__mul__, q.whole(i), r.whole(j))), int(r.ids[j]), int(r.counts[j])))
    return [(int(q.ids[i]), j, -s, n) for i, own in best.items() for s, j, n in sorted(own)[:k]]


def _order_key(score: int) -> bytes:
    """Nothing for a score that a long holds; else bytes by which larger scores come later."""
    if _LEAST <= score <= _MOST:
        return b""
    size = (abs(score).bit_length() + 7) // 8
    key = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return key if score > 0 else bytes(255 - c for c in key)


def _cells(centres: dict[int, np.ndarray], coarse: dict[int, int]):
    """(vec_id, e, n, dim, asked) with the nearest centre of the row's length: of all for the data, of the first few for the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(3).to_pylist(), np.int64)
            cell, group = np.zeros(len(dims), np.int32), np.zeros(len(dims), np.int32)
            e = batch.column(1)
            for d in set(dims.tolist()) & centres.keys():
                at, c = np.flatnonzero(dims == d), centres[d]
                x = np.clip(e.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d), -1e100, 1e100)
                far = ((c**2).sum(axis=1) - 2 * (x @ c.T)) if d else np.zeros((len(at), 1))
                cell[at], group[at] = far.argmin(axis=1), far[:, : coarse[d]].argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(group)], ["vec_id", "e", "n", "dim", "asked", "cell", "grp"])

    return run


def _pack(scale: int):
    """A block's vectors as one row, with centre and radius of the whole numbers."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = np.array(pdf["e"].tolist(), np.float64).reshape(len(pdf), -1)
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(e * scale)
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()) * (1 + 1e-9)
        return pd.DataFrame(
            {
                "dim": [pdf["dim"].iloc[0]],
                "block": [pdf["block"].iloc[0]],
                "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                "counts": [pdf["n"].to_numpy(np.int64).tobytes()],
                "floors": [pdf["floor"].to_numpy(np.float64).tobytes()],
                "vectors": [e.tobytes()],
                "centre": [centre],
                "radius": [radius],
            }
        )

    return run


PACKED = "dim int, block string, ids binary, counts binary, floors binary, vectors binary, centre array<double>, radius double"
FOUND = "query_id long, vec_id long, score long, key binary, n long"


def _match(scale: int, k: int):
    """Pairs of a block of queries and one of data to each query's k best; the data's tree serves all pairs in a row that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("dim", "block", "ids", "counts", "vectors", "q_ids", "q_vectors", "q_floors")
        last, data = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                dim, block, ids, counts, v, q_ids, qv, floors = (batch.column(batch.schema.get_field_index(c))[row].as_py() for c in names)
                if block != last:
                    ids, e, counts = np.frombuffer(ids, np.int64), np.frombuffer(v, np.float64), np.frombuffer(counts, np.int64)
                    e = e.reshape(len(ids), dim)
                    at = _fewest(ids, e, k)
                    last, data = block, Block(ids[at], e[at], counts[at], scale, DATA_LEAF)
                q_ids = np.frombuffer(q_ids, np.int64)
                q = Block(q_ids, np.frombuffer(qv, np.float64).reshape(len(q_ids), dim), np.ones(len(q_ids), np.int64), scale, QUERY_LEAF)
                rows = search(q, data, np.frombuffer(floors, np.float64), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([min(max(r[2], _LEAST), _MOST) for r in rows], pa.int64()),
                        pa.array([_order_key(r[2]) for r in rows], pa.binary()),
                        pa.array([min(r[3], k) for r in rows], pa.int64()),
                    ],
                    ["query_id", "vec_id", "score", "key", "n"],
                )

    return run


def top_k(spark: SparkSession, embeddings: DataFrame, *, queries: str = "vec_id % 100 = 0", scale: int = 1024, k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` highest inner products with all other rows of ``embeddings`` (vec_id, embedding).

    Components become floor(``scale`` * x); products are exact whole numbers.

    1. Centres are chosen farthest first from a bounded sample; every row falls to the nearest one.
       A cell becomes as many blocks of bounded size as it needs, queries likewise in coarser cells.
       Each block is a cover tree below its own centre and radius.
    2. Every block of queries is searched together with the most promising block of data, which
       gives each query a score that its results must reach.
    3. Of all other pairs of blocks those are searched whose centres and radii allow such a score for
       any query of the block; within them pairs of nodes are pruned alike.
    4. A window takes the best of each query's results, at most ``k`` a pair of blocks.

    Blocks, centres and result lists do not grow with the table; pairs of blocks that no bound
    excludes do, as every query must meet every row that it can't exclude.

    Edge cases: null vectors, vectors with a null or non-finite component and null ids take no part;
    all others do, whatever their size; a score beyond a long's range is ranked exactly and shown as
    the range's end. Vectors meet those of their own length only. Repeated rows are candidates each;
    rows with the query's own id are its own, and it is asked once. Ties go to the smaller vec_id;
    with fewer candidates there are fewer rows. An empty table gives none. Extra columns are ignored.
    """
    scratch = Scratch(spark, "topk")
    fine = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(
        F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    )
    fine = fine.withColumn("dim", F.size("e"))
    is_query = F.coalesce(F.expr(queries), F.lit(False))

    # 1. centres of the commonest lengths; rows of the others are dealt by hash alone
    sizes = fine.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).orderBy(F.desc("n"), "dim").limit(LENGTHS).collect()
    per = lambda d: max(FEWEST, BLOCK_CELLS // max(1, d))
    centres, coarse = {}, {}
    for r in sizes:
        d, most = r["dim"], min(CENTRES, math.ceil(r["n"] / per(r["dim"])))
        if most > 1 and d:
            sample = fine.where(F.col("dim") == d).select("e").orderBy(F.xxhash64("vec_id", "e")).limit(max(4 * most, min(SAMPLE_ROWS, (1 << 20) // d)))
            x = np.clip(np.array([s["e"] for s in sample.collect()]), -1e100, 1e100)
            centres[d] = x[farthest_first(x, most)]
            coarse[d] = min(len(centres[d]), max(1, math.ceil(r["q"] / per(d))))
    once = fine.groupBy("vec_id", "e", "dim").agg(F.count("*").alias("n")).select("vec_id", "e", "n", "dim", is_query.alias("asked"))
    dealt = scratch.keep(once.mapInArrow(_cells(centres, coarse), "vec_id long, e array<double>, n long, dim int, asked boolean, cell int, grp int"), "dealt")

    def blocks(rows: DataFrame, cell: str) -> DataFrame:
        # equal vectors fall into one cell, so blocks of a cell are told apart by the hash of the row
        room = F.greatest(F.lit(FEWEST), F.floor(F.lit(BLOCK_CELLS) / F.greatest(F.col("dim"), F.lit(1))))
        n = rows.groupBy("dim", cell).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / room)).alias("parts"))
        named = rows.join(n, ["dim", cell]).withColumn("block", F.concat_ws("-", "dim", cell, F.pmod(F.xxhash64("vec_id", "e"), F.col("parts"))))
        return named.groupBy("dim", "block").applyInPandas(_pack(scale), PACKED)

    no_floor = F.lit(float("-inf")).alias("floor")
    data = scratch.keep(blocks(dealt.select("vec_id", "e", "n", "dim", "cell", no_floor), "cell"), "data")
    asked = dealt.where("asked").select("vec_id", "e", "n", "dim", "grp")
    first_asked = scratch.keep(blocks(asked.withColumn("floor", no_floor), "grp"), "asked")

    # bounds of all pairs of blocks; blocks of data are dealt to some hundreds each, as one length may have all
    n_blocks = data.count()
    n_parts = max(1, n_blocks // 256)
    ends = lambda t, s: t.select("dim", *(F.col(c).alias(f"{c}_{s}") for c in ("block", "centre", "radius")))
    left = ends(first_asked, "q").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    right = ends(data, "d").withColumn("part", F.pmod(F.xxhash64("block_d"), F.lit(n_parts)).cast("int"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    top = dot("centre_q", "centre_d") + F.col("radius_q") * norm("centre_d") + F.col("radius_d") * norm("centre_q") + F.col("radius_q") * F.col("radius_d")
    span = (norm("centre_q") + F.col("radius_q")) * (norm("centre_d") + F.col("radius_d"))
    bounds = left.join(right, ["dim", "part"]).select("block_q", "block_d", (top + span * 1e-9).alias("bound"))
    bounds = scratch.keep(bounds.withColumn("bound", F.coalesce(F.nanvl("bound", F.lit(float("inf"))), F.lit(float("inf")))), "bounds")

    # as many tasks as blocks while these are few; a task has all pairs of its blocks, so their trees are built once
    n_tasks = max(1, min(n_blocks, max(1024, n_blocks // 4)))

    def searched(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        q = asked.select(F.col("block").alias("block_q"), F.col("ids").alias("q_ids"), F.col("floors").alias("q_floors"), F.col("vectors").alias("q_vectors"))
        left = pairs.join(q, "block_q").withColumnRenamed("block_d", "block").repartition(n_tasks, "block")
        right = data.select("dim", "block", "ids", "counts", "vectors").repartition(n_tasks, "block")
        return left.join(right, "block").drop("block_q").mapInArrow(_match(scale, k), FOUND)

    # 2. the most promising pair of each block of queries
    first = scratch.keep(bounds.groupBy("block_q").agg(F.max_by("block_d", "bound").alias("block_d")), "first")
    near = scratch.keep(searched(first, first_asked), "near")
    reached = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("c"), F.min("score").alias("s"))
    floor = F.when((F.col("c") >= k) & (F.col("s") > _LEAST), F.col("s").cast("double")).otherwise(float("-inf"))
    with_floor = asked.join(reached, "vec_id", "left").withColumn("floor", floor).drop("c", "s")

    # 3. the pairs that may still matter
    asked_again = scratch.keep(blocks(with_floor, "grp"), "asked-again")
    worst = asked_again.select(F.col("block").alias("block_q"), "floors").mapInArrow(_worst, "block_q string, worst double")
    rest = bounds.join(worst, "block_q").where("bound >= worst").join(first, ["block_q", "block_d"], "left_anti").select("block_q", "block_d")
    found = near.unionByName(searched(rest, asked_again))

    # 4. k of each query: a row that stands several times takes as many places
    best = found.withColumn("row", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("key"), "vec_id"))).where(F.col("row") <= k)
    each = best.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("row", "again")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _worst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(np.frombuffer(f, np.float64).min()) for f in batch.column(1).to_pylist()], pa.float64())], ["block_q", "worst"])


ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score FROM (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0) q JOIN e d ON q.vec_id <> d.vec_id AND len(q.v) = len(d.v))
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
