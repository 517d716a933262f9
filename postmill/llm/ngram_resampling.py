"""Resampling towards a target distribution: DuckDB counts hashed n-grams in each partition, Spark merges the counts and scores."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, Scratch, crc32_sql, pieces

#: Buckets, per cent of the long enough documents that are drawn, words from which a document is long enough, seed of the draw.
BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: Bytes of text that DuckDB gets at once, and its memory; it never writes to a disk.
_PIECE, _MEMORY = 4 << 20, "700MB"
#: Rows of a range when the drawn are ordered.
_RANGE = 500_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Texts (ord, text) in lower case to the buckets of their words and pairs of neighbours.
COUNT = f"""
WITH w AS (SELECT ord, unnest(words) AS word, generate_subscripts(words, 1) AS pos
           FROM (SELECT ord, regexp_extract_all(text, '{WORD}') AS words FROM texts)),
g AS (SELECT ord, word, lead(word) OVER (PARTITION BY ord ORDER BY pos) AS following FROM w),
f AS (SELECT ord, word AS feature, 1 AS is_word FROM g UNION ALL SELECT ord, word || ' ' || following, 0 FROM g WHERE following IS NOT NULL),
k AS (SELECT feature, (crc(feature) % {BUCKETS})::SMALLINT AS bucket FROM (SELECT DISTINCT feature FROM f)),
c AS (SELECT ord, bucket, count(*)::INTEGER AS n, sum(is_word)::BIGINT AS n_words FROM f JOIN k USING (feature) GROUP BY ord, bucket)
SELECT ord, sum(n_words)::BIGINT AS n_words, sum(n)::BIGINT AS n_features, list(bucket ORDER BY bucket) AS buckets, list(n ORDER BY bucket) AS counts
FROM c GROUP BY ord
"""
COUNTS = "doc_id long, n_words long, n_features long, buckets array<smallint>, counts array<int>"


def _crc(features: pa.ChunkedArray | pa.Array) -> pa.Array:
    """zlib's crc32 of each string, as DuckDB calls it."""
    return pa.array(np.fromiter(map(zlib.crc32, features.cast(pa.binary()).to_pylist()), np.uint32, len(features)))


def _connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": _MEMORY, "temp_directory": ""})
    con.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to COUNTS, a row for each row."""
    con, kinds = _connection(), [pa.int64(), pa.int64(), pa.list_(pa.int16()), pa.list_(pa.int32())]
    for batch in pieces(batches, "text", _PIECE):
        con.register("texts", pa.table({"ord": np.arange(batch.num_rows), "text": pc.ascii_lower(batch.column(1))}))
        found = con.sql(COUNT).to_arrow_table().combine_chunks()
        con.unregister("texts")
        place = np.full(batch.num_rows, -1)
        place[found["ord"].to_numpy()] = np.arange(found.num_rows)
        out = found.select(["n_words", "n_features", "buckets", "counts"]).take(pa.array(place, mask=place < 0))
        columns = [c.combine_chunks().cast(t) if isinstance(c, pa.ChunkedArray) else c.cast(t) for c, t in zip(out.columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(columns[0], 0), pc.fill_null(columns[1], 0), *columns[2:]], ["doc_id", "n_words", "n_features", "buckets", "counts"])
    con.close()


def bucket_counts(docs: DataFrame) -> DataFrame:
    """COUNTS of every row of ``docs`` (doc_id, text), counted by DuckDB where the rows are read; without words the lists are null."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, COUNTS)


def _merged(counts: DataFrame, name: str) -> DataFrame:
    """(bucket, name) of all documents together; each task sums what it reads before the shuffle."""
    each = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return each.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(raw: DataFrame, target: DataFrame) -> DataFrame:
    """One row with ``gains``: of each bucket, in order, the floored thousandfold logarithm of the target's smoothed share over the raw one."""
    both = F.broadcast(raw.sparkSession.range(BUCKETS).select(F.col("id").cast("smallint").alias("bucket")))
    both = both.join(_merged(raw, "s"), "bucket", "left").join(_merged(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    listed = F.sort_array(F.collect_list(F.struct("bucket", "s", "t")))  # BUCKETS entries
    one = both.agg(listed.alias("b"), F.sum("s").alias("s_all"), F.sum("t").alias("t_all"))
    d = lambda c: c.cast("double")
    gain = lambda x: F.floor(F.lit(1000.0) * F.log(d(x["t"] + 1) * d(F.col("s_all") + BUCKETS) / (d(x["s"] + 1) * d(F.col("t_all") + BUCKETS))))
    return one.select(F.transform("b", gain).alias("gains"))


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column(3), batch.column(4)
            parts = gain[lists.flatten().to_numpy(zero_copy_only=False)] * n.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            sums = np.concatenate([[0], np.cumsum(parts)])
            total, features = np.diff(sums[np.concatenate([[0], ends])]), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.floor_divide(total, np.maximum(features, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def draw_noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel variable of an id, in floored thousandths; a null id draws as one more id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def ranked(scratch: Scratch, rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, from 1 in the given order, which must tell all rows apart: ranges are ordered apart, and numbered on from those before.

    Only a count for each range meets in one task.
    """
    n = rows.count()
    kept = scratch.keep(rows.repartitionByRange(max(1, -(-n // _RANGE)), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", 33)
    sizes = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return kept.withColumn("part", part).join(before, "part").withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at", "part", "before")


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank for every row of ``docs`` (doc_id, text), towards the texts of ``target``.

    Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case; features are
    words and pairs of neighbours. A weight is the floored mean of the features' gains, a score
    adds a Gumbel variable drawn from the id. Of the documents with ``least_words`` words or more,
    ``percent`` of a hundred with the highest scores are ranked from 1; others have a null rank.

    Texts are read once: each document's bucket counts are spilled to Parquet in the shared folder, from
    which Spark sums the buckets and then scores. A task holds a few megabytes of text, or one
    text and its features; the table of gains has BUCKETS numbers.

    Edge cases: null texts and texts without words have no features, weight 0 and no rank; a null id draws by
    an empty id. Equal scores are ordered by id, nulls first, then by the order in which the table is read, so
    repeated rows are ranked one after the other. Without a target text the gains follow from t = 0. Extra
    columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(spark, "resample")
    raw = scratch.keep(bucket_counts(docs), "raw")
    wanted = scratch.keep(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text")), "target")
    gain = np.array(gains(raw, wanted).first()["gains"], np.int64)
    weighed = raw.mapInArrow(_weigh(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = scratch.keep(weighed.withColumns({"score": F.col("weight") + draw_noise(F.col("doc_id"), seed), "nth": F.monotonically_increasing_id()}), "scored")
    long_enough = F.col("n_words") >= least_words
    share = percent * scored.where(long_enough).count() // 100
    placed = ranked(scratch, scored.where(long_enough), [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("nth")])
    placed = placed.withColumn("rank", F.when(F.col("rank") <= share, F.col("rank")))
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(out).unionByName(scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(out))


def _oracle() -> str:
    hexed = "hex(encode(feature))"
    code = crc32_sql(f"list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::BIGINT)")
    gain = f"floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT"
    return f"""
WITH crc AS ({CRC_TABLE_SQL}),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS ord, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark),
w AS (SELECT kind, ord, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM (
  SELECT kind, ord, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM texts)),
g AS (SELECT *, lead(word) OVER (PARTITION BY kind, ord ORDER BY pos) AS following FROM w),
f AS (SELECT kind, ord, word AS feature, 1 AS is_word FROM g UNION ALL SELECT kind, ord, word || ' ' || following, 0 FROM g WHERE following IS NOT NULL),
k AS (SELECT feature, {code} % {BUCKETS} AS bucket FROM (SELECT DISTINCT feature FROM f), crc),
c AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN k USING (feature) GROUP BY bucket),
a AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM c),
b AS (SELECT bucket, {gain} AS gain FROM c, a),
x AS (SELECT ord, count(*) AS n_features, sum(is_word) AS n_words, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN k USING (feature) JOIN b USING (bucket) WHERE kind = 'd' GROUP BY ord),
d AS (SELECT doc_id, ord, coalesce(n_features, 0) AS n_features, coalesce(n_words, 0) AS n_words, coalesce(weight, 0) AS weight
  FROM (SELECT doc_id, row_number() OVER () AS ord FROM documents) LEFT JOIN x USING (ord)),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296.0)))::BIGINT AS score FROM d),
r AS (SELECT ord, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, ord) AS rank FROM e WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM r) THEN rank END AS rank
FROM e LEFT JOIN r USING (ord)
"""


ORACLE = _oracle()
