"""What several operators share: scratch tables, stable hashing and word splitting."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill import session
from postmill.session import read_table

__all__ = ["Scratch", "crc_of_id", "delete", "discarded", "golden", "mix64", "read_table", "scratch_folder", "text_bytes", "word_hashes"]

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def golden(i: int) -> np.uint64:
    """The i-th multiple of GOLDEN, modulo 2**64."""
    return np.uint64(int(GOLDEN) * i % 2**64)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Scratch folders made so far in this context: a query that runs in another thread has its own list.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared storage, which ends with the application; :func:`discarded` knows of it."""
    root = session.scratch_folder(spark, name)
    if (made := _made.get()) is not None:
        made.append(root)
    return root


@contextmanager
def discarded(spark: SparkSession):
    """Delete, at the end, the scratch folders that were made within: for results that have been written elsewhere."""
    outer, own = _made.get(), []
    token = _made.set(own)
    try:
        yield
    except BaseException:
        if outer is not None:
            outer.extend(own)
        raise
    else:
        for root in own:
            delete(spark, root)
    finally:
        _made.reset(token)


class Scratch:
    """Intermediate tables written to the shared folder, so that lost executors cost no recomputation of long lineages."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_folder(spark, name), 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """``df`` as a written table that is read back."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table of :meth:`keep` that nothing reads any more."""
        delete(self.spark, df.scratch_path)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within, Spark hands at most so many rows at once to Python: for eager jobs on long rows, whose batches else take hundreds of megabytes in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_of_id(col: str = "doc_id"):
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); wraps around as unsigned integers do."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 of each text of an Arrow column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most_bytes`` of text each (one row at least), for bounded working memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


#: DuckDB SQL of crc32's 256 remainders, by its rule, as the column crc_table.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table"


def crc32_sql(codes: str, table: str = "crc_table") -> str:
    """DuckDB SQL of the crc32 of a list of byte values."""
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"
