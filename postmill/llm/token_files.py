"""Token ids as Parquet: list columns in dictionary encoding beside delta-encoded places, in small row groups with page indexes."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, pieces, scratch_folder

#: Id that ends a document, and bytes of text that a file aims at.
END_ID, FILE_BYTES = 2, 64 << 20
#: Columns of a file. ``start`` and ``stop`` count ids within the file, so that a file doesn't depend on those before it.
COLUMNS = "part int, doc_id long, start long, stop long, ids array<int>"
#: Ids are dictionary-encoded (a vocabulary is small); places grow and are delta-encoded, which writer version 2 does without a dictionary.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#start": "false",
    "parquet.enable.dictionary#stop": "false",
}

#: Most words whose ids a Python worker remembers, and words sent to the tokenizer as one text.
_KNOWN, _JOINED = 350_000, 100
#: Words that are surely one pre-token, letters of Latin-1 in UTF-8, and such words with signs behind, which are one more.
_LETTERS = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
_SIGNED = re.compile(rb"(" + _LETTERS + rb")([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]+)")
_LETTERS = re.compile(_LETTERS)
#: Texts that a task gets at once.
_BATCH_ROWS = 1000
_encoders: dict[int, Encoder] = {}


class Encoder:
    """Ids of texts by a tokenizer that drops blanks, so that words between blanks are encoded apart and remembered.

    The result is that of encoding whole texts (tested): the tokenizer's normaliser and cuts never
    look across a blank. A word is remembered by its bytes with A-Z in lower case, which the normaliser does too;
    words that may hold a special token's string are kept as they stand. New words are encoded
    many in one text: words of letters between blanks, where the vocabulary marks ends of words, others
    between special tokens. When too many are known, those that were met again stay. Signs behind a word of letters are looked up apart from it.
    """

    def __init__(self, definition: str, between: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.between = Tokenizer.from_str(definition), between
        self.mark, self.mark_bytes = self.tokenizer.token_to_id(between), between.encode()
        suffix, vocabulary = json.loads(definition)["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.place: dict[bytes, int] = {}
        self.flat, self.starts, self.lengths, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the words that were met at least twice since the last time."""
        keep = self.used > 1
        self.place = dict(zip(compress(self.place, keep.tolist()), range(int(keep.sum())), strict=True))  # its order is that of the places
        at = np.flatnonzero(keep)
        n, self.flat = self.lengths[at], self._gather(at)
        self.lengths, self.starts, self.used = n, np.cumsum(n) - n, np.zeros(len(n), np.int64)

    def _gather(self, at: np.ndarray) -> np.ndarray:
        """The ids of remembered words, one after the other."""
        n = self.lengths[at]
        return self.flat[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def _ids(self, words: list[bytes], after: bytes) -> np.ndarray:
        texts = [(after.join(words[i : i + _JOINED]) + after).decode("utf-8", "replace") for i in range(0, len(words), _JOINED)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32, sum(map(len, found)))

    def _put(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        self.place.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
        self.lengths, self.used = np.concatenate([self.lengths, n]), np.concatenate([self.used, np.zeros(len(n), np.int64)])
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self, new: set[bytes]) -> None:
        plain, signed, other = set(), [], set()
        for w in new:
            if _LETTERS.fullmatch(w):
                plain.add(w)
            elif m := _SIGNED.fullmatch(w):
                signed.append((w, *m.groups()))
            else:
                other.add(w)
        other.update(x for _, _, x in signed if x not in self.place)
        plain.update(x for _, x, _ in signed if x not in self.place)
        plain = list(plain)
        ids = self._ids(plain, b" ") if self.ends.any() else np.zeros(0, np.int32)
        n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(n) == len(plain):
            self._put(plain, ids, n)
        else:  # a vocabulary that doesn't mark ends of words, or cuts words of letters
            other.update(plain)
        apart = [w for w in other if self.mark_bytes not in w]
        marked = self._ids(apart, self.mark_bytes)
        at = np.flatnonzero(marked == self.mark)
        self._put(apart, marked[marked != self.mark], np.diff(at, prepend=-1) - 1)
        for w in other:
            if self.mark_bytes in w:
                ids = np.array(self.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                self._put([w], ids, np.array([len(ids)]))
        both = np.array([[self.place[x], self.place[y]] for _, x, y in signed], np.int64).reshape(-1, 2)
        self._put([w for w, _, _ in signed], self._gather(both.ravel()), self.lengths[both].sum(axis=1))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and how many each text has.

        Arrow splits the texts and finds the distinct words; these alone are looked up.
        """
        texts = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        each = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = each.flatten().cast(pa.binary()).dictionary_encode()
        words, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.place) > _KNOWN:
            self._forget()
        if new := set(words).difference(self.place):
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        self.used[at] += np.bincount(which, minlength=len(words))
        at = at[which]
        edges = np.concatenate([[0], np.cumsum(self.lengths[at])])
        return self._gather(at), np.diff(edges[np.concatenate([[0], np.cumsum(pc.list_value_length(each).to_numpy())])])


def _encoder(definition: str, between: str) -> Encoder:
    """The worker's encoder, which outlives a task."""
    key = hash((definition, between))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition, between)
    return _encoders[key]


def _encode(definition: str, between: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, done = _encoder(definition, between), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, "text", 4 << 20):
            ids, n = encoder.encode(batch.column(1))
            ids = np.insert(ids, np.cumsum(n), np.int32(end_id))
            stops = np.cumsum(n + 1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(done + stops - n - 1), pa.array(done + stops), lists], ["part", "doc_id", "start", "stop", "ids"])
            done += int(stops[-1])

    return run


class TokenFiles:
    """Token files below one folder, in ascending order of doc_id, and a manifest of what precedes each file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def rows(self) -> DataFrame:
        """All columns as written; what is not selected is not read."""
        return self.spark.read.schema(COLUMNS).parquet(f"{self.root}/tokens")

    @property
    def manifest(self) -> DataFrame:
        """(part, base, n_docs, n_tokens, first_doc_id, last_doc_id): a row for each file; base is the number of ids before it."""
        return self.spark.read.parquet(f"{self.root}/manifest")

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with ``start`` and ``stop`` counted over all files."""
        own = self.manifest.select("part", "base")
        return rows.join(own, "part").withColumns({c: F.col(c) + F.col("base") for c in ("start", "stop") if c in rows.columns}).drop("part", "base")

    def metadata(self) -> DataFrame:
        """(doc_id, start, stop) of every document; ids are not read."""
        return self.placed(self.rows.select("part", "doc_id", "start", "stop"))

    def documents(self, condition: Column) -> DataFrame:
        """(doc_id, start, stop, ids) of documents by a condition on doc_id, which reaches row groups and pages."""
        return self.placed(self.rows.where(condition))

    def window(self, start: int, stop: int) -> DataFrame:
        """(doc_id, start, stop, ids) cut to the places from ``start`` to before ``stop`` of the whole sequence.

        The manifest gives the first and the last file that hold them; within these, and for files
        between, conditions on columns of the files are pushed to row groups and pages.
        """
        hit = self.manifest.where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start))
        lo, hi = hit.orderBy("part").first(), hit.orderBy(F.desc("part")).first()
        if lo is None or stop <= start:
            return self.placed(self.rows.where(F.lit(False)))
        inside = F.col("part").between(lo["part"], hi["part"]) & ((F.col("part") > lo["part"]) | (F.col("stop") > start - lo["base"])) & ((F.col("part") < hi["part"]) | (F.col("start") < stop - hi["base"]))
        skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
        rows = self.placed(self.rows.where(inside)).withColumn("ids", F.slice("ids", skip + 1, (F.least("stop", F.lit(stop)) - F.col("start") - skip).cast("int")))
        return rows.withColumns({"start": F.greatest("start", F.lit(start)), "stop": F.least("stop", F.lit(stop))})


def write_token_files(spark: SparkSession, docs: DataFrame, definition: str, *, root: str | None = None, end_id: int = END_ID, between: str = "<|endoftext|>", file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Encode every text of ``docs`` (doc_id, text), each followed by ``end_id``, into files in ascending order of doc_id.

    ``definition`` is the tokenizer's JSON; its normaliser must drop blanks, and ``between`` be one of
    its special tokens. Texts are ranged by id once, then encoded, placed and written in one pass,
    so a text is never held beside more than a few megabytes of others. The manifest is a
    running sum over one row a file.

    Edge cases: null and empty texts have the end id only. Null ids come first. Rows that share an
    id stay apart, in the order in which the table is read, and are dealt to several files if they are
    many. Extra columns are ignored, whatever their names. An empty table gives no files and no rows.
    """
    root = root or scratch_folder(spark, "token-files")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n_bytes = table.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    order = [F.asc_nulls_first("doc_id"), F.asc("nth")]
    ranged = table.withColumn("nth", F.monotonically_increasing_id()).repartitionByRange(max(1, -(-n_bytes // file_bytes)), *order).sortWithinPartitions(*order)
    encoded = ranged.select("doc_id", "text").mapInArrow(_encode(definition, between, end_id), COLUMNS)
    with arrow_rows(spark, _BATCH_ROWS):
        encoded.write.options(**LAYOUT).mode("overwrite").parquet(f"{root}/tokens")
    files = TokenFiles(spark, root)
    parts = files.rows.groupBy("part").agg(F.count("*").alias("n_docs"), F.max("stop").alias("n_tokens"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).write.mode("overwrite").parquet(f"{root}/manifest")
    return files


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, lists of ids, to crc32 of the ids as little-endian unsigned 32-bit numbers."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
        at = (lists.offsets.to_numpy() * 4).tolist()
        sums = pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sums], [*batch.schema.names[:-1], "ids_crc32"])


def token_digests(files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, as read from the files."""
    read = files.rows.mapInArrow(_checksums, "part int, doc_id long, start long, stop long, ids_crc32 long")
    return files.placed(read).select("doc_id", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ids_crc32")
