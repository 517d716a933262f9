"""Token counts under edits: a tree of pre-token counts for each document, of which an edit touches a few leaves."""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: The default vocabulary: ranks of a byte-level BPE, read on the driver and sent along.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's texts are cut before its merges apply (fixed value of the tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf when a tree is built, and the most that a leaf may grow to.
LEAF, FULL = 64, 512
#: Characters before an edit that the cut of a pre-token may depend on.
CONTEXT = 4


class Counter:
    """Pre-tokens and their numbers of tokens, for one vocabulary."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.cut, self.known = regex.compile(PATTERN), {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) > 500_000:
                self.known.clear()
            if len(piece) < 64:
                self.known[piece] = n
        return n

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Length and number of tokens of each pre-token."""
        parts = self.cut.findall(text)
        return list(map(len, parts)), list(map(self.count, parts))


class Tree:
    """Sums of lengths and of tokens over a document's pre-tokens.

    A leaf holds some neighbouring pre-tokens; the inner nodes, in two arrays, hold the sums of
    their subtrees, so an edit finds its leaf by descent and updates one path for each leaf it touches.
    """

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.encoded = counter, text, 0
        self._build(*counter.pieces(text))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, (n, c) in enumerate(self.leaves):
            self.chars[self.width + i], self.tokens[self.width + i] = sum(n), sum(c)
        for v in range(self.width - 1, 0, -1):
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for the text's end, and where it begins."""
        v, start = 1, 0
        while v < self.width:
            v *= 2
            if place >= start + self.chars[v] and self.chars[v + 1]:
                start += self.chars[v]
                v += 1
        return v - self.width, start

    def _set(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        v = leaf + self.width
        self.chars[v], self.tokens[v] = sum(lengths), sum(counts)
        while v > 1:
            v //= 2
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def edit(self, start: int, length: int, new: str) -> int:
        """Replace characters; places beyond the text's end mean its end. The pre-tokens that were encoded anew are counted."""
        start = min(max(0, start), len(self.text))
        stop = min(len(self.text), start + max(0, length))
        old, self.text = self.text, self.text[:start] + new + self.text[stop:]
        shift, changed_to = len(self.text) - len(old), start + len(new)
        # from the pre-token that holds the first character of the context before the edit
        leaf, at = self._leaf_at(max(0, start - CONTEXT))
        lengths, counts = self.leaves[leaf]
        ends = np.cumsum(lengths).tolist()
        keep = bisect_right(ends, max(0, start - CONTEXT) - at)
        begin = at + (ends[keep - 1] if keep else 0)
        head = (lengths[:keep], counts[:keep])
        # to the first cut behind the edit that was there before: from there on nothing can differ
        last, base, place = leaf, at, keep
        edge = begin  # end of the old pre-tokens passed so far
        fresh_n, fresh_c = [], []
        for m in self.counter.cut.finditer(self.text, begin):
            fresh_n.append(m.end() - m.start())
            fresh_c.append(self.counter.count(m.group()))
            if m.end() < changed_to:
                continue
            want = m.end() - shift
            while edge < want and last < len(self.leaves):
                if place < len(self.leaves[last][0]):
                    edge += self.leaves[last][0][place]
                    place += 1
                else:
                    last, place = last + 1, 0
            if edge == want:
                break
        else:  # the text's end
            last, place = len(self.leaves) - 1, len(self.leaves[-1][0])
        if last == len(self.leaves):
            last, place = last - 1, len(self.leaves[-1][0])
        tail = (self.leaves[last][0][place:], self.leaves[last][1][place:])
        for i in range(leaf + 1, last + 1):
            self._set(i, [], [])
        if last > leaf:
            self._set(last, *tail)
            tail = ([], [])
        self._set(leaf, head[0] + fresh_n + tail[0], head[1] + fresh_c + tail[1])
        if len(self.leaves[leaf][0]) > FULL:
            self._build([n for x, _ in self.leaves for n in x], [c for _, x in self.leaves for c in x])
        self.encoded += len(fresh_n)
        return len(fresh_n)


def _count(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks)
        for batch in pieces(batches, "text"):
            out = []
            for text, edits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tree = Tree(counter, text or "")
                n, before = len(tree.text), tree.total
                leaves = sum(len(x) for x, _ in tree.leaves)
                for e in edits or []:
                    tree.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                out.append((before, leaves, len(edits or []), tree.encoded, tree.total, len(tree.text) - n))
            cols = np.array(out, np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[:, i]) for i in range(6))], ["doc_id", "n_tokens", "n_pretokens", "n_edits", "n_reencoded", "n_tokens_edited", "n_chars_added"])

    return run


EDITS = "array<struct<seq:long,start:long,length:long,replacement:string>>"


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, edits) from a table of edits (doc_id, seq, start, length, replacement); a document's edits apply by seq."""
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*(F.col(c).cast("long").alias(c) for c in ("seq", "start", "length")), F.col("replacement")))).alias("edits"))
    return docs.select("doc_id", "text").join(own, "doc_id", "left")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts of every row of ``docs`` (doc_id, text, edits) before and after its edits.

    n_tokens and n_pretokens are those of the text, n_tokens_edited the tree's root after
    n_edits edits in order, for which n_reencoded pre-tokens were encoded; n_chars_added is the
    change in length. start and length count characters, against the text as edited so far.

    Edge cases: null and empty texts have no tokens, and can be edited into some; places beyond
    the end mean the end, nulls in an edit 0 or nothing; edits may be null. Repeated rows and null
    ids are counted row by row; extra columns are ignored. Bytes of the vocabulary file (about a
    megabyte, fixed) travel with the function.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    schema = "doc_id long, n_tokens long, n_pretokens long, n_edits long, n_reencoded long, n_tokens_edited long, n_chars_added long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(_count(ranks), schema)


def redactions(docs: DataFrame) -> DataFrame:
    """``docs`` with two edits each: eight characters replaced by a marker at a place drawn from the id, and a line added at the front."""
    n = F.greatest(F.length("text"), F.lit(1))
    at = F.pmod(F.xxhash64("doc_id"), n)
    edit = lambda seq, start, length, text: F.struct(F.lit(seq).cast("long").alias("seq"), start.cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(text).alias("replacement"))
    return docs.select("doc_id", "text", F.array(edit(1, at, 8, " [removed]"), edit(2, F.lit(0), 0, "Edited.\n")).alias("edits"))
