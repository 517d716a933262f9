"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, pieces

#: Lengths of n-grams, buckets that they are hashed to, additive smoothing.
LENGTHS, BUCKETS, SMOOTH = (1, 2, 3, 4), 1 << 16, 0.5
#: Bound of the training sample: documents of each language.
DOCS_A_LANGUAGE = 2500
#: Bound of the fit: values of lang that are learned.
LANGUAGES = 200
#: Log probabilities are whole multiples of this, so their sums are exact: a text's score is the same in any batch.
UNIT = 2.0**-20
#: Characters that are hashed at once.
_CHUNK = 1 << 18

_MULTIPLIERS = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F))


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of texts that are not empty, in lower case with a space around each text, and where each text begins."""
    padded = [f" {t.lower()} " for t in texts]
    starts = np.cumsum([0, *map(len, padded)])
    return np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _buckets(cp: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram at each place but the last n - 1."""
    m = len(cp) - n + 1
    h = np.full(m, n, np.uint32)
    for i in range(n):
        h = (h ^ cp[i : i + m]) * _MULTIPLIERS[i]
        h ^= h >> np.uint32(15)
    return h & np.uint32(BUCKETS - 1)


def sparse(cp: np.ndarray, starts: np.ndarray, n: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """The bucket of the n-gram at each place from ``lo`` to ``hi``; BUCKETS where it would run over its text's end."""
    hi = len(cp) if hi is None else hi
    out = np.full(hi - lo, BUCKETS, np.int32)
    own = _buckets(cp[lo : hi + n - 1], n) if len(cp) - lo >= n else out[:0]
    out[: len(own)] = own
    for k in range(1, n):  # a text has three characters at least, its blanks included, so these places are its own
        last = starts[1:] - k
        out[last[(last >= lo) & (last < hi)] - lo] = BUCKETS
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, bucket, n), summed over what the task has read."""
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches, "text"):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in set(langs):
            cp, starts = _code_points([t for x, t in zip(langs, texts, strict=True) if x == lang and t])
            into = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for n in LENGTHS:
                into += np.bincount(sparse(cp, starts, n), minlength=BUCKETS + 1)[:BUCKETS]
    for lang, c in total.items():
        b = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(c[b])], ["lang", "bucket", "n"])


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # int32, bucket x language: log probability in units of UNIT; the last row is zero
    prior: np.ndarray


def fit(docs: DataFrame) -> Model | None:
    """Counts of a bounded sample, summed by Spark; the driver gets at most BUCKETS numbers a language.

    The sample is drawn by the hash of the id, about DOCS_A_LANGUAGE documents of each language,
    from those whose crc32 mod 4 is not 2 and whose lang and text are not null. None without any.
    Of more than LANGUAGES values of lang those with most documents are learned, ties in alphabetical order,
    so that a column of junk costs neither memory nor a long plan.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_of_id() % 4 != 2))
    n = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return None
    share = F.create_map(*(F.lit(x) for k, v in n.items() for x in (k, min(1.0, DOCS_A_LANGUAGE / v))))
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counts = sample.select("lang", "text").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return None
    table = np.full((BUCKETS, len(langs)), SMOOTH)
    table[counts["bucket"], counts["lang"].map(langs.index)] += counts["n"]
    prior = np.array([n[x] for x in langs], float)
    return Model(langs, weigh(table), np.log(prior / prior.sum()))


def weigh(table: np.ndarray) -> np.ndarray:
    """Smoothed counts, bucket x language, to the weights of a :class:`Model`."""
    logs = np.rint(np.log(table / table.sum(axis=0)) / UNIT).astype(np.int32)
    return np.vstack([logs, np.zeros((1, table.shape[1]), np.int32)])


def log_likelihoods(model: Model, texts: list[str]) -> np.ndarray:
    """Sum of log probabilities of the n-grams of each text, which must not be empty; a column for each language.

    The batch is a sparse matrix of n-grams, one row a text; the product with the weights is taken
    some hundred thousand places at a time.
    """
    cp, starts = _code_points(texts)
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    for lo in range(0, len(cp), _CHUNK):
        hi = min(len(cp), lo + _CHUNK)
        total = np.zeros((hi - lo, len(model.langs)), np.int32)
        for n in LENGTHS:
            total += model.weights[sparse(cp, starts, n, lo, hi)]
        first, last = np.searchsorted(starts, lo, side="right") - 1, np.searchsorted(starts, hi, side="left")
        cuts = np.maximum(starts[first:last], lo) - lo
        out[first:last] += np.add.reduceat(total, cuts, axis=0, dtype=np.int64)
    return out * UNIT


def _predict(sent: Broadcast[Model | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in pieces(batches, "text"):
            texts = batch.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            written = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            if model is not None and written:
                p = log_likelihoods(model, [texts[i] for i in written]) + model.prior
                best = p.argmax(axis=1)
                p = np.exp(p - p.max(axis=1, keepdims=True))
                score[written] = 1 / p.sum(axis=1)
                for i, b in zip(written, best, strict=True):
                    lang[i] = model.langs[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior probability) for every row of ``docs`` (doc_id, text, lang).

    The table of log probabilities (BUCKETS x languages) is broadcast; whole texts are scored. A
    text's n-grams end where it ends and its sums are exact, so its prediction depends on nothing
    but itself and the model.

    Edge cases: a null text, or one without a letter, is ``und`` with score 0; so is everything if
    no labelled text can be learned from. Ties go to the language first in alphabetical order. A
    null doc_id is predicted, held_out false, and never learned from. Repeated rows are predicted
    each; extra columns are ignored. lang, source and doc_id never enter a prediction.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(crc_of_id() % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
