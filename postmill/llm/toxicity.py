"""Toxicity: a support vector machine on a gap-weighted subsequence kernel, with Nyström landmarks."""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, pieces, text_bytes

#: Letters of a subsequence, decay for each place that it spans, and the most places.
ORDER, DECAY, SPAN = 3, 0.75, 8
#: Landmarks of the Nyström map, and the longest word that is scored in one piece.
LANDMARKS, LONGEST = 128, 32
#: Log-likelihood ratio from which a word is suspected to make its sentence toxic, and clean words trained on.
SURE, CLEAN_WORDS = 24.0, 12_000
#: Highest decisions that a document's score sees.
TOP = 5
#: Clean words that join the landmarks after each of the first two fits.
HARD = 32
#: Bounds of a fit: words suspected, strongest first, and hardest clean words looked at for landmarks.
SUSPECTS, HARDEST = 800, 200
#: Bounds of the training sample: labelled documents of each label, and sentences of each label.
DOCS_A_LABEL, SENTENCES_A_LABEL, SENTENCE_WORDS = 3000, 40_000, 40

# Letters of Latin-1 in lower case get codes from 1, those of other scripts share the codes beyond ASCII; anything else is a gap, code 0.
_LETTERS = [c for c in range(256) if chr(c).isalpha() and chr(c) == chr(c).lower()]
_CODE = np.zeros(256, np.uint8)
_CODE[_LETTERS] = np.arange(1, len(_LETTERS) + 1)
# A word's beginning and end count too: one mark stands twice before it and one, which the text has as \x01, behind it.
_START, _END = len(_LETTERS) + 1, len(_LETTERS) + 2
_CODE[1] = _END
_BASE = _END + 1
_EDGES = bytes(c for c in range(256) if not chr(c).isalpha())
_TABLE = _BASE**ORDER
# Codes of other letters: neighbours differ, so small alphabets (Cyrillic, Greek, Hebrew) hardly collide.
_SHARED = [chr(c) for c in _LETTERS if c > 127]
_OTHER = re.compile("[^\x00-\xff]+")
# Scripts of many signs, two letters a sign; and those without blanks between words, with the signs of a window.
_MANY = [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
_RUN_ON = [(0x3040, 0x30FF, 2), (0x3400, 0x9FFF, 2), (0xF900, 0xFAFF, 2), (0x20000, 0x3FFFF, 2), (0x0E00, 0x0EFF, 6), (0x1000, 0x109F, 6), (0x1780, 0x17FF, 6)]


@lru_cache(1 << 16)
def _other(c: str) -> tuple[str, int]:
    """A character beyond Latin-1 as Latin-1 letters (? if it is no letter), and the signs of a window of its script, 0 if that has blanks."""
    o, n = ord(c), len(_SHARED)
    # marks are letters of scripts that write vowels so; accents set on Latin letters are not
    if unicodedata.category(c)[0] not in "LM" or 0x300 <= o <= 0x36F or 0xFE00 <= o <= 0xFE0F:
        return "?", 0
    as_letters = _SHARED[o % n] + (_SHARED[o // n % n] if any(a <= o <= b for a, b in _MANY) else "")
    return as_letters, next((w for a, b, w in _RUN_ON if a <= o <= b), 0)


def _spelt(found: re.Match) -> str:
    """Characters beyond Latin-1 as Latin-1; a run without blanks as all its windows, each a word."""
    out, run, width = [], [], 0
    for letters, w in [*map(_other, found.group()), ("", -1)]:
        if run and w != width:
            out.append(f" {' '.join(''.join(run[i : i + width]) for i in range(max(1, len(run) - width + 1)))} ")
            run = []
        if w > 0:
            run.append(letters)
        else:
            out.append(letters)
        width = w
    return "".join(out)


def words_of(text: str) -> list[bytes]:
    """The words of a text in lower case, one byte a letter, without what is no letter at their ends; a run of single letters counts as one word.

    Letters beyond Latin-1 are hashed. Scripts without blanks between words give overlapping windows;
    signs of those that are kept apart by other characters are not joined.
    """
    text = text.lower()
    try:
        raw = text.encode("latin-1").split()
    except UnicodeEncodeError:
        raw = _OTHER.sub(_spelt, text).encode("latin-1").split()
    out, run = [], []
    for w in raw:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append(b" ".join(run))
        if run:
            run = []
        if w := w.strip(_EDGES):
            out.append(w)
    if len(run) > 2:
        out.append(b" ".join(run))
    return out


def sentences_of(text: str) -> list[str]:
    """Sentences: cut at ends of sentences and lines, and after SENTENCE_WORDS words."""
    out = []
    for part in re.split("[.!?\n。！？।؟۔]", text):
        w = part.split()
        out += [" ".join(w[i : i + SENTENCE_WORDS]) for i in range(0, len(w), SENTENCE_WORDS)]
    return out


def _codes(words: list[bytes]) -> np.ndarray:
    """A row of letter codes for each word; words longer than LONGEST are cut by :func:`split_long` before."""
    width = max(map(len, words), default=1) + SPAN + 1
    flat = np.frombuffer(b"".join((w + b"\x01").ljust(width, b" ") for w in words), np.uint8)
    return np.hstack([np.full((len(words), 2), _START, np.uint8), _CODE[flat].reshape(len(words), width)])


def split_long(word: bytes) -> list[bytes]:
    """A long word as overlapping pieces, so that all of it is scored."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - step), step)]


#: The weight of a subsequence by the number of places between its first and its last letter, less two.
_WEIGHTS = DECAY ** np.arange(3, SPAN + 1)
_ABSENT = np.iinfo(np.int32).max


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of the words' normalised feature vectors; equal subsequences of a word add up.

    A word's subsequences stand in one row, as their index with the code of their weight, and are
    sorted, so equal ones are neighbours.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    codes = _codes(words).astype(np.int32)
    w = codes.shape[1] - SPAN
    first, found = codes[:, :w], []
    for d in range(1, SPAN - 1):
        second = codes[:, d : d + w]
        pair, there = first * _BASE + second, (first > 0) & (second > 0)
        for e in range(1, SPAN - d):
            third = codes[:, d + e : d + e + w]
            found.append(np.where(there & (third > 0), (pair * _BASE + third) * 8 + (d + e - 2), _ABSENT))
    keys = np.concatenate(found, axis=1)
    keys.sort(axis=1)
    width, flat = keys.shape[1], keys.ravel()
    at = np.flatnonzero(flat != _ABSENT)
    row, col, val = at // width, flat[at] >> 3, _WEIGHTS[flat[at] & 7]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(col) != 0)])) if len(at) else at
    row, col, val = row[starts], col[starts], np.add.reduceat(val, starts) if len(at) else val
    norm = np.sqrt(np.bincount(row, val**2, len(words)))
    return row, col, val / norm[row] if len(val) else val


def kernel(words: list[bytes], landmarks: list[bytes]) -> np.ndarray:
    """Normalised subsequence kernel of each word with each landmark."""
    lr, lc, lv = features(landmarks)
    used, at = np.unique(lc, return_inverse=True)
    dense = np.zeros((len(used), len(landmarks)), np.float32)
    dense[at, lr] = lv
    place = np.full(_TABLE, -1, np.int32)
    place[used] = np.arange(len(used))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for i in range(0, len(words), 500):
        r, c, v = features(words[i : i + 500])
        hit = place[c] >= 0
        np.add.at(out, r[hit] + i, dense[place[c[hit]]] * v[hit, None].astype(np.float32))
    return out


def collapse(landmarks: list[bytes], alpha: np.ndarray) -> np.ndarray:
    """Weights of subsequences under which a word's decision is its kernel with the landmarks, weighted by ``alpha``."""
    r, c, v = features(landmarks)
    table = np.zeros(_TABLE)
    np.add.at(table, c, alpha[r] * v)
    return table.astype(np.float32)


@dataclass
class Model:
    """The decision as weights of subsequences, and the document score's calibration."""

    weights: np.ndarray  # float32, by index of a subsequence
    bias: float
    scale: np.ndarray | None = None  # of the document's logistic regression

    def decide(self, words: list[bytes]) -> np.ndarray:
        """The machine's decision for each word, positive for insults. Linear in the word's features, so no landmark is visited."""
        out = np.full(len(words), self.bias, np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for i in range(0, len(words), 2048):
            ids = order[i : i + 2048]
            row, col, val = features([words[j] for j in ids])
            out[ids] += np.bincount(row, self.weights[col] * val, len(ids)).astype(np.float32)
        return out

    def describe(self, decisions: list[float], words: int) -> list[float]:
        """What the document score sees of the decisions of a document's distinct words."""
        d = np.clip(np.asarray(decisions, float), -2, 2)
        top = np.concatenate([np.sort(d)[: -TOP - 1 : -1], np.full(TOP, -2.0)])[:TOP]
        suspicious = float(np.maximum(d + 0.5, 0).sum())
        return [*top, np.log1p(suspicious), np.log1p(100 * suspicious / max(1, words)), 1.0]

    def score(self, described: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(described @ self.scale, -30, 30)))


def _noised(word: bytes, rng: random.Random) -> bytes:
    """The word with characters inserted between its letters."""
    kind = rng.randrange(3)
    sep = rng.choice([b"*", b"-", b".", b" ", b"_"])
    if kind == 0:
        return sep.join(word[i : i + 1] for i in range(len(word)))
    at = rng.randrange(1, max(2, len(word)))
    return word[:at] + (sep if kind == 1 else bytes([rng.randrange(97, 123)])) + word[at:]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 800, c: float = 2000.0) -> np.ndarray:
    """A linear machine with squared hinge loss by accelerated gradient steps; the last column of x is the constant."""
    total = weight.sum()
    v = float(np.linalg.eigvalsh((x * (weight / total)[:, None]).T @ x)[-1])
    step = np.float32(1 / (2 * c * v + 1))
    w = z = np.zeros(x.shape[1], np.float32)
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ z))
        grad = (weight / total * y * slack) @ x * np.float32(-2 * c)
        grad[:-1] += z[:-1]
        after = z - step * grad
        z = after + np.float32(t / (t + 3)) * (after - w)
        w = after
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + 1e-2 * w)
    return w


def train(sentences: list[tuple[int, int, str]], seed: int = 7) -> Model | None:
    """Fit the machine on labelled sentences: (document, label of the document, sentence).

    A sentence's decision is that of its worst word. Words that stand in sentences of toxic
    documents much more often than in clean ones are the first suspects; those that the machine
    itself then clears are dropped and it is fitted again, as in multiple-instance learning.
    Suspects are also trained on with characters inserted. A sentence that a clean document has
    too counts as clean. None if one of the labels, or any suspect, is absent.
    """
    rng = random.Random(seed)
    # how often a word stands in distinct sentences of toxic and of clean documents; copies of a document add nothing
    text: dict[str, int] = {}
    for _, y, s in sentences:
        text[s] = min(y, text.get(s, y))
    seen, total = {0: Counter(), 1: Counter()}, Counter(text.values())
    for s, y in text.items():
        seen[y].update({x for w in words_of(s) for x in split_long(w)})
    if not total[0] or not total[1]:
        return None
    share = total[1] / max(1, total[0] + total[1])
    gain = {}
    for w, c in seen[1].items():
        both = c + seen[0][w]
        if len(w) >= ORDER and c * (1 - share) > 3 * share * (both - c):
            # log-likelihood ratio against the same rate in both
            g = 2 * (c * np.log(c / (share * both)) + (both - c) * np.log(max(both - c, 1e-9) / ((1 - share) * both)))
            if g > SURE:
                gain[w] = g
    suspects = sorted(gain, key=lambda w: (-gain[w], w))[:SUSPECTS]
    if not suspects:
        return None

    # landmarks: the strongest suspects that no earlier one resembles
    landmarks: list[bytes] = []
    near = kernel(suspects, suspects)
    covered = np.zeros(len(suspects))
    for i, w in enumerate(suspects):
        if len(landmarks) < LANDMARKS and covered[i] < 0.8:
            landmarks.append(w)
            covered = np.maximum(covered, near[:, i])
    # the clean side: the words of clean sentences that come nearest to a landmark, and a sample of the rest
    clean = sorted(w for w in seen[0] if w not in gain)
    closest = np.argsort(-kernel(clean, landmarks).max(axis=1), kind="stable")
    rest = closest[CLEAN_WORDS:]
    clean = [clean[i] for i in (*closest[:CLEAN_WORDS], *rest[:: max(1, len(rest) // CLEAN_WORDS)])]
    keep, w = suspects, None
    for last in (False, False, True):
        gram = kernel(landmarks, landmarks).astype(np.float64)
        val, vec = np.linalg.eigh(gram + 1e-6 * np.eye(len(landmarks)))
        root = vec / np.sqrt(np.maximum(val, 1e-6)) @ vec.T
        mapped = lambda ws: np.hstack([kernel(ws, landmarks) @ root.astype(np.float32), np.ones((len(ws), 1), np.float32)])  # noqa: B023, E731
        extra = [_noised(x, rng) for x in keep for _ in range(4)]
        x = mapped([*keep, *extra, *clean])
        y = np.concatenate([np.ones(len(keep) * 5, np.float32), -np.ones(len(clean), np.float32)])
        each = np.sqrt([gain[k] for k in keep])
        half = np.repeat(each, 4)
        often = np.sqrt([seen[0][k] for k in clean])
        mass = np.concatenate([each / each.sum(), half / half.sum() / 2, 2 * often / often.sum() + 2 / len(clean)]).astype(np.float32)
        w = _svm(x, y, mass)
        if not last:
            keep = [k for k, d in zip(keep, x[: len(keep)] @ w, strict=True) if d > 0] or keep
            # clean words that the machine finds hardest become landmarks as well, unless they resemble each other
            hard = [clean[i] for i in np.argsort(-(x[-len(clean) :] @ w), kind="stable")[:HARDEST]]
            alike, taken = kernel(hard, hard), []
            for i in range(len(hard)):
                if len(taken) < HARD and not any(alike[i, j] > 0.9 for j in taken):
                    taken.append(i)
            landmarks += [hard[i] for i in taken]

    return Model(collapse(landmarks, root @ w[:-1].astype(np.float64)), float(w[-1]))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, toxic, sentence) to the machine's one row, none if nothing can be learned."""
    model = train([r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)])
    if model is not None:
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias])], ["weights", "bias"])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        d, y, s = [], [], []
        for i, label, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            own = sentences_of(t or "")
            d += [i] * len(own)
            y += [label] * len(own)
            s += own
        yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(y, pa.int32()), pa.array(s, pa.string())], ["doc_id", "toxic", "sentence"])


def training_sentences(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, sentence) of :func:`_sample`."""
    # about 2 * DOCS_A_LABEL ids, whatever the input: small enough to send to every task
    return docs.select("doc_id", "text").join(F.broadcast(_sample(labels)), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_sentences, "doc_id long, toxic int, sentence string")


def _sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of a bounded sample: per label about DOCS_A_LABEL documents, drawn by the hash of their ids.

    Only ids whose crc32 is not divisible by 5 are drawn from. A document with several labels counts as toxic if one says so.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_of_id() % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    share = F.when(F.col("toxic") == 1, min(1.0, DOCS_A_LABEL / n.get(1, 1))).otherwise(min(1.0, DOCS_A_LABEL / n.get(0, 1)))
    return usable.where(draw < share * 1_000_000).select("doc_id", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train in one task on at most SENTENCES_A_LABEL sentences of each label, then calibrate on the sample's documents.

    The driver gets the machine, about a megabyte, and one short row for each sampled document; the
    bounds hold at any input size.
    """
    sentences = training_sentences(docs, labels)
    order = [F.xxhash64("doc_id", "sentence"), "doc_id", "sentence"]
    parts = [sentences.where(f"toxic = {y}").orderBy(*order).limit(SENTENCES_A_LABEL) for y in (0, 1)]
    trained = parts[0].union(parts[1]).coalesce(1).mapInArrow(_train, "weights binary, bias double").collect()
    if not trained:
        return None
    model = Model(np.frombuffer(trained[0]["weights"], np.float32), trained[0]["bias"])
    sample = docs.select("doc_id", "text").join(F.broadcast(_sample(labels)), "doc_id")
    rows = sample.select("toxic", "text").mapInArrow(_describe(model), "toxic int, described array<double>").collect()
    model.scale = _logistic(np.array([r["described"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return model


def _described(model: Model, texts: list[str | None], cache: dict[bytes, float]) -> np.ndarray:
    """A row of the document's features for each text; ``cache`` keeps words' decisions between calls."""
    words = [words_of(t) if t else [] for t in texts]
    new = list(set().union(*words).difference(cache))
    if len(cache) + len(new) > 300_000:
        cache.clear()
        new = list(set().union(*words))
    split = [split_long(w) for w in new]
    flat = model.decide([p for ps in split for p in ps]) if new else []
    at = 0
    for w, ps in zip(new, split, strict=True):
        cache[w] = float(max(flat[at : at + len(ps)]))
        at += len(ps)
    return np.array([model.describe([cache[w] for w in set(ws)], len(ws)) for ws in words]).reshape(len(texts), TOP + 3)


def _describe(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in pieces(batches, "text"):
            rows = _described(model, batch.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(rows), pa.list_(pa.float64()))], ["toxic", "described"])

    return run


def _scores(model: Model | None, texts: list[str | None], cache: dict[bytes, float]) -> pa.Array:
    return pa.array(model.score(_described(model, texts, cache)) if model is not None else np.zeros(len(texts)))


def _score(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _scores(model, batch.column(1).to_pylist(), cache)], ["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text).

    A document's score is the calibrated probability of label 1 given the highest decisions among
    its distinct words and how many come near; whole texts are scored. Words are compared by subsequences of three
    letters spanning at most eight places, each place costing a factor, so inserted characters and
    gaps weaken a match instead of breaking it.

    Edge cases: null and empty texts score as a document without suspicious words. Without labels
    of both kinds nothing can be learned and every score is 0. A null doc_id gives held_out false.
    Repeated rows are scored each. Extra columns are ignored. Labels, lang, source and doc_id never
    enter a score.
    """
    model = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def toxicity_stage(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic; all columns stay, and so do rows with a null text."""
    model = fit(docs, labels)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in pieces(batches, "text"):
            yield batch.filter(pa.compute.less(_scores(model, batch.column("text").to_pylist(), cache), 0.5))

    return docs.mapInArrow(clean, docs.schema)
