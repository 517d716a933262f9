"""Token files, resampling by DuckDB counts, prefix trie: edge cases, brute force, layout of files."""

import collections
import glob
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postmill.llm import ngram_resampling, prefix_trie, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "   \n\t", "Hello, World! it's the '90s", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>x", "İstanbul ΣΑΣ ﬁ é x y z\x1cq\x85r", "x" * 5000, "日本語 текст ünïcödé 12345 ½", "a\x00b", "don't can't WE'LL", "... ?! .a. --", "word. word.) Été!!! Ça- été' a<| |>b \u0958x. ÷x."]


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def encoded(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def test_token_files(spark, definition, tmp_path):
    rng = random.Random(5)
    words = ["Alpha", "beta,", "GAMMA-ray", "naïve", "42", "<|endoftext|>", "x.y", "l'été"]
    docs = [(i, t, 1, "x") for i, t in enumerate(ODD)] + [(i, " ".join(rng.choices(words, k=rng.randrange(60))), 2, None) for i in range(20, 400)]
    docs += [(None, "no id", 0, ""), (-7, "before all", 0, ""), (30, "again", 0, ""), (30, "again", 0, "")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string, start int, part string").repartition(5)
    files = token_files.write_token_files(spark, df, definition, root=str(tmp_path / "t"), file_bytes=9000)
    got = sorted(files.placed(files.rows).collect(), key=lambda r: r.start)
    assert len(got) == len(docs) and files.manifest.count() > 3
    assert [r.doc_id is not None and r.doc_id for r in got] == sorted((d[0] is not None and d[0] for d in docs), key=lambda i: -math.inf if i is False else i)
    want = collections.defaultdict(list)
    for d, ids in zip(docs, encoded([d[1] for d in docs]), strict=True):
        want[d[0]].append(ids)
    found, at = collections.defaultdict(list), 0
    for r in got:
        assert (r.start, r.stop) == (at, at + len(r.ids))
        at = r.stop
        found[r.doc_id].append(list(r.ids))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    flat = [i for r in got for i in r.ids]
    for a, b in ((0, 1), (0, at), (100, 2500), (at - 3, at + 50), (7, 7), (at, at + 1)):
        rows = sorted(files.window(a, b).collect(), key=lambda r: r.start)
        assert [i for r in rows for i in r.ids] == flat[a:b] and all(r.stop - r.start == len(r.ids) for r in rows)
    assert {r.doc_id for r in files.documents(F.col("doc_id").between(25, 31)).collect()} == set(range(25, 32))
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in token_files.token_digests(files).collect()}
    assert sums == {(r.doc_id, r.start): (len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_encoder_forgets(definition, monkeypatch):
    monkeypatch.setattr(token_files, "_KNOWN", 40)
    encoder, rng = token_files.Encoder(definition, "<|endoftext|>"), random.Random(3)
    words = ["".join(rng.choices("abcé'.,-1<|>É", k=rng.randrange(1, 7))) for _ in range(300)]
    for _ in range(60):
        texts = [" ".join(rng.choices(words[: rng.choice([20, 300])], k=12)) for _ in range(5)]
        ids, n = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x[:-1] for x in encoded(texts)]


def test_token_file_layout(spark, definition, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of document"), "id").alias("text"))
    files = token_files.write_token_files(spark, df, definition, root=str(tmp_path / "t"))
    (path,) = glob.glob(f"{tmp_path}/t/tokens/*.parquet")
    group = pq.ParquetFile(path).metadata.row_group(0)
    columns = {group.column(i).path_in_schema.split(".")[0]: group.column(i) for i in range(group.num_columns)}
    assert "RLE_DICTIONARY" in columns["ids"].encodings and all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "start", "stop"))
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in re.search(r"ReadSchema: (.*)", plan(files.metadata())).group(1)
    assert "GreaterThan(doc_id,2990)" in plan(files.documents(F.col("doc_id") > 2990)) and "GreaterThan(stop," in plan(files.window(500, 600))


def test_token_files_of_nothing(spark, definition, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    files = token_files.write_token_files(spark, empty, definition, root=str(tmp_path / "t"))
    assert token_files.token_digests(files).collect() == [] == files.window(0, 9).collect()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(docs, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([d[1] for d in docs], target))
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in {*s, *t}}
    out = []
    for nth, (doc_id, text, *_) in enumerate(docs):
        words, f = features(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words), nth])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[6]))
    for i, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_ngram_resampling(spark):
    rng = random.Random(9)
    vocabulary = ["Ab", "été", "x1", "ÉCOLE", "語", "zeta", "a_b", "q'r", "77"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(45))), "clash", 1) for i in range(300)]
    docs += [(300, None, "", 2), (301, "", "", 2), (302, "!!! ---", "", 2), (None, "word " * 30, "", 3), (303, "long\x00er " * 30000, "", 3), (5, "twice " * 25, "", 1), (5, "twice " * 25, "", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rank string, weight int")
    target = spark.createDataFrame([("zeta x1 zeta",), (None,), ("ÉCOLE",)], "text string")
    got = sorted((tuple(r) for r in ngram_resampling.resample(spark, df, target).collect()), key=str)
    assert got == resampled(docs, ["zeta x1 zeta", None, "ÉCOLE"])
    ranks = sorted(r[4] for r in got if r[4] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_ngram_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ngram_resampling, "_RANGE", 50)
    docs = [(i % 150, f"w{i % 7} " * 25, None) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    ranks = [(r["rank"], -r.score, r.doc_id) for r in ngram_resampling.resample(spark, df, df.limit(20)).collect() if r["rank"]]
    assert [r[0] for r in sorted(ranks)] == list(range(1, 101)) and [r[1:] for r in sorted(ranks)] == sorted(r[1:] for r in ranks)


def test_ngram_resampling_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_resampling.resample(spark, empty, empty).collect() == []
    one = ngram_resampling.resample(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), empty).first()
    assert (one.n_features, one["rank"]) == (1, None)


def trie(rows):
    """The nodes by plain counting of prefixes."""
    turns = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + mine[h:]
    members = collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def nodes(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


@pytest.mark.parametrize("range_bytes", [300, 2000, 1 << 20])
def test_prefix_trie(spark, range_bytes):
    rng = random.Random(range_bytes)
    texts = ["a", "bé", "", None, "long " * 40]
    rows = [(c, t, rng.choice(["user", "assistant", None]) if rng.random() < 0.1 else ("user", "assistant")[t % 2], rng.choice(texts[: 1 + rng.randrange(5)]), "x", 1.0) for c in range(-12, 60) for t in range(rng.randrange(12))]
    rows += [(c, t, "user", "same", "y", None) for c in range(100, 160) for t in range(3)]  # copies over several ranges
    rows += [(c, t, "user", f"deep {t}", "y", None) for c in (200, 205, 210) for t in range(60)]  # one path through many ranges
    rows += [(300, None, None, None, None, None), (300, 1, "user", "b", None, None), (300, 1, "user", "b", None, None), (None, 1, "user", "lost", None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, n_convs double").repartition(7)
    assert nodes(prefix_trie.prefix_trie(spark, df, range_bytes=range_bytes)) == trie(rows)


def test_prefix_trie_of_little(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(spark, empty).collect() == []
    only = [(7, 0, "user", "x")]  # taken off by its share, and the family's first is absent
    assert nodes(prefix_trie.prefix_trie(spark, spark.createDataFrame(only, empty.schema))) == trie(only)
    pieces = [(c, 0, "user", "s") for c in range(100_000, 105_000)]
    assert nodes(prefix_trie.prefix_trie(spark, spark.createDataFrame(pieces, empty.schema), range_bytes=1 << 17)) == trie(pieces)


def test_turns_in_common():
    rng = random.Random(1)
    for _ in range(200):
        a, b = (b"".join(bytes([rng.randrange(2)]) * prefix_trie.WIDTH for _ in range(rng.randrange(9))) for _ in range(2))
        want = next((i for i in range(min(len(a), len(b)) // 32) if a[32 * i : 32 * i + 32] != b[32 * i : 32 * i + 32]), min(len(a), len(b)) // 32)
        assert prefix_trie.lcp(a, b) == want
