"""Sharding, chat formatting, mixing, exact search, the pipeline."""

import collections
import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from postmill.llm import chat_format, mixing, registry, sharding, topk_search
from tests.llm.test_near_dedup import brute
from tests.test_queries import rows as plain_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    assert plain_rows(registry.QUERIES[name](spark, SF).toPandas()) == plain_rows(con.sql(registry.ORACLE_SQL[name]).df())


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "␛␛<|end|>␛", "<<|turn|>", "[[INST]", "a\n<|body|>b", None, "", "<SYS>>"]
    msgs = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)] + [(2, None, None, "x"), (None, 0, "user", "y")]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(chat_format.text_messages(df))).collect()}
    assert [t.text for t in got[1].turns] == [t or "" for t in texts]
    assert got[1].loss == [t or "" for t in texts[::2]]
    assert got[1].formatted.count("<|end|>") == len(texts) and "[INST]" not in got[1].formatted
    assert got[2].turns[0].role == "" and got[None].turns[0].text == "y"


def test_chat_attachments(spark):
    part = lambda kind, text=None, ref=None, w=None, h=None, s=None, p=None: (kind, text, ref, w, h, s, p)
    df = spark.createDataFrame([(1, 0, "user", [part("text", "see "), part("image", ref="i.png", w=56, h=30), part("audio", ref="a.wav", s=2.0)]), (1, 1, "assistant", [part("text", "<|image|>")]), (1, 2, "user", [part("document", ref="d.pdf", p=2)])], f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    r = chat_format.format_chats(df).first()
    assert [(a.ordinal, a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "i.png", 4), (1, 0, "audio", "a.wav", 50), (2, 2, "document", "d.pdf", 1024)]
    assert r.expanded_tokens == 1078 and r.formatted.count("<|image|>") == 1


def test_shards_are_versioned(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (i % 50 + 1), "clash") for i in range(400)] + [(None, None, None)], "doc_id long, text string, shard_id string")
    out = sharding.shard_documents(spark, docs, root=str(tmp_path / "s"), target_bytes=3000, arrival=sharding.arrival_of(20)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter([*range(400), None])
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.versions() == [1, 2] and store.documents(1).count() == 401 == store.documents(2).count()
    sizes = [r.n_bytes for r in store.manifest().collect()]
    assert sum(sizes) == sum(i % 50 + 1 for i in range(400)) and max(sizes) < 2 * 3000
    with pytest.raises(FileExistsError):
        store.commit(store.manifest(), 1, docs.schema)
    store.append(docs.limit(5), sharding.F.lit(77))
    assert store.documents().count() == 406 and store.documents(2).count() == 401
    assert sharding.shard_documents(spark, docs.limit(0)).count() == 0


def test_an_interrupted_commit_changes_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 200) for i in range(40)], "doc_id long, text string")
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    assert store.versions() == [] and store.manifest().count() == 0
    store.append(docs, sharding.arrival_of(10))
    # a writer that dies before it publishes leaves a staged file, which readers and writers pass by
    lost = store.stage(store.manifest(), docs.schema)
    assert store.versions() == [1] and store.documents().count() == 40
    store.append(docs.limit(3), sharding.F.lit(9))
    assert store.versions() == [1, 2] and store.documents().count() == 43
    # one that wakes up again comes second
    with pytest.raises(FileExistsError):
        store.publish(lost, 1)
    with pytest.raises(ValueError):
        store.publish(lost, 7)
    assert store.documents().count() == 43 and store.documents(1).count() == 40


def test_shards_of_other_columns(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), sharding.arrival_of())
    store.append(spark.createDataFrame([(2, "b" * 100_000, "new", "x")], f"doc_id long, text string, lang string, {sharding.SHARD} string"), sharding.arrival_of())
    store.compact()
    assert sorted((r.doc_id, len(r.text), r.lang) for r in store.documents().collect()) == [(1, 1, None), (1, 1, None), (2, 100_000, "new")]
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(3, 4)], "doc_id long, text long"), sharding.arrival_of())


def test_a_merged_shard_is_the_work_of_several_tasks(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(400)], "doc_id long, text string").repartition(8)
    store = sharding.ShardStore(spark, str(tmp_path / "s"))
    store.append(docs, sharding.F.spark_partition_id().cast("long"))
    files = lambda: collections.Counter(os.path.dirname(f) for f in store.documents().inputFiles() if sharding.BATCH in f)
    assert len(files()) == 8 and set(files().values()) == {1}  # no file for each pair of task and shard
    store.compact(1_000_000)
    assert len(files()) == 1 and 2 <= max(files().values()) <= sharding.FILES and store.documents().count() == 400


def test_running_sum(spark):
    rng = random.Random(3)
    rows = [(g, o, rng.randrange(9)) for g in "ab" for o in rng.sample(range(9000), 300)]
    df = spark.createDataFrame(rows, "g string, o long, v long")
    for r in sharding.running_sum(df, ["g"], sharding.F.floor(sharding.F.col("o") / 1024), ["o"], "v", "s").collect():
        assert r.s == sum(v for g, o, v in rows if g == r.g and o < r.o)


def test_mixing(spark):
    rng = random.Random(8)
    docs = [(i, " ".join("w" * rng.randrange(1, 30)), "big" if i % 3 else f"s{i % 7}", i) for i in range(3000)] + [(9000, None, None, 0), (9001, "", "big", 0), (None, "a b", "s1", 0)]
    docs += [(9002, "long " * 20_000, "big", 0), (9003, "a tie", "s1", 0), (9003, "a tie", "s1", 0)]
    df = mixing.counted(spark.createDataFrame(docs, "doc_id long, text string, source string, mix_block long"))
    got = mixing.mix(spark, df, max_repeats=1.5).collect()
    n = collections.Counter(r.doc_id for r in got)
    assert set(n) == {d for d, *_ in docs}  # every document is there
    assert max(v for d, v in n.items() if d != 9003) <= 2 and 2 <= n[9003] <= 4 and n[9000] == n[9001] == 1
    by = collections.defaultdict(list)
    for r in got:
        if r.mix_tokens:
            by[r.source].append((r.mix_offset, r.mix_tokens))
    for spans in by.values():  # offsets follow each other without gaps
        spans.sort()
        assert all(a + b == c for (a, b), (c, _) in zip(spans, spans[1:], strict=False))
    tokens = {s: sum(len(t.split()) for _, t, x, _ in docs if x == s and t) for s in by}
    repeats = {s: sum(t for _, t in v) / tokens[s] for s, v in by.items()}
    assert max(repeats.values()) <= 1.51 and abs(repeats["big"] - 1) < 0.01
    assert mixing.mix(spark, df.limit(0)).count() == 0
    kept = mixing.mixing_stage(spark, spark.createDataFrame(docs, "doc_id long, text string, source string, mix_block long"))
    assert kept.columns == ["doc_id", "text", "source", "mix_block"] and {(r.doc_id, r.mix_block) for r in kept.collect()} == {(d, b) for d, _, _, b in docs}


def test_entropy_search(spark):
    stats = spark.createDataFrame([("a", 900, 1), ("b", 90, 1), ("c", 10, 1)], "src string, tokens long, docs long")
    t = mixing.solve_exponent(stats, min_entropy=0.9)
    w = [(x / 1000) ** t for x in (900, 90, 10)]
    q = [x / sum(w) for x in w]
    assert abs(-sum(x * math.log(x) for x in q) - 0.9) < 1e-5


def brute_top_k(vecs, k=10, scale=1024):
    """{query: [(vec_id, score)]}: a row of another id is a candidate each time it stands."""
    whole = lambda x: math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale
    ok = [(i, [whole(x) for x in v]) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    return {q: [(i, -s) for s, i in sorted((-sum(map(int.__mul__, own, v)), i) for i, v in ok if i != q and len(v) == len(own))[:k]] for q, own in ok if q % 100 == 0}


def found_top_k(df, **more):
    got = collections.defaultdict(list)
    for r in topk_search.top_k(df.sparkSession, df, **more).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return dict(got)


def test_top_k_edges(spark):
    rng = random.Random(9)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(600)] + [(600 + i, [0.5] * 8) for i in range(60)]
    vecs += [(700, None), (800, [None] * 8), (900, [float("nan")] * 8), (1000, [1.0, 2.0]), (1200, []), (1201, []), (None, [1.0] * 8), (1100, [3e5] * 8), (1300, [float("inf")] * 8)]
    vecs += [vecs[5]] * 3 + [vecs[100]] * 2 + [vecs[610]] * 12
    df = spark.createDataFrame([(*v, "x") for v in vecs], "vec_id long, embedding array<double>, dim string")
    want = brute_top_k(vecs)
    assert found_top_k(df) == {q: w for q, w in want.items() if w} and sum(v == vecs[5][0] for v, _ in want[1100]) in (0, 4)
    assert not {700, 800, 900, 1000, 1300} & found_top_k(df).keys() and topk_search.top_k(spark, df.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    rng = random.Random(10)
    vecs = [(i, [rng.gauss(0, 1) * 10 ** rng.choice([0, 3, 8, 17]) for _ in range(4)]) for i in range(300)]
    vecs += [(1000, [1e17] * 4), (1100, [-1e17, 1e17, 1.0, 1.0]), (1200, [1.7e308] * 4), (1201, [-1.7e308, 1.7e308, 1e308, 3.0]), (1300, [2.0**60, 1.0, 0.0, 0.0]), (1301, [2.0**60, 1.0, 0.0, 0.0]), (1302, [2.0**60, 1.0009765625, 0.0, 0.0])]
    got = found_top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"))
    clamp = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    assert got == {q: [(i, clamp(s)) for i, s in w] for q, w in brute_top_k(vecs).items()}


def test_top_k_in_many_blocks(spark, monkeypatch):
    rng = random.Random(11)
    centres = [[rng.gauss(0, 4) for _ in range(6)] for _ in range(8)]
    vecs = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(0, 9000, 7)] + [(100_000 + i, centres[0]) for i in range(900)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk_search, "BLOCK_CELLS", 6 * 64)
    assert found_top_k(df) == brute_top_k(vecs)


def test_cover_tree_search_prunes():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(64, 4)) * 50, 200, axis=0) + rng.normal(size=(12800, 4))
    q, r = (topk_search.Block(ids, v, np.ones(len(v), int), 1024, leaf) for ids, v, leaf in ((np.arange(0, 12800, 50), x[::50], 16), (np.arange(12800), x, 64)))
    met = []
    topk_search._pairs(q, r, np.full(len(q.ids), np.float64(q.norms.min() * r.norms.max())), 1e-12, lambda *a: met.append(a))
    leaves = lambda t: sum(not n[5] for n in t.tree.nodes)
    assert len(met) < 0.4 * leaves(q) * leaves(r)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    """Each stage's decisions on what its predecessor kept, against the operators and against brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard_id"]
    got = out.collect()
    ids = {r.doc_id for r in got}
    toxic = {r.doc_id for r in registry.QUERIES["op3_toxicity"](spark, SF).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in toxic}
    one = {i for i, (_, c) in brute(sorted(texts.items()), 5, 80).items() if i == c}
    leaks = {r.doc_id for r in registry.QUERIES["op5_benchmark_decontamination"](spark, SF).collect()}
    assert ids == one - leaks and len(ids) > 0.7 * docs.count()
    assert all(r.text == texts[r.doc_id] for r in got) and max(collections.Counter(r.doc_id for r in got).values()) <= 2


def test_pipeline_edges(spark, tmp_path):
    """Null texts, no labels, clashing and extra columns, repeated rows, a very long text; then no documents at all."""
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i, text(50), "en", "s", 1, "a", 1.5) for i in range(40)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "s", 0, "b", 0.5), (None, "no id", "en", None, 1, "c", 0.1), (102, text(60_000), "en", "s", 1, "d", 2.0), rows[3], rows[3], (200, rows[5][1], "en", "s", 1, "e", 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard_id string, mix_epoch double"
    put = lambda name, r, s: spark.createDataFrame(r, s).write.parquet(f"{tmp_path}/{name}.parquet")
    put("full/documents", rows, schema)
    put("none/documents", [], schema)
    for d in ("full", "none"):
        put(f"{d}/labels", [], "doc_id long, quality int, toxic int")
        put(f"{d}/benchmark", [(1, " ".join(rows[7][1].split()[10:40]))], "item_id long, text string")
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_epoch", "shard_id"]
    assert {(r.doc_id, r.mix_epoch) for r in out.collect()} == {(r[0], r[6]) for r in rows if r[0] not in (7, 200)}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_shards_of_any_ids(spark):
    docs = [(-1, "a"), (-10**15, "b"), (9 * 10**18, "c"), (9 * 10**15, "d"), (2**63 - 1, "e"), (-(2**63), "f"), (None, None), (0, "g"), (5, "long " * 400_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.shard_id) for r in sharding.shard_documents(spark, df, target_bytes=50, arrival=sharding.F.coalesce("doc_id", sharding.F.lit(7))).collect()}
    assert {k: v[0] for k, v in got.items()} == dict(docs)
    apart = sharding.shard_documents(spark, df, target_bytes=1, arrival=sharding.F.coalesce("doc_id", sharding.F.lit(7))).collect()
    assert len({r.shard_id for r in apart}) == len(docs)
    assert sorted(r.doc_id is None or r.doc_id for r in sharding.shard_documents(spark, df).collect()) == sorted(d[0] is None or d[0] for d in docs)


def test_mixing_of_clashing_columns_and_no_ids(spark):
    docs = [(None, "w " * (i % 7), "s", i, -i, str(i)) for i in range(5000)] + [(3, "w", None, 1, 2, "x")] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, mix_x long, kept_mix_x long, kept____________0 string")
    out = mixing.mixing_stage(spark, df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} == set(docs)
    rows = mixing.Scratch(spark, "t").keep(mixing.counted(df))
    drawn = mixing.mix(spark, rows).where("source = 's'")
    assert "mix_nth" not in drawn.columns and drawn.where("mix_tokens > 0").groupBy("mix_epoch", "mix_offset").count().where("count > 1").count() == 0


def test_long_conversation(spark):
    n = 4000
    texts = ["é<|end|>" * (i % 5) + f"{i} [INST]" for i in range(n)]
    df = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    r = chat_format.read_back(chat_format.format_chats(chat_format.text_messages(df))).first()
    assert [t.text for t in r.turns] == texts and r.loss == texts[1::2]
    for s in r.loss_spans[:: n // 40]:  # the places over the whole string say the same
        piece = r.formatted.split("<|end|>")[s.turn]
        assert r.formatted[s.start : s.start + s.length] == piece[s.offset : s.offset + s.length]


def test_chats_of_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string, parts int"
    assert chat_format.format_chats(chat_format.text_messages(spark.createDataFrame([], schema))).collect() == []
    long = "x<|turn|>" * 200_000
    r = chat_format.read_back(chat_format.format_chats(chat_format.text_messages(spark.createDataFrame([(1, 0, "assistant", long, "clash", 1)], schema)))).first()
    assert r.loss == [long]
