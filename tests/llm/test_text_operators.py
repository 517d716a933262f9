"""Importance, toxicity, language, decontamination, token counts."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from postmill.llm import decontaminate, importance, language_id, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, score double"


def words(rng, n, letters="etaoinshrdlu"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_toxicity_learns_and_bridges_gaps(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        t = words(rng, 60).split()
        toxic = i % 4 == 0
        if toxic:
            t[rng.randrange(60)] = rng.choice(["gronkle", "fizzbag", "mudwump"])
        docs.append((i, " ".join(t) + ".", "en", "s", 0.0))
        labels.append((i, 1, int(toxic)))
    docs += [(9001, None, None, None, None), (9002, "", None, None, None), (None, "x", None, None, None), (9003, "so you g.r.o.n.k.l.e now", None, None, None), (9004, "well f i z z b a g indeed", None, None, None), (9005, "q" * 50_000, None, None, None)]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(df, lab).collect()}
    assert len(got) == len(docs)
    right = [got[i].predicted == y for i, _, y in labels if got[i].held_out]
    assert len(right) > 80 and np.mean(right) > 0.97
    assert got[9003].predicted == 1 and got[9004].predicted == 1
    assert got[9001].predicted == got[9002].predicted == got[None].predicted == got[9005].predicted == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    kept = {r.doc_id for r in toxicity.toxicity_stage(spark, df, lab).collect()}
    assert 9003 not in kept and {9001, 9002, None} <= kept
    none = toxicity.toxicity(df, lab.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


@pytest.mark.parametrize(
    ("letters", "blank", "bad", "disguised"),
    [("оеаинтсрвлкмд", " ", ["бжуцык", "шпыргач", "ъяфщоз"], "ты б.ж.у.ц.ы.к вот"), ("αειονσρτκλ", " ", ["ψφξωβγ", "χζθδξη", "γδβπφψ"], "σε ψφ*ξωβγ να"), ("的一是不了在人有我他这中大来上个国到说们", "", ["蠢驴", "混蛋", "傻瓜"], "你是混蛋吗")],
)
def test_toxicity_learns_other_scripts(letters, blank, bad, disguised):
    rng = random.Random(11)
    one = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    sentences = []
    for i in range(600):
        w = [one() for _ in range(15)]
        if i % 4 == 0:
            w[rng.randrange(15)] = rng.choice(bad)
        sentences.append((i, int(i % 4 == 0), blank.join(w)))
    model = toxicity.train(sentences)
    assert model is not None
    worst = lambda t: model.decide(toxicity.words_of(t)).max()
    assert all(worst(blank.join([one(), b, one()])) > 0 for b in bad) and worst(disguised) > 0
    assert np.mean([worst(blank.join(one() for _ in range(15))) < 0 for _ in range(100)]) > 0.9


def subsequences(word):
    """Features of a word by plain enumeration: letters at three places that span no more than SPAN."""
    c = [int(x) for x in toxicity._codes([word])[0]]
    out = Counter()
    for i in range(len(c)):
        for j in range(i + 1, len(c)):
            for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                if c[i] and c[j] and c[k]:
                    out[(c[i] * toxicity._BASE + c[j]) * toxicity._BASE + c[k]] += toxicity.DECAY ** (k - i + 1)
    norm = sum(v * v for v in out.values()) ** 0.5
    return {k: v / norm for k, v in out.items()}


WORDS = [b"banana", b"gronkle", b"mississippi", b"aaaaaaaa", b"ab", b"g.r-o n_k l e", "\xe9t\xe9".encode("latin-1"), b"a" * 40, b"x", b"abcabcabc"]


def test_toxicity_features_match_enumeration():
    row, col, val = toxicity.features(WORDS)
    got = [{int(c): v for r, c, v in zip(row, col, val, strict=True) if r == i} for i in range(len(WORDS))]
    for g, w in zip(got, map(subsequences, WORDS), strict=True):
        assert g.keys() == w.keys() and all(abs(g[k] - w[k]) < 1e-9 for k in w)
    assert all(len(x) == 0 for x in toxicity.features([]))


def test_toxicity_decides_as_the_kernel_machine():
    landmarks = [b"banana", b"gronk", b"missis", b"ipissa"]
    alpha = np.array([0.5, -1.25, 2.0, 0.75])
    model = toxicity.Model(toxicity.collapse(landmarks, alpha), -0.125)
    feats = list(map(subsequences, landmarks))
    plain = [sum(a * sum(v * f.get(k, 0) for k, v in subsequences(w).items()) for a, f in zip(alpha, feats, strict=True)) - 0.125 for w in WORDS]
    assert np.abs(model.decide(WORDS) - plain).max() < 1e-3
    assert np.abs(model.decide(WORDS) - (toxicity.kernel(WORDS, landmarks) @ alpha - 0.125)).max() < 1e-3


def test_toxicity_of_no_documents(spark):
    df, lab = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(df, lab).count() == 0 and toxicity.toxicity_stage(spark, df, lab).count() == 0


def test_language(spark):
    rng = random.Random(2)
    docs = [(i, words(rng, 30, "etaoin" if i % 2 else "xyzwvuk"), "aa" if i % 2 else "bb", "s", 0.0) for i in range(400)]
    docs += [(9001, None, "aa", None, None), (9002, "12 34 !", None, None, None), (None, "tea one", None, None, None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(docs, DOCS)).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(400))
    assert got[9001].lang_pred == got[9002].lang_pred == "und" and got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].held_out == (zlib.crc32(b"2") % 4 == 2)
    assert [r.lang_pred for r in language_id.language_id(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).collect()] == ["und"]


def plain_bayes(model, text):
    cp = np.array([ord(c) for c in f" {text.lower()} "], np.uint32)
    return sum(model.weights[language_id._buckets(cp, n)].astype(np.int64).sum(axis=0) for n in language_id.LENGTHS if len(cp) >= n) * language_id.UNIT


def test_language_scores_match_plain_bayes(monkeypatch):
    table = np.random.default_rng(0).integers(1, 50, (language_id.BUCKETS, 2)).astype(float)
    m = language_id.Model(["a", "b"], language_id.weigh(table), np.zeros(2))
    assert np.abs(m.weights[:-1] * language_id.UNIT - np.log(table / table.sum(axis=0))).max() < 1e-6
    texts = ["Hello there", "x", "ab", "zq", "né", "an odd ünïcode text", "漢字", "long " * 300]
    want = np.array([plain_bayes(m, t) for t in texts])
    for chunk in (1 << 18, 5, 1):  # however the batch is cut, and whatever stands next to a text
        monkeypatch.setattr(language_id, "_CHUNK", chunk)
        assert (language_id.log_likelihoods(m, texts) == want).all()
        assert (language_id.log_likelihoods(m, texts[::-1]) == want[::-1]).all()


def test_language_counts_end_with_their_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "b", "a"]), pa.array(["xy", "z", "xyz", ""])], ["lang", "text"])
    got = {(la, b): n for r in language_id._counts(iter([batch])) for la, b, n in zip(*(c.to_pylist() for c in r.columns), strict=True)}
    want = Counter()
    for la, t in (("a", "xy"), ("a", "z"), ("b", "xyz")):
        cp = np.array([ord(c) for c in f" {t} "], np.uint32)
        for n in language_id.LENGTHS:
            want.update((la, int(b)) for b in (language_id._buckets(cp, n) if len(cp) >= n else []))
    assert got == want


def test_language_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(3)
    docs = [(i, words(rng, 1 + i % 40, "etaoin" if i % 2 else "xyzwvuk"), "aa" if i % 2 else "bb", "s", 0.0) for i in range(300)] + [(500 + i, t, None, None, None) for i, t in enumerate(["a", "x", "ta", "é", "long " * 5000, "", "a", "a"])]
    run = lambda rows, n: {(r.doc_id, r.lang_pred, r.score) for r in language_id.language_id(spark.createDataFrame(rows, DOCS).repartition(n)).collect()}
    first = run(docs, 1)
    assert len(first) == len(docs) and run(docs[::-1], 5) == first
    assert language_id.language_id(spark.createDataFrame([], DOCS)).count() == 0


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, words(rng, 30)) for i in range(20)] + [(20, "too short"), (21, None)]
    items.append((22, items[0][1].upper()))
    docs = []
    for i in range(60):
        body = words(rng, 150).split()
        if i % 3 == 0:
            leak = items[i % 20][1].split()
            for _ in range(i % 7):
                leak[rng.randrange(30)] = "edited"
            body[40:40] = leak
        docs.append((i, " ".join(body), "en", "s", 0.0))
    docs += [(900, None, *[None] * 3), (901, "", *[None] * 3), (None, items[1][1], *[None] * 3)]
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark, df, bench).collect()
    want = {(i, i % 20) for i in range(0, 60, 3)} | {(i, 22) for i in range(0, 60, 3) if i % 20 == 0}
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score == 1 for r in got if r.doc_id % 7 == 0)
    left = decontaminate.decontaminate_stage(spark, df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, *_ in docs} - {i for i, _ in want}
    assert decontaminate.contamination(spark, df, bench.limit(0)).count() == 0
    assert decontaminate.contamination(spark, df.limit(0), bench).count() == 0


def test_decontamination_aligns_copies_of_common_seeds(spark):
    rng = random.Random(8)
    item = words(rng, 40).split()
    whole, half = " ".join(item), " ".join(item[:20])
    # the first half leaks into more documents than the second, and both into many
    docs = [(i, f"{words(rng, 30)} {whole} {words(rng, 30)}") for i in range(60)] + [(100 + i, f"{words(rng, 30)} {half} {words(rng, 30)}") for i in range(60)]
    bench = spark.createDataFrame([(1, whole)], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got.keys() == {i for i, _ in docs} and got[0] == 1 and got[100] >= 0.5
    alone = decontaminate.contamination(spark, spark.createDataFrame(docs[-1:], "doc_id long, text string"), bench).collect()
    assert [(r.doc_id, r.score) for r in alone] == [(159, got[159])]


def test_decontamination_of_an_item_of_two_seeds(spark):
    rng = random.Random(9)
    # the trigram that both items have is in 61 documents
    item, other = "gamma delta epsilon zeta", "gamma delta epsilon eta"
    docs = [(i, f"{words(rng, 20)} {other} {words(rng, 20)}") for i in range(60)] + [(100, f"{words(rng, 20)} {item} {words(rng, 20)}")]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    got = decontaminate.contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.score, r.n_seeds) for r in got} == {(100, 1, 1.0, 2)} | {(i, 2, 1.0, 2) for i in range(60)}


def test_decontamination_finds_parts_of_long_items(spark):
    rng = random.Random(10)
    long, middle = words(rng, 400).split(), words(rng, 59).split()
    parts = {1: long[100:150], 2: middle[30:55], 3: long[200:210], 4: [w for i, w in enumerate(long[:60]) if i % 10]}
    docs = spark.createDataFrame([(i, f"{words(rng, 50)} {' '.join(p)} {words(rng, 50)}") for i, p in parts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(middle))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contamination(spark, docs, bench).collect()}
    assert got.keys() == {(1, 1), (2, 2), (4, 1)} and got[1, 1] >= 0.125 and got[2, 2] < decontaminate.SIMILARITY


def test_alignment_against_plain_smith_waterman():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)) for _ in range(60)]
    got, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), score in zip(pairs, got, strict=True):
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert score == h.max()


def test_edits_recount_as_from_scratch():
    try:
        c = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    except OSError:
        pytest.skip("no vocabulary file")
    rng = random.Random(5)
    bits = ["don't", " we", "  ", "\n\n", "12", "é", "'", "re", "x", " \t", "漢字", "…", "s ", "ll", "🙂"]
    for _ in range(150):
        t = token_counts.Tree(c, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 400))))
        for _ in range(12):
            t.edit(rng.randrange(0, len(t.text) + 3), rng.randrange(0, 30), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 6))))
            assert t.total == len(c.encoding.encode_ordinary(t.text))
            assert [n for x, _ in t.leaves for n in x] == c.pieces(t.text)[0]
    long = token_counts.Tree(c, "some words in a row. " * 5000)
    assert long.edit(50_000, 3, "new") < 20


def test_token_counts_query_edges(spark):
    df = token_counts.with_edits(spark.createDataFrame([(1, "abc def"), (2, None), (3, "x")], "doc_id long, text string"), spark.createDataFrame([(1, 2, 0, 3, ""), (1, 1, 0, 0, "zz "), (2, 1, 5, 1, "new text")], "doc_id long, seq int, start int, length int, replacement string"))
    got = {r.doc_id: r for r in token_counts.token_counts(df).collect()}
    assert got[2].n_tokens == 0 and got[2].n_tokens_edited == 2 and got[3].n_edits == 0 and got[1].n_edits == 2
    assert got[1].n_chars_added == 0


def test_kth_largest(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(importance, "_FEW", 100)
    near = float(np.nextafter(1.0, 2.0))
    for values in ([rng.choice([rng.random(), 0.5, 3.0]) for _ in range(3000)], [1.0] * 150 + [near] * 150, [-near] * 150 + [-1.0] * 150 + [0.0, -0.0, 5e-324] * 60):
        df = spark.createDataFrame([(v,) for v in values], "v double").cache()
        for k in {1, 2, 200, len(values) // 2, len(values) - 1, len(values)}:
            assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(df, "v", len(values) + 1) is None


def test_resampling(spark):
    rng = random.Random(6)
    docs = [(i, words(rng, 80) if i % 5 else words(rng, 80, "qxzj"), "en", "s", 0.0) for i in range(300)] + [(900, None, *[None] * 3), (901, "", *[None] * 3), (902, "zz " * 30_000, *[None] * 3), (None, "x", *[None] * 3)]
    docs += [docs[7]] * 2
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = importance.importance_resample(spark, df, lab).collect()
    assert len(got) == len(docs) and sum(r.selected for r in got) >= round(0.8 * len(docs))
    junk = [r.selected for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0]
    # 245 rows are drawn and only 244 are no junk
    assert np.mean(junk) <= 0.1 and len({(r.selected, r.sampling_key) for r in got if r.doc_id == 7}) == 1
    # the weights by plain counting: the ratio of two smoothed multinomials over words and neighbours
    raw, target = Counter(), Counter()
    grams = {t: Counter(importance.buckets(t.encode() if t else None).tolist()) for _, t, *_ in docs}
    for i, t, *_ in docs:
        raw.update(grams[t])
        if (i, 1, 0) in labels:
            target.update(grams[t])
    p = lambda c, b: (c[b] + importance.SMOOTH) / (sum(c.values()) + importance.SMOOTH * importance.BUCKETS)
    text = {i: t for i, t, *_ in docs}
    for r in got:
        assert abs(r.log_weight - sum(n * np.log(p(target, b) / p(raw, b)) for b, n in grams[text[r.doc_id]].items())) < 1e-6 * max(1, r.n_grams)
    assert importance.importance_resample(spark, spark.createDataFrame([], DOCS), lab).count() == 0
    even = importance.importance_resample(spark, df, lab.limit(0)).collect()
    assert {r.log_weight for r in even} == {0.0} and sum(r.selected for r in even) >= round(0.8 * len(docs))


def test_the_draw_is_in_proportion_to_the_weights(spark):
    """Of pairs that differ by a known weight the heavier one has the higher key in its share of the draws."""
    n, gap = 4000, np.log(3.0)
    u = spark.range(2 * n).select((importance.F.pmod(importance.F.xxhash64("id", importance.F.lit(importance.SEED)), importance.F.lit(1 << 52)) + 0.5) / float(1 << 52))
    g = -np.log(-np.log(np.array([r[0] for r in u.collect()])))
    assert abs((g[:n] + gap > g[n:]).mean() - 0.75) < 0.03


def test_decontamination_edges(spark):
    rng = random.Random(13)
    a, b = words(rng, 30), words(rng, 30)
    docs = spark.createDataFrame([(1, a, 0.0), (1, b, 0.0), (1, b, 0.0), (2, f"{words(rng, 40_000)} {a} {words(rng, 10)}", 0.0), (3, "", 0.0)], "doc_id long, text string, score double")
    bench = spark.createDataFrame([(10, a, "clash"), (11, b, "clash"), (10, a, "clash")], "item_id long, text string, doc_id string")
    got = sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.contamination(spark, docs, bench).collect())
    assert got == [(1, 10, 1.0), (1, 11, 1.0), (2, 10, 1.0)]


def test_decontamination_of_paraphrases_against_all_pairs(spark):
    """Every pair of a document and an item is aligned by brute force; none that reaches the threshold is missed for want of seeds, but a counted few."""
    rng = random.Random(14)
    items = [(i, words(rng, 40)) for i in range(12)]
    docs = []
    for i in range(120):
        copy = items[i % 12][1].split()
        for _ in range(i // 8):  # up to 14 of 40 words replaced, and as many inserted
            copy[rng.randrange(len(copy))] = words(rng, 1)
            copy.insert(rng.randrange(len(copy)), words(rng, 1))
        docs.append((i, f"{words(rng, 60)} {' '.join(copy)} {words(rng, 60)}"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    pairs = [(d, i) for d, _ in docs for i, _ in items]
    t, it = dict(docs), dict(items)
    score, _ = decontaminate.align([decontaminate.words(it[i].encode()) for _, i in pairs], [decontaminate.words(t[d].encode()) for d, _ in pairs])
    want = {p for p, s in zip(pairs, score, strict=True) if s >= min(decontaminate.MATCH * decontaminate.LONG, decontaminate.SIMILARITY * decontaminate.MATCH * len(it[p[1]].split()))}
    assert got <= want and len(got) >= 0.95 * len(want) > 60


def test_token_counts_edges(spark):
    schema = f"doc_id long, text string, edits {token_counts.EDITS}, n_tokens string"
    none = [(0, 0, 0, None)]
    rows = [(1, "word " * 50_000, none, "clash"), (None, "a", None, "clash"), (2, "same", [], "x"), (2, "same", [], "x"), (3, "", [(1, None, None, "new")], None)]
    got = token_counts.token_counts(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_tokens_edited) for r in got) == [(0, 1, 1), (1, got[0].n_tokens, got[0].n_tokens), (2, 1, 1), (2, 1, 1), (3, 0, 1)]
    assert token_counts.token_counts(spark.createDataFrame([], schema)).count() == 0
