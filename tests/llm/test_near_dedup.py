import os
import random
import re
import threading

import numpy as np
import pytest

from postmill.llm import common, near_dedup
from postmill.llm.components import connected_components
from postmill.llm.common import Scratch
from postmill.llm.near_dedup import dedup_stage, near_duplicates, superminhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string"


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    s = {i: sets(t, n) for i, t in rows}
    top = {i: i for i in s}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 2, 3, 5, 40, 80, 200, 700):
        base = [rng.choice(vocab) for _ in range(size)]
        texts += [" ".join(base)] * 2 + [" ".join(base).upper()]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + size // 15)):
                copy[rng.randrange(size)] = rng.choice(vocab)
            texts.append(" ".join(copy))
    texts += ["", None, "  \n ", "a b c", "Ü ü"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n, sim", [(3, 0.85), (5, 0.8)])
def test_against_brute_force(spark, n, sim):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "en", "s", 0, "clash") for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in near_duplicates(spark, df, shingle_words=n, similarity=sim).collect()}
    want = brute(rows, n, round(sim * 100))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    kept = [r.doc_id for r in dedup_stage(spark, df, shingle_words=n, similarity=sim).collect()]
    assert sorted(kept) == sorted(i for i, (_, c) in want.items() if i == c)


def test_edges(spark):
    assert near_duplicates(spark, spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f", *[None] * 4), (1, "a b c d e f", *[None] * 4), (1, "a b c d e f", *[None] * 4), (2, None, *[None] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark, df).collect()), key=str)
    assert got == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 2, True)], key=str)
    assert sorted((r.doc_id for r in dedup_stage(spark, df).collect()), key=str) == [1, 2, None]


def test_an_id_with_several_texts_is_one_document(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (7, c), (7, "x y z v w"), (8, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark, df).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 7), (7, 7), (8, 7), (9, 3)]
    assert sorted((r.doc_id, r.text) for r in dedup_stage(spark, df).collect()) == [(3, a), (7, c), (7, "x y z v w")]


def test_a_bucket_of_many_unlinked_nodes(spark, monkeypatch):
    """Texts that share a long passage fall into common buckets but are not linked, but for some pairs."""
    monkeypatch.setattr(near_dedup, "ROOM", 7)
    rng = random.Random(5)
    words = lambda n: [f"u{rng.randrange(100_000)}" for _ in range(n)]
    shared, rows = words(150), []
    for i in range(0, 160, 2):
        own = words(60)
        rows += [(i, " ".join(shared + own)), (i + 1, " ".join(shared + own[:-2] if i % 6 == 0 else shared + words(60)))]
    rows.append((900, "word " * 40_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, 5, 80) and sum(c != i for i, (_, c) in got.items()) >= 26


def test_superminhash_is_a_permutation_of_ranks_and_estimates_similarity():
    rng = np.random.default_rng(0)
    one = superminhash(np.array([7], np.uint64), np.zeros(1, int), 1)[0]
    assert sorted(one.astype(int)) == list(range(128))
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)])
    h = superminhash(np.concatenate([a, b]), np.repeat([0, 1], 300), 2)
    assert abs((h[0] == h[1]).mean() - 240 / 360) < 0.15


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]}


def test_clashing_columns_and_bounds(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 7, "x"), (2, "a b c d e f g", 8, "y"), (3, "other words that stand alone here", 9, "z")], "doc_id long, text string, __text int, __text_ string")
    assert sorted(tuple(r) for r in near_dedup.dedup_stage(spark, df).collect()) == [(1, "a b c d e f g", 7, "x"), (3, "other words that stand alone here", 9, "z")]
    with pytest.raises(ValueError, match="bands"):
        near_dedup.bands_for(0.6)
    assert near_dedup.bands_for(0.8) == 22 and near_dedup.bands_for(1.0) == 1


def test_scratch_of_a_context(spark):
    made = []
    with common.discarded(spark):
        made.append(common.scratch_folder(spark, "inner"))
        thread = threading.Thread(target=lambda: made.append(common.scratch_folder(spark, "other")))
        thread.start()
        thread.join()
    there = [os.path.isdir(m.removeprefix("file:")) for m in made]
    assert there == [False, True]
