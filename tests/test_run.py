"""The snapshot store and whole runs."""

import json

import pytest
from pyspark.sql import functions as F

from postmill.operators import run as runs
from postmill.sources.store import SnapshotStore


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), "k", 8)
    assert store.read() is None and store.versions() == []
    told = store.upsert(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    assert (told["rows"], told["new"], told["buckets"]) == (200, 200, 8)
    before = store._version()["buckets"]
    told = store.upsert(spark.createDataFrame([("7", 2, "x"), (None, 3, "lost")], "k string, v int, note string"), observe={"seen": F.count(F.lit(1)), "top": F.max("v")})
    after = store._version()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 == told["buckets"] and told["new"] == 0 and (told["seen"], told["top"]) == (1, 2) and told["rows"] < 60
    assert store.read().count() == 200 and rows(store.read().where("k in ('7', '8')")) == {("7", 2, "x"), ("8", 1, None)}
    assert store.read(1).count() == 200 and "note" not in store.read(1).columns
    with pytest.raises(ValueError, match="another type"):
        store.upsert(spark.createDataFrame([("7", "text")], "k string, v string"))
    with pytest.raises(ValueError, match="buckets"):
        SnapshotStore(spark, str(tmp_path / "s"), "k", 4).upsert(spark.createDataFrame([("7", 1)], "k string, v int"))


def test_store_commits_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), "k", 2)
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    store.upsert(one)
    with pytest.raises(FileExistsError):
        store._publish({"n": 1, "schema": None, "buckets": {}, "of": 2})
    assert store.versions() == [1] and rows(store.read()) == {("a", 1)}
    store.upsert(one.limit(0))
    assert store.versions() == [1]


def test_run(spark, tmp_path):
    def feed(name, jobs):
        (tmp_path / name).write_text(json.dumps(jobs))
        return str(tmp_path / name)

    good = {"title": "Machine Learning Intern", "company": "C", "location": "Bengaluru, India", "employment_type": "Internship", "description": "Python and Docker, deep learning. January 2026 - June 2026. Apply by 2027-01-05"}
    path = feed("a.json", [good | {"id": "1"}, good | {"id": "2", "title": "Senior Engineer", "employment_type": "FullTime"}, good | {"id": "3", "description": "Applications are now closed."}, good | {"id": "1", "title": "again"}])
    store, log = SnapshotStore(spark, str(tmp_path / "p"), "stable_id", 4), SnapshotStore(spark, str(tmp_path / "r"), "id", 1)
    known, at = F.array(F.lit("Python"), F.lit("Machine Learning"), F.lit("Deep Learning")), lambda day: F.lit(f"2026-01-0{day} 00:00:00").cast("timestamp")
    first = runs.run(spark, [("local", {"path": path}), ("nowhere", {})], store, known, at(1), runs=log)
    assert first.stats == {"discovered": 3, "eligible": 1, "shortlisted": 1, "strong": 1, "new": 3, "rows": 3, "sources_ok": 1, "sources_failed": 1, "sources_skipped": 0}
    got = {r.stable_id: r for r in first.postings.collect()}
    assert got["local:1"].deadline == "2027-01-05" and got["local:1"].band == "strong" and got["local:3"].open_state == "closed" and got["local:2"].score is None
    assert [r.stable_id for r in first.shortlisted.collect()] == ["local:1"]
    # the posting closes: it keeps its score and first_seen, and leaves the shortlist
    again = feed("b.json", {"jobs": [good | {"id": "1", "description": "Applications are now closed."}, good | {"id": "4"}]})
    second = runs.run(spark, [("local", {"path": again})], store, known, at(2), runs=log, limit=0)
    assert (second.stats["discovered"], second.stats["new"], second.stats["eligible"], second.stats["shortlisted"]) == (2, 1, 1, 0)
    now = {r.stable_id: r for r in store.read().collect()}
    assert set(now) == {f"local:{i}" for i in (1, 2, 3, 4)} and not now["local:1"].eligible and now["local:1"].score == got["local:1"].score and now["local:1"].first_seen == got["local:1"].first_seen
    assert [(r.id, r.mode, r.finished_at is not None, r.stats["new"]) for r in log.read().orderBy("id").collect()] == [(1, "run", True, 3), (2, "run", True, 1)]
    nothing = runs.run(spark, [], store, known, at(3), runs=log)
    assert nothing.stats["discovered"] == 0 and store.read().count() == 4
