"""What keeps the queries' work and files in proportion: small cases that stand for larger tables."""

import glob
import json
import os

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from postmill.functions.temporal import registration
from postmill.operators import reports
from postmill.operators import run as runs
from postmill.session import checkpoint_root
from postmill.sources import pages, readers, scan
from postmill.sources.store import SnapshotStore


def customers(spark, path, n):
    spark.range(1, n + 1, numPartitions=1).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"), (F.col("id") * 7 % 25).cast("int").alias("c_nationkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment")).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_files_of_unequal_feed_are_bounded(spark, tmp_path):
    got = {r.stable_id: int(r.title) for r in entry.registry.QUERIES["scan_survivors"](spark, customers(spark, tmp_path, 3000)).collect()}
    assert got == {f"local:{k % 40}": k for k in range(40, 0, -1)}
    files = max(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/feed-*/unequal"), key=lambda p: len(glob.glob(f"{p}/*/*.txt")))
    jobs = [open(f).read().count('"title"') for f in glob.glob(f"{files}/*/*.txt")]
    assert sum(jobs) == 3000 and max(jobs) <= 500


def test_heat_map_lines_keep_their_width(spark):
    heat = spark.createDataFrame([("a", 1234, 1234.0), ("b", 5, 2.5), ("c", 1, 0.5)], "skill string, jobs long, weight double")
    assert [r.line for r in reports.heatmap_lines(heat, 2).collect()] == ["a".ljust(24) + "  1234" + "   1234.00", "b".ljust(24) + "     5" + "      2.50", "... 1 more"]


def test_costly_rows_are_dealt_by_number(spark, tmp_path):
    customers(spark, tmp_path, 25_000)
    spark.range(1, 25_001, numPartitions=1).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1500.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("stipends", "stipend_labels", "html_lines"):
        assert entry.registry.QUERIES[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3, name


def test_cards_are_read_in_several_tasks(spark, tmp_path):
    plan = entry.registry.QUERIES["feed_cards"](spark, customers(spark, tmp_path, 25_000))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition 3") > plan.index("Cards")  # beneath the table function


def test_page_order_broadcasts_no_pages(spark, monkeypatch):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, path))[1])
    rows = spark.createDataFrame([("q", str(i) if i else "", str(i + 1)) for i in range(20)], "query string, token string, next_token string")
    assert {(r.page_no, r.status) for r in pages.page_order(spark, rows).collect()} == {(i, "ok") for i in range(20)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_feed_files_share_folders(spark, tmp_path):
    assert {r.status for r in entry.registry.QUERIES["scan_queries"](spark, customers(spark, tmp_path, 3000)).where("query <> 'gone'").collect()} == {"ok"}
    root = checkpoint_root(spark).removeprefix("file:")
    path = max(glob.glob(f"{root}/queries-*/unstop/rest"), key=os.path.getmtime)
    files = glob.glob(f"{path}/*/*.txt")
    assert len(files) == 7 and len({os.path.dirname(f) for f in files}) == 1  # keys 1 to 3000, 500 a file
    assert all(len(open(f).read().splitlines()) == 1 for f in files)


def test_a_path_is_listed_once(spark, tmp_path, monkeypatch):
    paths, real = [], scan.whole_files
    monkeypatch.setattr(scan, "whole_files", lambda spark, path: (paths.append(path), real(spark, path))[1])
    assert entry.registry.QUERIES["discovered"](spark, customers(spark, tmp_path, 200)).count() == 200
    assert len(paths) == len(set(paths)) == 2


def test_a_folder_of_feed_files_is_written_by_one_task(spark, tmp_path):
    assert entry.registry.QUERIES["feed_local"](spark, customers(spark, tmp_path, 25_000)).count() == 25_000
    path = max(glob.glob(f"{checkpoint_root(spark).removeprefix('file:')}/feed-*/local"), key=os.path.getmtime)
    folders = {d: os.listdir(f"{path}/{d}") for d in os.listdir(path) if d.startswith("folder=")}
    tasks = {d: {f.split("-")[1] for f in files if f.startswith("part-")} for d, files in folders.items()}
    assert sum(f.startswith("part-") for files in folders.values() for f in files) == 501  # keys 1 to 25,000, 50 a file
    assert len(tasks) == 3 and all(len(t) == 1 for t in tasks.values()) and len(set.union(*tasks.values())) > 1, tasks


def test_feeds_of_one_path_are_counted_in_one_pass(spark, tmp_path):
    for name, text in {"a.json": '[{"id": "1"}, {"id": "2"}]', "b.json": '{"jobs": [{"id": "3"}, 4]}', "c.json": "", "d.json": "[]"}.items():
        (tmp_path / name).write_text(text)
    path = f"{tmp_path}/*.json"
    found = readers.scan_feeds(spark, [("local", {"path": path}), ("greenhouse", {"path": path, "company": "C"}), ("local", {"queries": [("x", path), ("y", [path, f"{tmp_path}/gone"])]})])
    assert [(r.status, r.rows, r.error) for r in found.outcomes.collect()] == [("ok", 2, told := "2 of 4 files: malformed JSON, unreadable"), ("ok", 2, told), ("ok", 4, f"x: {told}; y: 3 of 5 files: malformed JSON, not found, unreadable")]
    files = {(r.feed, r.query, r.file.rsplit("/", 1)[-1]): (r.rows, r.error) for r in found.files.collect()}
    each = {"a.json": (2, ""), "b.json": (0, "malformed JSON"), "c.json": (0, "unreadable"), "d.json": (0, "")}
    assert files == {(f, q, n): v for f, q in ((0, ""), (1, ""), (2, "x"), (2, "y")) for n, v in each.items()} | {(2, "y", "gone"): (0, "not found")}
    plan = found.outcomes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 4  # by the item of either reader, as an array or as an object


def test_a_text_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"jobs": [{"id": "1"}]}')
    plan = scan.items(spark, f"{tmp_path}/a.json", "jobs", "struct<id:string>")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 2  # as an array or as an object, once each


def test_run_judges_each_row_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "Intern", "description": "Unpaid"}]')
    plans, upsert = [], SnapshotStore.upsert
    monkeypatch.setattr(SnapshotStore, "upsert", lambda self, new, **rules: (plans.append(new._jdf.queryExecution().optimizedPlan().toString()), upsert(self, new, **rules))[1])
    done = runs.run(spark, [("local", {"path": f"{tmp_path}/a.json"})], SnapshotStore(spark, f"{tmp_path}/p", "stable_id", 2), F.array(F.lit("SQL")), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert done.stats["rows"] == 1 and "parquet" in plans[0] and "from_json" not in plans[0]  # the store reads judged rows, not the feed


def test_equal_contents_are_judged_once(spark, tmp_path, monkeypatch):
    jobs = [{"id": str(i), "title": "ML Intern", "location": "Pune", "description": ("Unpaid", "Python. January to June 2026")[i % 2]} for i in range(300)]
    (tmp_path / "a.json").write_text(json.dumps(jobs))
    seen, judged = [], runs.judged
    monkeypatch.setattr(runs, "judged", lambda postings, *args: (seen.append(postings.count()), judged(postings, *args))[1])
    done = runs.run(spark, [("local", {"path": f"{tmp_path}/a.json"})], SnapshotStore(spark, f"{tmp_path}/p", "stable_id", 2), F.array(F.lit("Python")), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    assert seen == [2] and (done.stats["rows"], done.stats["eligible"]) == (300, 150)
    assert {(int(r.job_id) % 2, r.eligible, r.stipend_state) for r in done.postings.collect()} == {(0, False, "unpaid"), (1, True, "unstated")}


@pytest.mark.parametrize("most", [10_000, 10])
def test_judged_once_is_judged_each(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(runs, "ROWS_A_TASK", most)
    texts = ["Python. January to June 2026", "Unpaid. Deadline: 1990-01-01", "the end_date is unknown", ""]
    raws = ["{}", '{"id": 1}', '{"regn_open": false}', '{"\\u0072egn_open": false}', '{"end_date": "2020-01-01"}', '{"regnRequirements": {"end_regn_dt": "2099-01-01 00:00:00"}}', "no JSON", None]
    cases = [(s, t, x, due, remote, raw) for s in ("local", "unstop") for t in ("Intern", "Lead engineer") for x in texts for due in ("", "2020-01-01") for remote in (None, True) for raw in raws] * 2
    rows = [(f"{c[0]}:{i}", c[0], str(i), "C", c[1], f"u{i}", "Pune", c[2], "Intern", f"d{i}", c[3], "", "", c[4], "", c[5]) for i, c in enumerate(cases)]
    postings = spark.createDataFrame(rows, "stable_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in readers.POSTING))
    known, at = F.array(F.lit("Python")), F.lit("2026-01-01 00:00:00").cast("timestamp")
    each = runs.judged(postings, known, at).select("stable_id", *runs.KEPT, "eligible", "reject_reasons", "open.state", "window.label", "stipend.state", "score", "band", "coverage.missing", "shortlisted")
    once = runs.judged_once(postings.withColumn("raw", registration(F.col("raw"))), known, at, str(tmp_path / "kept"))
    assert ("BroadcastHashJoin" in once._jdf.queryExecution().executedPlan().toString()) == (most > 10)  # many contents are shuffled
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, map(tuple, each.collect())))
    assert spark.read.parquet(f"{tmp_path}/kept/contents").count() < len(rows) * 0.8


def test_outcomes_read_no_rows_for_what_is_new(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"}]')
    found = readers.scan_feeds(spark, [("local", {"path": f"{tmp_path}/a.json"})])
    assert [(r.rows, r.new_rows) for r in found.queries.collect()] == [(2, 2)] and [(r.status, r.rows) for r in found.outcomes.collect()] == [("ok", 2)]
    assert "new_rows" not in found.outcomes._jdf.queryExecution().analyzed().toString()


def test_only_texts_with_tags_go_to_python(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "description": "<p>a &amp; b</p>"}, {"id": "2", "description": "a &amp; b"}, {"id": "3"}]')
    got = readers.local_file(spark, f"{tmp_path}/a.json")
    assert {(r.job_id, r.description) for r in got.collect()} == {("1", "a & b"), ("2", "a &amp; b"), ("3", "")}
    assert "html_to_text(CASE WHEN" in got._jdf.queryExecution().optimizedPlan().toString()


def test_filters_deal_a_compact_table_by_rows(spark, tmp_path):
    spark.range(1, 25_001, numPartitions=1).select(F.col("id").alias("o_orderkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"), F.lit("1-URGENT").alias("o_orderpriority"), F.timestamp_seconds("id").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("source_funnel", "location_ladder"):
        assert "Repartition 3" in entry.registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().logical().toString(), name
