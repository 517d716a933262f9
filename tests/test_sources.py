"""Readers on small files, discovery, streams."""

import json

from pyspark.sql import functions as F

from postmill.operators import identity, reports
from postmill.sources import pages, readers
from postmill.streaming import upserts


def put(tmp_path, name, value):
    (tmp_path / name).write_text(json.dumps(value))
    return str(tmp_path / name)


def test_local_and_failures(spark, tmp_path):
    path = put(tmp_path, "a.json", {"jobs": [{"id": "x1", "title": "T", "company": "C", "url": "u", "description": "<p>x&amp;y</p>"}, {"title": "no id, so its place is its id"}]})
    rows, outcomes = readers.discover(spark, [("local", {"path": path}), ("local", {"path": path}), ("nowhere", {}), ("local", {"path": str(tmp_path / "none.json")}), ("lever", {"enabled": False})])
    got = {r.stable_id: r for r in rows.collect()}
    assert set(got) == {"local:x1", "local:1"} and got["local:x1"].description == "x&y" and got["local:x1"].apply_url == "u"
    assert [(o.status, o.rows) for o in outcomes.collect()] == [("ok", 2), ("ok", 2), ("error", 0), ("error", 0), ("skipped", 0)]
    assert reports.source_outcomes(outcomes).first().asDict() == {"ok": 2, "failed": 2, "skipped": 1}


def test_boards(spark, tmp_path):
    g = put(tmp_path, "g.json", {"jobs": [{"id": 7, "title": "T", "absolute_url": "u", "content": "&lt;p&gt;Hi&lt;/p&gt;", "location": {"name": "Remote"}, "metadata": [{"name": "Employment Type", "value": "Intern"}]}]})
    r = readers.greenhouse(spark, g, "C").first()
    assert (r.job_id, r.description, r.employment_type, r.is_remote) == ("7", "Hi", "Intern", True)
    a = put(tmp_path, "h.json", {"jobs": [{"id": "1", "title": "T", "isListed": False}, {"id": "2", "title": "T", "location": "A", "secondaryLocations": [{"location": "B"}]}]})
    assert [(x.job_id, x.location) for x in readers.ashby(spark, a, "C").collect()] == [("2", "A, B")]
    h = put(tmp_path, "i.json", {"jobs": [{"guid": "1", "title": "T", "pubDate": 1700000000, "excerpt": "more", "description": "<p>body</p>", "locationRestrictions": []}]})
    r = readers.himalayas(spark, h).first()
    assert (r.location, r.published_at, r.description) == ("Worldwide", "2023-11-14T22:13:20+00:00", "body\nmore")
    row = {"id": 1, "title": "T", "status": "LIVE", "start_date": "2026-01-05T00:00", "end_date": "2026-06-30T00:00", "region": "new_delhi", "organisation": {"name": "O"}, "details": "<b>d</b>", "required_skills": [{"skill_name": "SQL"}], "jobDetail": {"paid_unpaid": "paid", "currency": "INR", "min_salary": "8000", "max_salary": "12000", "pay_in": "monthly"}}
    u = put(tmp_path, "u.json", {"data": [row, row | {"id": 2, "status": "CLOSED"}]})
    got = readers.unstop(spark, u).collect()
    assert [x.job_id for x in got] == ["1"] and got[0].location == "New Delhi"
    assert got[0].description == "Internship starts: 2026-01-05 - 2026-06-30\nd\nRequired skills: SQL\nStipend: ₹8,000 - ₹12,000 per month"


def test_cards(spark):
    page = '<li><div data-entity-urn="urn:li:jobPosting:42"><a class="base-card__full-link" href="https://x/42?t=1"></a><h3 class="base-search-card__title"> ML  Intern </h3><h4 class="base-search-card__subtitle"><a>Acme</a></h4><span class="job-search-card__location">Pune</span><time datetime="2026-01-01">now</time></div></li>'
    got = readers.search_cards(spark.createDataFrame([(page,), (None,)], "html string")).collect()
    assert [tuple(r) for r in got] == [(0, "42", "https://x/42", "ML Intern", "Acme", "Pune", "2026-01-01")]
    pages = spark.createDataFrame([(1, 0, page), (0, 1, page.replace("42", "43")), (0, 0, page + page.replace("42", "44"))], "query_ord int, page_ord int, html string")
    rows = readers.card_postings(pages, 2).orderBy("row_ord").collect()
    assert [(r.job_id, r.source, r.company) for r in rows] == [("42", "linkedin", "Acme"), ("44", "linkedin", "Acme")]


def test_queries_of_one_source(spark, tmp_path):
    job = lambda i, t: {"guid": i, "title": t, "applicationLink": f"u{i}", "minSalary": 5, "currency": "EUR", "locationRestrictions": ["Worldwide"]}
    a, b, c = (readers.himalayas(spark, put(tmp_path, n, {"jobs": j})) for n, j in (("a.json", [job("1", "first"), job("2", "x")]), ("b.json", [job("1", "second"), job("3", "y"), job("3", "z")]), ("c.json", [job("2", "w")])))
    rows, counts = identity.union_queries([("typed", a), ("q=intern", b), ("q=other", c)])
    assert {(r.job_id, r.title) for r in rows.collect()} == {("1", "first"), ("2", "x"), ("3", "y")}
    assert {(r["query"], r.new_rows) for r in counts.collect()} == {("typed", 2), ("q=intern", 1), ("q=other", 0)}
    r = a.first()
    assert (r.is_remote, r.salary, r.location) == (True, "5 EUR", "Worldwide")


def test_manual_postings(spark):
    rows = spark.createDataFrame([("naukri", "u", "t"), ("off", "u", "t"), ("lever", "u", "t"), ("naukri", " ", "t"), ("naukri", "u", None), (None, "u", "t")], "s string, u string, t string")
    got = rows.select(readers.manual_problem(F.col("s"), F.col("u"), F.col("t"), {"naukri": True, "off": False}).alias("p")).collect()
    assert [r.p for r in got] == [None, "source is disabled", "unknown source", "no url", "no title", "unknown source"]


def test_upsert_stream(spark, tmp_path):
    src, snaps = str(tmp_path / "in"), str(tmp_path / "snap")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], "k string, v int, n int").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v int, n int").parquet(src)
    upserts.upsert_stream(stream, snaps, "k", "n", str(tmp_path / "ck")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{snaps}/v=0").select("k", "v").collect()} == {("a", 2), ("b", 1)}


def test_daily_attempts_plan(spark):
    rows = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("s").alias("status"), F.col("value").alias("stable_id"))
    assert upserts.daily_attempts(rows).isStreaming and upserts.first_seen_stream(rows, "stable_id", "ts").isStreaming


def test_exclusion_list_and_store(spark, tmp_path):
    (tmp_path / "x.toml").write_text('applied = ["https://a.example/1", {company = "B", stable_id = "s:2"}]')
    got = readers.exclusion_entries(spark, f"{tmp_path}/x.toml").orderBy("ord").collect()
    assert [(r.ord, r.url, r.company, r.stable_id) for r in got] == [(0, "https://a.example/1", None, None), (1, None, "B", "s:2")]
    assert readers.exclusion_entries(spark, f"{tmp_path}/none.toml").count() == 0
    back = readers.from_store(spark.createDataFrame([("lever", "1", None, 1, "5")], "source string, job_id string, title string, is_remote int, salary string")).first()
    assert (back.source, back.job_id, back.title, back.is_remote, back.salary, back.raw) == ("lever", "1", "", True, "", "{}")


def test_workable_global(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"jobs": [{"id": "1", "title": "T", "url": "u", "workplace": "Remote", "company": {"title": "C"}, "location": {"city": "", "countryName": "India"}}, {"title": "V", "url": "v"}], "nextPageToken": "x"}')
    rows = readers.workable_global(spark, f"{tmp_path}/w.json").orderBy("title").collect()
    assert [(r.job_id, r.location, r.is_remote, r.company) for r in rows] == [("1", "India", True, "C"), ("v", "", None, "")]


def test_card_depth(spark):
    card = lambda n, title, end="</div>": f'<li><div class="base-card" data-entity-urn="urn:li:jobPosting:{n}"><a class="other" href="no"></a><a class="base-card__full-link" href="u{n}"><span>skip</span></a>{title}<h4 class="base-search-card__subtitle"><a href="/c">A &amp; B</a></h4><div class="job-search-card__location">Pune<br></div><time datetime="d{n}">x</time>{end}</li>'
    titles = ['<h3 class="base-search-card__title"><span>New</span> Data <b>Intern</b></h3>', '<h3 class="base-search-card__title">Old<img src="i"></p> <i>one</h3>', '<h3 class="base-search-card__title">   </h3>']
    page = card(1, titles[0]) + card(2, titles[1], "") + '<div data-entity-urn="urn:li:other:9"></div>' + card(3, titles[2]) + '<div data-entity-urn="urn:li:jobPosting:4"><h3 class="base-search-card__title">cut o'
    got = [(r.card_ord, r.job_id, r.url, r.title, r.company, r.location, r.posted) for r in readers.search_cards(spark.createDataFrame([(page, 1), ("", 2), ("no cards", 3)], "html string, page int")).collect()]
    assert got == [(0, "1", "u1", "New Data Intern", "A & B", "Pune", "d1"), (1, "2", "u2", "Old one", "A & B", "Pune", "d2"), (2, "3", "u3", "", "A & B", "Pune", "d3"), (3, "4", "", "cut o", "", "", "")]


def test_files_and_places(spark, tmp_path):
    texts = {"a.json": '[{"id": "1", "title": "first"}]', "b.json": '{"jobs": [{"id": "1", "title": "second"}, {"id": "", "job_id": "j"}, {"id": null, "title": "third"}, {"id": 7, "is_remote": "odd", "apply_email": "e"}]}' + " " * 5000, "c.json": '{"jobs": [{"id": "9"}', "d.json": "", "e.json": "{}", "f.json": "[1, 2]", "g.json": "null", "h.json": "\ufeff[]", "i.json": '{"jobs": 5}', "j.json": '[{"id": "10"}', "k.json": '"text"', "l.json": '{"jobs": [{"id": "11"}]}\n{"jobs": [{"id": "12"}]}', "m.json": '[{"id": "13"}] []', "n.json": '[{"id": "14"}], []'}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = readers.scan_feeds(spark, [("local", {"path": f"{tmp_path}/*.json"}), ("local", {"path": f"{tmp_path}/c.json"}), ("local", {"path": [f"{tmp_path}/a.json", f"{tmp_path}/none.json"]}), ("lever", {"path": f"{tmp_path}/e.json", "company": "C"})])
    rows = {r.stable_id: r for r in found.rows.collect()}
    assert set(rows) == {"local:1", "local:j", "local:2", "local:7"}
    assert rows["local:1"].title == "first" and rows["local:2"].title == "third" and (rows["local:7"].is_remote, rows["local:7"].apply_email) == (None, "e")
    files = {r.file.rsplit("/", 1)[-1]: (r.status, r.rows) for r in found.files.where("feed = 0").collect()}
    assert files == {n: ("ok", k) for n, k in (("a.json", 1), ("b.json", 4), ("e.json", 0), ("h.json", 0))} | {n: ("error", 0) for n in ("c.json", "d.json", "f.json", "g.json", "i.json", "j.json", "k.json", "l.json", "m.json", "n.json")}
    assert [(r.status, r.rows, r.error) for r in found.outcomes.collect()] == [("ok", 5, "10 of 14 files: malformed JSON, unreadable"), ("error", 0, "1 of 1 files: malformed JSON"), ("ok", 1, "1 of 2 files: not found"), ("error", 0, "1 of 1 files: malformed JSON")]


def test_failed_queries(spark, tmp_path):
    a, b = put(tmp_path, "a.json", {"data": []}), put(tmp_path, "b.json", {"jobs": []})
    gone = f"{tmp_path}/gone.json"
    feeds = [("unstop", {"queries": [("x", a), ("y", gone)]}), ("himalayas", {"queries": [("x", b), ("y", gone)]}), ("cards", {"pages": spark.createDataFrame([], "query_ord int, page_ord int, html string")}), ("cards", {"wrong": 1})]
    assert [(r.source, r.status, r.rows) for r in readers.scan_feeds(spark, feeds).outcomes.collect()] == [("unstop", "error", 0), ("himalayas", "ok", 0), ("cards", "ok", 0), ("cards", "error", 0)]
    assert readers.scan_feeds(spark, []).rows.count() == 0


def test_page_order(spark):
    chain = [("q", "", "t1"), ("q", "t1", "t2"), ("q", "t2", "t3"), ("q", "t3", ""), ("q", "t3", "")]  # one landed twice
    gap = [("g", "", "a"), ("g", "b", "c"), ("g", "c", None)]
    cycle = [("c", "x", "y"), ("c", "y", "x"), ("s", "z", "z")]
    long = [("l", str(i) if i else None, str(i + 1)) for i in range(300)]
    rows = spark.createDataFrame(chain + gap + cycle + long, "query string, token string, next_token string").repartition(5)
    got = {(r["query"], r.token): (r.page_no, r.status) for r in pages.page_order(spark, rows).collect()}
    assert {k: v for k, v in got.items() if k[0] != "l"} == {("q", ""): (0, "ok"), ("q", "t1"): (1, "ok"), ("q", "t2"): (2, "ok"), ("q", "t3"): (3, "ok"), ("g", ""): (0, "ok"), ("g", "b"): (0, "gap"), ("g", "c"): (1, "gap"), ("c", "x"): (None, "cycle"), ("c", "y"): (None, "cycle"), ("s", "z"): (None, "cycle")}
    assert all(got["l", str(i) if i else ""] == (i, "ok") for i in range(300))
    assert pages.page_order(spark, rows.limit(0)).count() == 0


def test_landed_pages(spark, tmp_path):
    job = lambda i, t: {"id": i, "title": t}
    for name, page in {"z": {"jobs": [job("1", "first"), job("2", "x")], "nextPageToken": "p2"}, "m": {"pageToken": "p2", "jobs": [job("1", "later"), job("3", "y")], "nextPageToken": "p3"}, "b": {"pageToken": "p3", "jobs": [], "nextPageToken": "p4"}, "a": {"pageToken": "p4", "jobs": [job("4", "beyond the end")]}, "c": {"pageToken": "lost", "jobs": [job("5", "gap")]}}.items():
        put(tmp_path, f"{name}.json", page)
    rows, told = pages.landed_postings(spark, f"{tmp_path}/*.json")
    assert [(r.job_id, r.title, r.row_ord.page) for r in rows.orderBy("row_ord").collect()] == [("1", "first", 0), ("2", "x", 0), ("1", "later", 1), ("3", "y", 1)]
    assert {(r.token, r.status) for r in told.collect()} == {("", "ok"), ("p2", "ok"), ("p3", "ok"), ("p4", "ok"), ("lost", "gap")}
    assert {r.job_id for r in pages.landed_postings(spark, f"{tmp_path}/*.json", max_pages=1)[0].collect()} == {"1", "2"}
