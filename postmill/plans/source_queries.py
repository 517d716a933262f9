"""Queries of the readers: feeds are written from the driver's tables as files of each source's own form, and read back.

The SQL states what a reader must make of the typed columns. A file holds some hundred jobs, so
the number of files grows with the table, not their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F

from postmill.operators import reports
from postmill.operators.identity import first_seen
from postmill.plans.queries import query
from postmill.session import ROWS_A_TASK, read_table, scratch_folder, spread
from postmill.sources import pages, readers

_JOBS_A_FILE = 500
_NAME, _SEG, _NAT = "c_name", "c_mktsegment", "c_nationkey"


def _key(prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col("c_custkey").cast("string"))


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _even(column: str, yes, no=None) -> Column:
    return F.when(F.col(column) % 2 == 0, yes).otherwise(no)


def by_file(table: DataFrame, key: str, a_file: int) -> GroupedData:
    """A table grouped by folder and file that a row goes into by its number ``key``, ``a_file`` numbers a file.

    A folder takes the rows of one task, and a task takes whole folders: then the driver moves folders, not the files of each task in each folder.
    Twice as many ranges are asked for as there are folders, as then each folder becomes a range of its own.
    """
    file = F.floor(F.col(key) / a_file)
    rows = table.withColumns({"file": file, "folder": F.floor(file / max(1, ROWS_A_TASK // a_file))})
    return spread(rows, "folder", least=ROWS_A_TASK // 2, ranged=True).groupBy("folder", "file")


def put_files(files: DataFrame, path: str) -> None:
    """A file for each row (folder, value), many in a folder: a folder for each would be made, moved and listed alone."""
    files.select("folder", "value").write.option("maxRecordsPerFile", 1).partitionBy("folder").text(path)


def _feed(spark: SparkSession, d: str, name: str, job: Column, wrap: str | None, a_file: int = _JOBS_A_FILE, text=lambda whole, bare: whole, named: bool = False) -> str:
    """Files of one JSON value each: an object with the jobs under ``wrap``, or the jobs alone; ``text`` may choose between both, or spoil them.

    Where files must be known by number (``named``), each has a folder of that name.
    """
    rows = by_file(read_table(spark, d, "customer"), "c_custkey", a_file).agg(F.sort_array(F.collect_list(F.struct("c_custkey", job.alias("j")))).alias("r"))
    jobs = F.transform("r", lambda x: x["j"])
    bare = F.to_json(jobs)
    path = f"{scratch_folder(spark, 'feed')}/{name}"
    files = rows.select("folder", "file", text(F.to_json(F.struct(jobs.alias(wrap))) if wrap else bare, bare).alias("value"))
    if named:
        files.drop("folder").write.partitionBy("file").text(path)
    else:
        put_files(files, path)
    return path


_SHOWN = ("job_id", "title", "company", "location", "employment_type", "published_at", "url", "apply_url", "description", "is_remote", "salary")


def _sql(rows: str = "customer", **cols: str) -> str:
    given = {"title": "c_mktsegment", "salary": "''", "employment_type": "'Intern'", "is_remote": "NULL::BOOLEAN", "published_at": "'2024-01-01'", "description": "c_name"} | cols
    return f"SELECT {', '.join(f'{given[c]} AS {c}' for c in _SHOWN)} FROM {rows}"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN)


@query("feed_greenhouse", _sql(job_id="c_custkey::VARCHAR", company="'C'", location="CASE WHEN c_nationkey % 2 = 0 THEN 'Remote' ELSE 'Pune' END", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="CASE WHEN c_nationkey % 2 = 0 THEN true END", description="c_name || chr(10) || 'a & b'", employment_type="CASE WHEN c_custkey % 2 = 0 THEN 'Intern' ELSE 'Trainee' END"))
def feed_greenhouse(spark, d):
    meta = F.array(F.struct(F.lit("Team").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("Employment Type").alias("name"), _even("c_custkey", "Intern", " ").alias("value")), F.struct(F.lit("commitment").alias("name"), F.lit("Trainee").alias("value")))
    body = F.concat(F.lit("&lt;p&gt;"), F.col("c_name"), F.lit("&lt;/p&gt;&lt;p&gt;a &amp;amp; b&lt;/p&gt;"))
    job = F.struct(_key().alias("id"), F.col(_SEG).alias("title"), _key("u").alias("absolute_url"), _text("2024-01-01").alias("updated_at"), body.alias("content"), F.struct(_even(_NAT, "Remote", "Pune").alias("name")).alias("location"), meta.alias("metadata"))
    return _shown(readers.greenhouse(spark, _feed(spark, d, "greenhouse", job, "jobs"), "C"))


@query("feed_lever", _sql(job_id="c_custkey::VARCHAR", company="'C'", location="'Pune'", url="'h' || c_custkey", apply_url="CASE WHEN c_custkey % 2 = 0 THEN 'a' || c_custkey ELSE 'h' || c_custkey END", published_at="'1700000000'", description="CASE WHEN c_nationkey % 2 = 0 THEN c_name || chr(10) || 'more' ELSE c_name END"))
def feed_lever(spark, d):
    place = F.struct(F.lit("Pune").alias("location"), F.lit("Intern").alias("commitment"))
    job = F.struct(_key().alias("id"), F.col(_SEG).alias("text"), _key("h").alias("hostedUrl"), _even("c_custkey", _key("a")).alias("applyUrl"), F.lit("1700000000").alias("createdAt"), _even(_NAT, F.col(_NAME), "").alias("descriptionPlain"), _even(_NAT, "more", "").alias("additionalPlain"), F.concat(F.lit("<div>"), F.col(_NAME), F.lit("</div>")).alias("description"), place.alias("categories"))
    return _shown(readers.lever(spark, _feed(spark, d, "lever", job, None), "C"))


@query("feed_ashby", _sql("customer WHERE c_custkey % 5 <> 0", job_id="c_custkey::VARCHAR", company="'C'", location="'Pune, B' || c_nationkey", url="'u' || c_custkey", apply_url="'a' || c_custkey", is_remote="CASE WHEN c_nationkey % 2 = 0 THEN false END"))
def feed_ashby(spark, d):
    job = F.struct(_key().alias("id"), F.col(_SEG).alias("title"), _key("u").alias("jobUrl"), _key("a").alias("applyUrl"), F.lit("2024-01-01").alias("publishedAt"), F.lit("Intern").alias("employmentType"), F.lit("Pune").alias("location"), F.array(F.struct(F.concat(F.lit("B"), F.col(_NAT).cast("string")).alias("location")), F.struct(_text("").alias("location"))).alias("secondaryLocations"), _even(_NAT, F.lit(False)).alias("isRemote"), F.when(F.col("c_custkey") % 5 == 0, False).when(F.col("c_custkey") % 5 == 1, True).alias("isListed"), F.col(_NAME).alias("descriptionPlain"))
    return _shown(readers.ashby(spark, _feed(spark, d, "ashby", job, "jobs"), "C"))


@query("feed_workable", _sql(job_id="c_custkey::VARCHAR", company="'C'", location="'Pune, India | N' || c_nationkey", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="c_nationkey % 2 = 0"))
def feed_workable(spark, d):
    place = lambda city, country: F.struct(city.alias("city"), _text("").alias("region"), _text(country).alias("country"))
    places = F.array(place(F.lit("Pune"), "India"), place(F.concat(F.lit("N"), F.col(_NAT).cast("string")), ""), place(F.lit("Pune"), "India"))
    job = F.struct(_key().alias("shortcode"), F.col(_SEG).alias("title"), _key("u").alias("url"), F.lit("2024-01-01").alias("published_on"), F.lit("Intern").alias("employment_type"), (F.col(_NAT) % 2 == 0).alias("telecommuting"), F.concat(F.lit("<p>"), F.col(_NAME)).alias("description"), places.alias("locations"))
    return _shown(readers.workable(spark, _feed(spark, d, "workable", job, "jobs"), "C"))


@query("feed_workable_global", _sql(job_id="CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'u' || c_custkey END", company="c_name", location="'Pune, India'", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="CASE WHEN c_nationkey % 2 = 0 THEN true END"))
def feed_workable_global(spark, d):
    job = F.struct(_even("c_custkey", _key()).alias("id"), F.col(_SEG).alias("title"), _key("u").alias("url"), F.col(_NAME).alias("description"), F.lit("Intern").alias("employmentType"), F.lit("2024-01-01").alias("created"), _even(_NAT, "Remote", "hybrid").alias("workplace"), F.struct(F.col(_NAME).alias("title")).alias("company"), F.struct(F.lit("Pune").alias("city"), _text("").alias("subregion"), F.lit("India").alias("countryName")).alias("location"))
    return _shown(readers.workable_global(spark, _feed(spark, d, "workable_global", job, "jobs")))


@query("feed_himalayas", _sql(job_id="c_custkey::VARCHAR", company="c_name", location="CASE c_nationkey % 3 WHEN 0 THEN 'Worldwide' WHEN 1 THEN 'India, Nepal' ELSE 'Worldwide, India' END", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="CASE WHEN c_nationkey % 3 <> 1 THEN true END", published_at="strftime(TIMESTAMP '2023-11-14 22:13:20' + INTERVAL 1 SECOND * c_custkey, '%Y-%m-%dT%H:%M:%S+00:00')", salary="CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '-' || (c_custkey + 5) || ' EUR yearly' ELSE '' END", description="CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_name || chr(10) || 'in short' END"))
def feed_himalayas(spark, d):
    n = F.col(_NAT) % 3
    places = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("India"), F.lit("Nepal"))).otherwise(F.array(F.lit("Worldwide"), F.lit("India")))
    job = F.struct(_key().alias("guid"), F.col(_SEG).alias("title"), F.col(_NAME).alias("companyName"), _key("u").alias("applicationLink"), (F.col("c_custkey") + 1_700_000_000).alias("pubDate"), F.lit("Intern").alias("employmentType"), _even("c_custkey", F.substring(_NAME, 1, 5), "in short").alias("excerpt"), F.concat(F.lit("<p>"), F.col(_NAME), F.lit("</p>")).alias("description"), places.alias("locationRestrictions"), _even("c_custkey", F.col("c_custkey")).alias("minSalary"), _even("c_custkey", F.col("c_custkey") + 5).alias("maxSalary"), F.lit("EUR").alias("currency"), F.lit("yearly").alias("salaryPeriod"))
    return _shown(readers.himalayas(spark, _feed(spark, d, "himalayas", job, "jobs")))


@query("feed_unstop", _sql("customer WHERE c_nationkey % 3 <> 0", job_id="c_custkey::VARCHAR", company="c_name", location="'Pune, New Delhi'", url="'https://unstop.com/p/' || c_custkey", apply_url="'https://unstop.com/p/' || c_custkey", employment_type="CASE WHEN c_custkey % 2 = 0 THEN 'Internship' ELSE 'jobs' END", published_at="'2024-02-02'", description="'Internship starts: 2026-01-05 - 2026-06-30' || chr(10) || 'Work function: IT' || chr(10) || c_name || chr(10) || 'Required skills: SQL, Go' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'Stipend: ₹500 - ₹800 per month' ELSE '' END"))
def feed_unstop(spark, d):
    pay = F.struct(F.lit("1").alias("show_salary"), F.lit("INR").alias("currency"), F.lit("500").alias("min_salary"), F.lit("800").alias("max_salary"), _even("c_custkey", "monthly", "semester").alias("pay_in"))
    job = F.struct(
        _key().alias("id"), F.col(_SEG).alias("title"), F.when(F.col(_NAT) % 3 == 0, "EXPIRED").when(F.col(_NAT) % 3 == 1, "Live").alias("status"), F.concat(F.lit("/p/"), _key()).alias("public_url"), F.lit("2026-01-05T00:00").alias("start_date"), F.lit("2026-06-30T00:00").alias("end_date"), F.lit("new_delhi").alias("region"),
        _even("c_custkey", "internships", "x").alias("subtype"), F.lit("jobs").alias("type"), F.concat(F.lit("<b>"), F.col(_NAME), F.lit("</b>")).alias("details"), F.lit("2024-02-02").alias("approved_date"), F.struct(F.col(_NAME).alias("name")).alias("organisation"), F.array(F.struct(_text("").alias("name"), F.lit("Pune").alias("city"))).alias("locations"),
        F.array(F.struct(F.lit("SQL").alias("skill_name")), F.struct(F.lit("Go").alias("skill_name"))).alias("required_skills"), F.array(F.struct(F.lit("IT").alias("work_function_name"))).alias("workfunction"), pay.alias("jobDetail"),
    )
    return _shown(readers.unstop(spark, _feed(spark, d, "unstop", job, "data")))


@query("feed_themuse", _sql(job_id="c_custkey::VARCHAR", company="c_name", location="'Pune, ' || CASE WHEN c_nationkey % 2 = 0 THEN 'Flexible / Remote' ELSE 'Goa' END", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="CASE WHEN c_nationkey % 2 = 0 THEN true END", employment_type="'Internship, Entry'"))
def feed_themuse(spark, d):
    job = F.struct(_key().alias("id"), F.col(_SEG).alias("name"), F.col(_NAME).alias("contents"), F.lit("2024-01-01").alias("publication_date"), F.array(F.struct(F.lit("Internship").alias("name")), F.struct(_text("").alias("name")), F.struct(F.lit("Entry").alias("name"))).alias("levels"), F.struct(F.col(_NAME).alias("name")).alias("company"), F.struct(_key("u").alias("landing_page")).alias("refs"), F.array(F.struct(F.lit("Pune").alias("name")), F.struct(_even(_NAT, "Flexible / Remote", "Goa").alias("name"))).alias("locations"))
    return _shown(readers.the_muse(spark, _feed(spark, d, "themuse", job, "results")))


def _local(spark, d, name: str = "local") -> str:
    job = F.struct(_even("c_custkey", _key()).alias("id"), _key("j").alias("job_id"), F.col(_NAME).alias("company"), F.col(_SEG).alias("title"), F.lit("Pune").alias("location"), F.lit("Intern").alias("employment_type"), F.lit("2024-01-01").alias("published_at"), _even(_NAT, F.lit(True), F.lit(False)).alias("is_remote"), _key("u").alias("url"), _even(_NAT, F.concat(F.lit("<p>"), F.col(_NAME)), F.concat(F.col(_NAME), F.lit(" &amp;"))).alias("description"))
    return _feed(spark, d, name, job, "jobs", 50, lambda whole, bare: F.when(F.col("file") % 2 == 0, whole).otherwise(bare))


@query("feed_local", _sql(job_id="CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'j' END || c_custkey", company="c_name", location="'Pune'", url="'u' || c_custkey", apply_url="'u' || c_custkey", is_remote="c_nationkey % 2 = 0", description="CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE c_name || ' &amp;' END"))
def feed_local(spark, d):
    return _shown(readers.local_file(spark, _local(spark, d)))


@query("feed_cards", "SELECT c_nationkey::VARCHAR AS job_id, 'New ' || c_mktsegment AS title, c_name AS company, CASE WHEN c_custkey % 2 = 0 THEN 'Remote' ELSE 'Pune' END AS location, 'https://www.linkedin.com/v/' || c_nationkey AS url, '2024-01-01' AS published_at, CASE WHEN c_custkey % 2 = 0 THEN true END AS is_remote FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 3, c_custkey) AS n FROM customer) WHERE n = 1")
def feed_cards(spark, d):
    card = F.concat(F.lit('<div data-entity-urn="urn:li:jobPosting:'), F.col(_NAT).cast("string"), F.lit('"><a class="base-card__full-link" href="/v/'), F.col(_NAT).cast("string"), F.lit('?x=1"><span class="sr-only">seen by readers of screens</span></a><img src="x"><h3 class="base-search-card__title"> <span>New<br></span> '), F.col(_SEG), F.lit(' </h3><h4 class="base-search-card__subtitle">'), F.col(_NAME), F.lit('</h4><span class="job-search-card__location">'), _even("c_custkey", "Remote", "Pune"), F.lit('</span><time datetime="2024-01-01"></time></div>'))
    pages = spread(read_table(spark, d, "customer")).select((F.col("c_custkey") % 3).alias("query_ord"), F.col("c_custkey").alias("page_ord"), card.alias("html"))
    return readers.card_postings(pages).select("job_id", "title", "company", "location", "url", "published_at", "is_remote")


@query("discovered", "SELECT 'local:' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'j' END || c_custkey AS stable_id, c_mktsegment AS title FROM customer")
def discovered(spark, d):
    return _discover(spark, d)[0].select("stable_id", "title")


@query("source_outcomes", "SELECT 2::BIGINT AS ok, 2::BIGINT AS failed, 1::BIGINT AS skipped")
def source_outcomes(spark, d):
    return reports.source_outcomes(_discover(spark, d)[1])


def _discover(spark, d):
    path = _local(spark, d)
    return readers.discover(spark, [("local", {"path": path}), ("nowhere", {}), ("local", {"path": path}), ("local", {"path": f"{path}-gone"}), ("lever", {"enabled": False})])


def _simple(prefix: str = "", title: Column | None = None) -> Column:
    return F.struct(_key(prefix).alias("id"), (F.col(_SEG) if title is None else title).alias("title"), _key("u").alias("url"))


@query(
    "scan_files",
    "SELECT source, f::VARCHAR AS file, CASE WHEN f % 3 = 1 THEN 'error' ELSE 'ok' END AS status, CASE WHEN f % 3 = 1 THEN 0 ELSE n END AS rows, CASE WHEN f % 3 = 1 THEN 'malformed JSON' ELSE '' END AS error "
    "FROM (SELECT c_custkey // 50 AS f, count(*) AS n FROM customer GROUP BY 1), (VALUES ('local'), ('greenhouse')) s(source) UNION ALL SELECT 'local', '', 'error', 0, 'not found'",
)
def scan_files(spark, d):
    """Files of both forms, every third cut off in its middle, and one that is missing."""
    spoilt = lambda whole, bare: F.element_at(F.transform(F.array(whole), lambda w: F.when(F.col("file") % 3 == 1, F.substring(w, F.lit(1), F.floor(F.length(w) / 2).cast("int"))).when(F.col("file") % 3 == 0, w).otherwise(bare)), 1)
    path = _feed(spark, d, "mixed", _simple(), "jobs", 50, spoilt, named=True)
    found = readers.scan_feeds(spark, [("local", {"path": [path, f"{path}-gone"]}), ("greenhouse", {"path": path, "company": "C"})])
    return found.files.select("source", F.regexp_extract("file", r"file=(\d+)", 1).alias("file"), "status", "rows", "error")


@query("scan_survivors", "SELECT 'local:' || (c_custkey % 40) AS stable_id, c_custkey::VARCHAR AS title FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 40 ORDER BY floor(log2(c_custkey + 1)), c_custkey) AS n FROM customer) WHERE n = 1")
def scan_survivors(spark, d):
    """Of rows with one id in files of very different sizes the first stays, whatever Spark reads first.

    Each level of files holds twice the rows of the one before; beyond some hundred jobs a level goes on in further files.
    """
    place = F.col("c_custkey")
    file = F.format_string("%04d-%010d", F.floor(F.log2(place + 1)), F.floor(place / _JOBS_A_FILE))
    job = lambda k: F.struct((k % 40).cast("string").alias("id"), k.cast("string").alias("title"), F.repeat(F.lit("x"), ((k * 37) % 3000).cast("int")).alias("description"))
    rows = spread(read_table(spark, d, "customer").select(place, file.alias("file")), "file")
    jobs = rows.groupBy("file").agg(F.sort_array(F.collect_list(place)).alias("keys"))
    path = f"{scratch_folder(spark, 'feed')}/unequal"
    jobs.select("file", F.to_json(F.transform("keys", job)).alias("value")).write.partitionBy("file").text(path)
    return readers.discover(spark, [("local", {"path": path}), ("local", {"path": path})])[0].select("stable_id", "title")


_QUERIED = "CASE WHEN c_nationkey < 10 THEN 0 WHEN c_nationkey < 15 THEN 1 WHEN c_nationkey < 20 THEN 3 END"


@query(
    "scan_queries",
    f"WITH n AS (SELECT {_QUERIED} AS q, count(*) AS n FROM customer GROUP BY 1), t AS (SELECT source, q, query, bad FROM (VALUES ('unstop'), ('himalayas'), ('themuse')) s(source), (VALUES (0, 'generic', false), (1, 'ml', false), (2, 'again', false), (3, 'rest', false), (4, 'gone', true)) x(q, query, bad)) "
    "SELECT source, query, CASE WHEN bad THEN 'error' ELSE 'ok' END AS status, coalesce(n, 0)::BIGINT AS new_rows FROM t LEFT JOIN n USING (q)",
)
def scan_queries(spark, d):
    """Several queries a source, which overlap: a query counts the jobs that none before it had; one that can't be read is reported."""
    table = read_table(spark, d, "customer")
    feeds = []
    for name, wrap, job in (("unstop", "data", F.struct(_key().alias("id"), F.col(_SEG).alias("title"))), ("himalayas", "jobs", F.struct(_key().alias("guid"), F.col(_SEG).alias("title"))), ("themuse", "results", F.struct(_key().alias("id"), F.col(_SEG).alias("name")))):
        root = f"{scratch_folder(spark, 'queries')}/{name}"
        for label, rows in (("generic", "c_nationkey < 10"), ("ml", "c_nationkey < 15"), ("again", "c_nationkey < 12"), ("rest", "c_nationkey < 20")):
            put_files(by_file(table.where(rows), "c_custkey", _JOBS_A_FILE).agg(F.to_json(F.struct(F.collect_list(job).alias(wrap))).alias("value")), f"{root}/{label}")
        feeds.append((name, {"queries": [(q, f"{root}/{q}") for q in ("generic", "ml", "again", "rest", "gone")]}))
    return readers.scan_feeds(spark, feeds).queries.select("source", "query", "status", "new_rows")


_CHAINS = (
    "WITH c AS (SELECT c_nationkey AS q, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey::VARCHAR)) - 1 AS n, count(*) OVER (PARTITION BY c_nationkey) AS size FROM customer), "
    "l AS (SELECT *, max(CASE WHEN k % 97 = 0 THEN n END) OVER (PARTITION BY q ORDER BY n) AS lost FROM c WHERE q <> 7 OR size > 1) "
)


@query(
    "page_order",
    _CHAINS + "SELECT 'q' || q AS query, CASE WHEN n = 0 AND q <> 7 THEN '' ELSE 't' || k END AS token, CASE WHEN q = 7 THEN NULL ELSE n - coalesce(lost + 1, 0) END AS page_no, CASE WHEN q = 7 THEN 'cycle' WHEN lost IS NULL THEN 'ok' ELSE 'gap' END AS status FROM l WHERE q = 7 OR k % 97 <> 0",
)
def page_order(spark, d):
    """A chain of pages for each nation, dealt by hash; some pages are missing, one chain is a ring."""
    c = read_table(spark, d, "customer").select(F.col(_NAT).alias("q"), F.col("c_custkey").alias("k"))
    w = Window.partitionBy("q").orderBy(F.md5(F.col("k").cast("string")))
    ring = F.col("q") == 7
    token = F.when(~ring & (F.row_number().over(w) == 1), "").otherwise(F.concat(F.lit("t"), F.col("k").cast("string")))
    rows = c.withColumn("token", token).withColumn("follows", F.lead("token").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("q")))
    first = F.first("token").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("next_token", F.coalesce("follows", F.when(ring, first))).where(F.when(ring, F.col("n") > 1).otherwise(F.col("k") % 97 != 0))
    return pages.page_order(spark, rows.select(F.concat(F.lit("q"), F.col("q").cast("string")).alias("query"), "token", "next_token"))


@query("landed_pages", "SELECT 'j' || (c_custkey // 3) AS job_id, min(c_custkey)::VARCHAR AS title FROM customer GROUP BY 1")
def landed_pages(spark, d):
    """200 jobs a page, files named at random; of equal jobs the one of the first page stays."""
    rows = read_table(spark, d, "customer").withColumn("page", F.floor(F.col("c_custkey") / 200))
    job = F.struct("c_custkey", F.struct(F.concat(F.lit("j"), F.floor(F.col("c_custkey") / 3).cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("title")).alias("j"))
    jobs = rows.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(job)), lambda x: x["j"]).alias("jobs"))
    token = lambda p: F.when(p > 0, F.concat(F.lit("p"), p.cast("string")))
    text = F.to_json(F.struct(token(F.col("page")).alias("pageToken"), token(F.col("page") + 1).alias("nextPageToken"), "jobs"))
    path = f"{scratch_folder(spark, 'landed')}/pages"
    jobs.select(F.md5(F.col("page").cast("string")).alias("file"), text.alias("value")).write.partitionBy("file").text(path)
    found, _ = pages.landed_postings(spark, path)
    return first_seen(found, ["job_id"], ["row_ord"]).select("job_id", "title")


@query("store_reload", "SELECT 's' AS source, c_custkey::VARCHAR AS job_id, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_name END, '') AS title, c_nationkey % 2 = 0 AS is_remote, '' AS salary, '{}' AS raw FROM customer")
def store_reload(spark, d):
    stored = read_table(spark, d, "customer").select(F.lit("s").alias("source"), _key().alias("job_id"), _even(_NAT, F.col(_NAME)).alias("title"), (F.col(_NAT) % 2 == 0).cast("int").alias("is_remote"), F.lit("5").alias("salary"))
    path = f"{scratch_folder(spark, 'store')}/postings"
    stored.write.parquet(path)
    return readers.from_store(spark.read.parquet(path)).select("source", "job_id", "title", "is_remote", "salary", "raw")


@query("exclusion_entries", "SELECT n_nationkey AS ord, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE n_name END AS company, CASE WHEN n_nationkey % 2 = 0 THEN 'https://x.example/' || n_nationkey END AS url, CASE WHEN n_nationkey % 2 <> 0 THEN 's:' || n_nationkey END AS stable_id FROM nation")
def exclusion_entries(spark, d):
    k = F.col("n_nationkey").cast("string")
    entry = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('"https://x.example/'), k, F.lit('"'))).otherwise(F.concat(F.lit('{company = "'), F.col("n_name"), F.lit('", stable_id = "s:'), k, F.lit('"}')))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", entry.alias("e")))), lambda x: x["e"])
    path = f"{scratch_folder(spark, 'exclusions')}/applied"
    read_table(spark, d, "nation").agg(F.concat(F.lit("applied = [\n"), F.array_join(entries, ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    return readers.exclusion_entries(spark, f"{path}/*.txt").select("ord", "company", "url", "stable_id")


@query("manual_problems", "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'unknown source' WHEN 1 THEN 'source is disabled' WHEN 2 THEN 'no url' WHEN 3 THEN 'no title' END AS problem FROM customer")
def manual_problems(spark, d):
    k = F.col("c_custkey") % 5
    source = F.when(k == 0, "lever").when(k == 1, "off").otherwise("naukri")
    problem = readers.manual_problem(source, F.when(k == 2, " ").otherwise("u"), F.when(k != 3, "t"), {"naukri": True, "off": False})
    return read_table(spark, d, "customer").select("c_custkey", problem.alias("problem"))
