"""Feeds of JSON files read file by file: each file has an outcome, each row the place that it was read at."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.functions.text import let

#: Where a row was read: query of its source, file in the order of paths, page, position. Sorts as the scan goes.
PLACE = "struct<query:bigint,file:string,page:bigint,pos:bigint>"
MALFORMED, UNREADABLE, MISSING = "malformed JSON", "unreadable", "not found"
_BROKEN = "_broken"


def place(query: Column | int = 0, file: Column | str = "", page: Column | int = 0, pos: Column | int = 0) -> Column:
    """A row's place in the scan."""
    as_col = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.struct(as_col(query).cast("long").alias("query"), as_col(file).cast("string").alias("file"), as_col(page).cast("long").alias("page"), as_col(pos).cast("long").alias("pos"))


def parsed(text: Column, key: str | None, item: str) -> Column:
    """A JSON text as struct(items, error): the array of items that it is, or that an object holds under ``key``.

    An object without the key has no items. A field of another type is null; a text that is no such value, that is cut
    off or followed by another, or whose items are not objects has an error.
    """

    def read(t: Column) -> Column:
        """What a text is, parsed once, as an array or as an object."""
        array = t.startswith("[")
        bare = F.when(array, F.from_json(t, f"array<{item}>"))
        outer = F.when(~array, F.from_json(t, f"struct<`{key or 'items'}`:array<{item}>,{_BROKEN}:string>", {"columnNameOfCorruptRecord": _BROKEN}))
        # in brackets, a text is an array of one if nothing follows its value, which the parser alone would pass over
        single = F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))
        return F.struct(array.alias("array"), t.startswith("{").alias("object"), bare.alias("bare"), outer.alias("outer"), single.alias("single"))

    def judged(r: Column) -> Column:
        held = r["outer"][key or "items"]
        items = F.when(r["array"], r["bare"]).when(F.lit(key is not None), held)
        whole = F.when(r["array"], r["bare"].isNotNull()).otherwise(F.lit(key is not None) & r["object"] & r["outer"].isNotNull() & (held.isNotNull() | r["outer"][_BROKEN].isNull()))
        good = whole & r["single"] & ~F.coalesce(F.exists(items, lambda x: x.isNull()), F.lit(False))
        return F.struct(F.when(good, items).alias("items"), F.when(~F.coalesce(good, F.lit(False)), MALFORMED).alias("error"))

    return let(let(F.ltrim(F.regexp_replace(text, "^﻿", ""), F.lit(" \t\r\n")), read), judged)


def _named(path: Column) -> Column:
    """A file's name in one form; Spark gives local files one or three slashes."""
    return F.regexp_replace(path, "^file:/+", "file:///")


def items(spark: SparkSession, path: str | list[str] | DataFrame, key: str | None, item: str) -> DataFrame:
    """(file, error, pos, j): a row for each item of each file, and one without an item for a file that has none or is broken.

    ``path`` may be the files as :func:`whole_files` has them, which are then not listed again.
    """
    read = _parsed_files(path if isinstance(path, DataFrame) else whole_files(spark, path), key, item)
    return read.select("file", "p.error", F.posexplode_outer("p.items").alias("pos", "j"))


def counted(files: DataFrame, key: str | None, item: str) -> DataFrame:
    """(file, error, n): what :func:`items` would give of each file, without a row for each item; error is empty for a good file."""
    return _parsed_files(files, key, item).select("file", F.coalesce("p.error", F.lit("")).alias("error"), F.coalesce(F.array_size("p.items"), F.lit(0)).alias("n"))


def _parsed_files(files: DataFrame, key: str | None, item: str) -> DataFrame:
    return files.select(_named(F.col("_metadata.file_path")).alias("file"), parsed(F.col("value"), key, item).alias("p"))


def whole_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each file, its text; Spark lists the path now."""
    return spark.read.option("ignoreCorruptFiles", "true").text(path, wholetext=True)


def listed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(file): what there is to read, empty files included, which no reader sees; the list that Spark itself keeps of the path."""
    return spark.createDataFrame([(f,) for f in files.inputFiles()], "file string").select(_named(F.col("file")).alias("file"))


def feed(key: str | None, item: str, *, needs_rows: bool = False):
    """Make a reader of files from the shaping of its items.

    ``shape`` gets (file, pos, the item's fields); the reader is called with a session, a path, and what else the
    shape takes. ``needs_rows`` says that a source of which one query failed and none has a row has failed.
    """

    def made(shape: Callable[..., DataFrame]):
        def read(spark: SparkSession, path: str | list[str], *args, **options) -> DataFrame:
            return shape(items(spark, path, key, item).where("j is not null").select("file", "pos", "j.*"), *args, **options)

        read.key, read.item, read.shape, read.needs_rows, read.__doc__, read.__name__ = key, item, shape, needs_rows, shape.__doc__, shape.__name__
        return read

    return made


@dataclass
class Scan:
    """What a scan of several feeds gives.

    rows: all postings with stable_id, the first of each by feed, query, file and position.
    every: all that was read, with stable_id and its place, of which :func:`first_rows` gives the former.
    outcomes: (source, status, rows, error) of each feed in order; rows counts what it has read.
    files: (feed, source, query, file, status, rows, error) of each file, those that are missing or broken included.
    queries: (feed, source, query, status, rows, new_rows); new_rows counts the jobs that no query of the feed before it had.
    """

    rows: DataFrame
    outcomes: DataFrame
    files: DataFrame
    queries: DataFrame
    every: DataFrame


def first_rows(every: DataFrame) -> DataFrame:
    """The first row of each stable_id by feed, query, file and position; columns that are not needed are best dropped before."""
    first = every.groupBy("stable_id").agg(F.min_by(F.struct(*every.columns), F.struct("feed", "query_ord", "row_ord")).alias("r")).select("r.*")
    return first.drop("feed", "query_ord", "row_ord")


_TASK = "feed int, source string, query_ord int, query string, status string, error string"
_FILE = "feed int, query_ord int, file string, error string, rows long"


def scan(spark: SparkSession, feeds: list[tuple[str, dict]], readers: dict[str, Callable[..., DataFrame]], empty: DataFrame) -> Scan:
    """Read all feeds; nothing that is wrong with one file, query or feed stops the others.

    A feed is a name and options: ``path``, or ``queries`` as a list of (label, path); ``enabled``; what its reader takes.
    A reader without a key (of stored pages) takes its own options. The union of the feeds is one
    plan; counting files and queries are two more jobs over it, whatever the number of feeds. Files that several feeds
    read by one key and one form of items are listed and counted once for all of them.
    """
    tasks, parts, counts, known, listings, readings = [], [], [], {}, {}, {}

    def there(path: str) -> tuple[DataFrame, DataFrame]:
        """A path's files and their names, listed once however many feeds name it."""
        if path not in known:
            files = whole_files(spark, path)
            known[path] = files, listed(spark, files)
        return known[path]

    for f, (name, options) in enumerate(feeds):
        own = {k: v for k, v in options.items() if k not in ("enabled", "path", "queries")}
        queries = options.get("queries") or [("", options.get("path"))]
        for q, (label, path) in enumerate(queries):
            status, error = "ok", ""
            reader = readers.get(name)
            if not options.get("enabled", True):
                status, error = "skipped", "source disabled"
            elif reader is None:
                status, error = "error", f"no reader named {name}"
            elif not hasattr(reader, "key"):
                try:
                    part = reader(**own)
                    parts.append(_of(part, f, q))
                    counts.append(part.select(F.lit(f).alias("feed"), F.lit(q).alias("query_ord"), F.lit("").alias("file"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("n")))
                except Exception as e:  # noqa: BLE001  reported: one feed's failure must not stop the others
                    status, error = "error", type(e).__name__
            else:
                found, gone = [], []
                for one in [path] if isinstance(path, str) else list(path or []):
                    try:
                        there(one)
                        found.append(one)
                    except AnalysisException:
                        gone.append(one)
                    else:
                        listings.setdefault(one, []).append((f, q))
                if gone or not found:
                    counts += [spark.createDataFrame([(f, q, one, MISSING, 0) for one in gone or [""]], "feed int, query_ord int, file string, error string, n int")]
                try:
                    if found:
                        files = there(found[0])[0] if len(found) == 1 else whole_files(spark, found)
                        parts.append(_of(reader.shape(items(spark, files, reader.key, reader.item).where("j is not null").select("file", "pos", "j.*"), **own), f, q))
                        readings.setdefault((tuple(found), reader.key, reader.item), (files, []))[1].append((f, q))
                except Exception as e:  # noqa: BLE001
                    status, error = "error", type(e).__name__
            tasks.append((f, name, q, label, status, error))
    counts += [_for_each(known[one][1].select("file", F.lit(UNREADABLE).alias("error"), F.lit(0).alias("n")), who) for one, who in listings.items()]
    counts += [_for_each(counted(files, key, item), who) for (_, key, item), (files, who) in readings.items()]
    table = spark.createDataFrame(tasks, _TASK)
    per_file = spark.createDataFrame([], _FILE)
    if counts:
        # what was listed but not read stays unreadable; what was read has its own outcome, which sorts before
        each = reduce(lambda a, b: a.unionByName(b), counts).groupBy("feed", "query_ord", "file")
        per_file = each.agg(F.min(F.when(F.col("error") != UNREADABLE, F.coalesce("error", F.lit("")))).alias("read"), F.max("error").alias("listed"), F.sum("n").alias("rows")).select("feed", "query_ord", "file", F.coalesce("read", "listed").alias("error"), "rows")
    files = per_file.join(table.select("feed", "query_ord", "source", "query"), ["feed", "query_ord"]).select("feed", "source", "query", "file", F.when(F.coalesce("error", F.lit("")) == "", "ok").otherwise("error").alias("status"), "rows", F.coalesce("error", F.lit("")).alias("error"))

    all_rows = reduce(lambda a, b: a.unionByName(b), parts) if parts else empty.withColumns({"feed": F.lit(0), "query_ord": F.lit(0)})
    all_rows = all_rows.withColumn("stable_id", F.concat_ws(":", "source", "job_id"))
    own = F.coalesce(F.nullif("job_id", F.lit("")), F.col("stable_id"))
    new = all_rows.groupBy("feed", own.alias("k")).agg(F.min("query_ord").alias("query_ord")).groupBy("feed", "query_ord").agg(F.count("*").alias("new_rows"))

    summed = per_file.groupBy("feed", "query_ord").agg(F.sum("rows").alias("rows"), F.count("*").alias("n_files"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_bad"), F.array_join(F.array_sort(F.collect_set(F.nullif(F.coalesce("error", F.lit("")), F.lit("")))), ", ").alias("bad"))
    told = F.when(F.col("error") != "", F.col("error")).when(F.col("n_bad") > 0, F.concat(F.col("n_bad").cast("string"), F.lit(" of "), F.col("n_files").cast("string"), F.lit(" files: "), F.col("bad"))).otherwise("")
    failed = (F.col("status") == "error") | F.coalesce(F.col("n_bad") == F.col("n_files"), F.lit(False))
    by_query = table.join(summed, ["feed", "query_ord"], "left")
    by_query = by_query.select("feed", "source", "query_ord", "query", F.when(F.col("status") == "skipped", "skipped").when(failed, "error").otherwise("ok").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), told.alias("error"))
    # only the queries' table tells what is new, so outcomes read no rows for it
    with_new = by_query.join(new, ["feed", "query_ord"], "left").select("feed", "source", "query", "status", "rows", F.coalesce("new_rows", F.lit(0)).alias("new_rows"))

    strict = [f for f, (name, _) in enumerate(feeds) if getattr(readers.get(name), "needs_rows", False)]
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error") != "", F.struct("query_ord", F.concat_ws(": ", F.nullif("query", F.lit("")), "error").alias("e"))))), lambda x: x["e"]), "; ")
    by_feed = by_query.groupBy("feed", "source").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("bad"), F.count_if(F.col("status") == "skipped").alias("off"), F.sum("rows").alias("rows"), errors.alias("error"))
    lost = (F.col("bad") == F.col("n")) | (F.col("feed").isin(strict) & (F.col("bad") > 0) & (F.col("rows") == 0))
    outcomes = by_feed.orderBy("feed").select("source", F.when(F.col("off") > 0, "skipped").when(lost, "error").otherwise("ok").alias("status"), "rows", "error")
    return Scan(first_rows(all_rows), outcomes, files, with_new, all_rows)


def _of(part: DataFrame, feed: int, query: int) -> DataFrame:
    return part.withColumns({"feed": F.lit(feed), "query_ord": F.lit(query)})


def _for_each(rows: DataFrame, who: list[tuple[int, int]]) -> DataFrame:
    """The rows once for each (feed, query_ord) of ``who``, computed once."""
    at = F.array(*(F.struct(F.lit(f).alias("feed"), F.lit(q).alias("query_ord")) for f, q in who))
    return rows.select(F.explode(at).alias("at"), *rows.columns).select("at.*", *rows.columns)
