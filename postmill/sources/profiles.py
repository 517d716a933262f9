"""Profiles kept as Markdown: every line gets its section, entry and kind by windows; facts are rows of those lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import filled

_ITEM = r"^[-*]\s+"
_MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_DATES = rf"(?i)({_MONTH}\.?\s+\d{{4}}\s*(?:[-–—]|to)+\s*(?:{_MONTH}\.?\s+\d{{4}}|present|current|now))"


def _plain(c: Column) -> Column:
    """A line without emphasis, code marks, link targets and bullet."""
    linked = F.regexp_replace(F.regexp_replace(c, _ITEM, ""), r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(linked, r"\*+|`", ""))


def profile_lines(profiles: DataFrame) -> DataFrame:
    """profile_id, n, section, entry, kind, line for each line of ``profiles`` (profile_id, text) that carries something.

    kind is name, contact, entry (a heading of the third level, or bold text under education), skill,
    bullet, link, stack, tag or note. The windows run within one profile, whose lines are few. Null
    and empty texts have no lines; a line before the first heading is contact data or nothing.
    """
    one = profiles.select("profile_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", F.trim("raw")).drop("raw")
    before = Window.partitionBy("profile_id").orderBy("n")
    heading = F.when(F.col("line").rlike(r"^##\s+\S"), F.lower(F.trim(F.regexp_replace("line", r"^##\s+", ""))))
    one = one.withColumn("section", F.coalesce(F.last(heading, ignorenulls=True).over(before), F.lit("")))
    one = one.where(~F.col("line").rlike(r"^##\s|^[-*_]{3,}$") & (F.col("line") != ""))
    starts = F.col("line").rlike(r"^###\s+\S") | (F.col("section").startswith("education") & F.col("line").startswith("**"))
    inside = Window.partitionBy("profile_id", "section").orderBy("n")
    one = one.withColumn("starts", starts).withColumn("entry", F.sum(F.col("starts").cast("int")).over(inside))
    skills = F.col("section").rlike("^(technical )?skills")
    kind = (
        F.when((F.col("section") == "") & F.col("line").rlike(r"^#\s"), "name")
        .when((F.col("section") == "") & F.col("line").rlike(r"^[-*]\s+\*\*[^*]+\*\*"), "contact")
        .when(F.col("section") == "", None)
        .when(F.col("starts"), "entry")
        .when(skills & F.col("line").rlike(r"^(?:[-*]\s+)?\*\*[^*]+\*\*"), "skill")
        .when(skills | (F.col("entry") == 0), None)
        .when(F.col("line").rlike(r"^[-*]\s+(?i:repo:|http|.*github\.com)"), "link")
        .when(F.col("line").rlike(_ITEM), "bullet")
        .when(F.col("line").rlike(r"^\*\(?(?i:non-ai|.*excluded)"), "tag")
        .when(F.col("section").startswith("project") & F.col("line").rlike(r"^\*[^*]"), "stack")
        .otherwise("note")
    )
    return one.withColumn("kind", kind).where("kind is not null").select("profile_id", "n", "section", F.col("entry").cast("int").alias("entry"), "kind", "line")


def _labelled(line: Column, i: int) -> Column:
    return F.trim(F.regexp_extract(line, r"^(?:[-*]\s+)?\*\*([^*:]+):?\*\*\s*:?\s*(.*)$", i))


def profile_contacts(lines: DataFrame) -> DataFrame:
    """profile_id, name and contact: a map of lower-case labels; the last line of a label counts."""
    label = F.when(F.col("kind") == "contact", F.lower(_labelled(F.col("line"), 1)))
    last = lines.where("kind in ('name', 'contact')").groupBy("profile_id", F.coalesce(label, F.lit("name")).alias("label")).agg(F.max_by("line", "n").alias("line"))
    name = F.trim(F.split(F.regexp_replace("line", r"^#\s+", ""), "—")[0])
    pairs = F.map_from_entries(F.collect_list(F.when(F.col("label") != "name", F.struct("label", _labelled(F.col("line"), 2)))))
    return last.groupBy("profile_id").agg(F.max(F.when(F.col("label") == "name", name)).alias("name"), pairs.alias("contact"))


def profile_skills(lines: DataFrame) -> DataFrame:
    """profile_id, category, ord (of the category) and skills, in order and without repeats."""
    own = lines.where("kind = 'skill'").select("profile_id", "n", _labelled(F.col("line"), 1).alias("category"), F.posexplode(F.split(_labelled(F.col("line"), 2), r"[,;]")).alias("at", "skill"))
    own = own.select("profile_id", "n", "category", "at", F.trim("skill").alias("skill")).where("skill <> ''")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("n", "at", "skill"))), lambda x: x["skill"])
    return own.groupBy("profile_id", "category").agg(F.min("n").alias("ord"), F.array_distinct(listed).alias("skills"))


def profile_entries(lines: DataFrame) -> DataFrame:
    """A row for each entry: profile_id, section, entry, title, org, dates, year, stack, non_ai, bullets, links and the text to search.

    Headings are cut at dashes: the title, then for projects a tagline (as org), else the organisation;
    dates are a range of months, a year in brackets at the end belongs to projects.
    """
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", _plain(F.col("line")).alias("s"))))), lambda x: x["s"])
    rows = lines.where("entry > 0").groupBy("profile_id", "section", "entry").agg(
        F.max(F.when(F.col("kind") == "entry", F.regexp_replace(_plain(F.col("line")), r"^#+\s+", ""))).alias("heading"),
        F.array_join(of("note"), " ").alias("note"), F.coalesce(F.get(of("stack"), 0), F.lit("")).alias("stack"), F.coalesce(F.bool_or(F.col("kind") == "tag"), F.lit(False)).alias("non_ai"),
        of("bullet").alias("bullets"), of("link").alias("links"),
    )
    bare = F.regexp_replace(F.regexp_replace("heading", _DATES, ""), r"\s*\(\d{4}\)\s*$", "")
    parts = F.filter(F.transform(F.split(bare, r"\s*—\s*|\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")
    dates = F.coalesce(filled(F.regexp_extract("heading", _DATES, 1)), F.regexp_extract("note", _DATES, 1))
    rows = rows.withColumns({"parts": parts, "dates": dates, "year": F.regexp_extract("heading", r"\((\d{4})\)\s*$", 1)})
    rows = rows.withColumns({"title": F.coalesce(F.get("parts", 0), "heading"), "org": F.coalesce(F.get("parts", 1), F.lit(""))})
    searchable = F.concat_ws(" ", *(filled(c) for c in ("title", "org", "stack", "note")), "bullets")
    return rows.select("profile_id", "section", "entry", "title", "org", "dates", "year", "stack", "non_ai", "bullets", "links", searchable.alias("searchable"))
