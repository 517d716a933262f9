"""Readers of posting feeds kept as JSON or HTML files, each giving rows of one shape."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable
from html.parser import HTMLParser

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.money import salary_text
from postmill.functions.text import html_to_text
from postmill.operators.identity import first_seen
from postmill.sources import scan

POSTING = T.StructType(
    [T.StructField(c, T.StringType()) for c in "source job_id company title url location description employment_type published_at deadline apply_url apply_email".split()]
    + [T.StructField("is_remote", T.BooleanType()), T.StructField("salary", T.StringType()), T.StructField("raw", T.StringType())]
)


def posting(df: DataFrame, source: str, row_ord: Column | None = None, **cols: Column) -> DataFrame:
    """Rows of the common shape, with row_ord, their place in the scan: texts default to empty, is_remote to null, raw to the item as JSON."""
    out = []
    for f in POSTING.fields:
        c = F.lit(source) if f.name == "source" else cols.get(f.name)
        if f.name == "is_remote":
            out.append((c if c is not None else F.lit(None)).cast("boolean").alias(f.name))
        elif f.name == "raw":
            out.append((c if c is not None else F.to_json(F.struct(*(x for x in df.columns if x not in ("file", "pos"))))).alias(f.name))
        else:
            out.append(F.coalesce(c.cast("string") if c is not None else F.lit(""), F.lit("")).alias(f.name))
    return df.select(*out, (scan.place(file=F.col("file"), pos=F.col("pos")) if row_ord is None else row_ord).alias("row_ord"))


def stable_id() -> Column:
    return F.concat_ws(":", "source", "job_id")


_LOCAL = "struct<id:string,job_id:string,company:string,title:string,location:string,employment_type:string,published_at:string,is_remote:boolean,url:string,apply_url:string,apply_email:string,description:string>"


@scan.feed("jobs", _LOCAL)
def local_file(rows: DataFrame) -> DataFrame:
    """An array of jobs, or an object with jobs; an empty id falls back to job_id, then to the row's place; a description with tags becomes text."""
    filled = lambda c: F.nullif(c, F.lit(""))
    tagged = F.col("description").contains("<")
    text = F.when(tagged, html_to_text(F.when(tagged, F.col("description")))).otherwise(F.col("description"))  # Spark calls Python for all rows
    names = ("company", "title", "location", "employment_type", "published_at", "url", "is_remote", "apply_email")
    return posting(rows, "local", job_id=F.coalesce(filled("id"), filled("job_id"), F.col("pos").cast("string")), description=text, apply_url=F.coalesce("apply_url", "url"), **{c: F.col(c) for c in names})


_GREENHOUSE = "struct<id:string,title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>,metadata:array<struct<name:string,value:string>>>"


@scan.feed("jobs", _GREENHOUSE)
def greenhouse(rows: DataFrame, company: str) -> DataFrame:
    """Nested place; the employment type is the first filled metadata item whose name says so; remote is true or unknown."""
    kind = F.get(F.filter("metadata", lambda m: F.lower(m["name"]).rlike("employment|commitment|type") & (F.trim(m["value"]) != "")), F.lit(0))["value"]
    place = F.col("location.name")
    return posting(rows, "greenhouse", job_id=F.col("id"), title=F.col("title"), company=F.lit(company), location=place, url=F.col("absolute_url"), apply_url=F.col("absolute_url"), published_at=F.col("updated_at"), employment_type=kind, description=html_to_text(html_to_text("content")), is_remote=F.when(F.lower(place).contains("remote"), True))


_LEVER = "struct<id:string,text:string,hostedUrl:string,applyUrl:string,createdAt:string,descriptionPlain:string,additionalPlain:string,description:string,categories:struct<location:string,commitment:string>,workplaceType:string>"


@scan.feed(None, _LEVER)
def lever(rows: DataFrame, company: str) -> DataFrame:
    plain = F.nullif(F.concat_ws("\n", F.nullif("descriptionPlain", F.lit("")), F.nullif("additionalPlain", F.lit(""))), F.lit(""))
    return posting(rows, "lever", job_id=F.col("id"), title=F.col("text"), company=F.lit(company), location=F.col("categories.location"), employment_type=F.col("categories.commitment"), url=F.col("hostedUrl"), apply_url=F.coalesce("applyUrl", "hostedUrl"), published_at=F.col("createdAt"), description=F.coalesce(plain, html_to_text("description")), is_remote=F.when((F.lower("workplaceType") == "remote") | F.lower("categories.location").contains("remote"), True))


_ASHBY = "struct<id:string,title:string,jobUrl:string,applyUrl:string,publishedAt:string,employmentType:string,location:string,secondaryLocations:array<struct<location:string>>,isRemote:boolean,isListed:boolean,descriptionPlain:string>"


@scan.feed("jobs", _ASHBY)
def ashby(rows: DataFrame, company: str) -> DataFrame:
    """Unlisted jobs are left out; primary and secondary places are joined."""
    rows = rows.where("coalesce(isListed, true)")
    places = F.array_join(F.filter(F.concat(F.array("location"), F.coalesce(F.transform("secondaryLocations", lambda s: s["location"]), F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    return posting(rows, "ashby", job_id=F.col("id"), title=F.col("title"), company=F.lit(company), location=places, employment_type=F.col("employmentType"), url=F.col("jobUrl"), apply_url=F.col("applyUrl"), published_at=F.col("publishedAt"), description=F.col("descriptionPlain"), is_remote=F.coalesce("isRemote", F.when(F.lower(places).contains("remote"), True)))


_WORKABLE = "struct<shortcode:string,title:string,url:string,application_url:string,published_on:string,employment_type:string,telecommuting:boolean,description:string,locations:array<struct<city:string,region:string,country:string>>>"


@scan.feed("jobs", _WORKABLE)
def workable(rows: DataFrame, company: str) -> DataFrame:
    place = F.array_join(F.array_distinct(F.transform("locations", lambda x: F.concat_ws(", ", F.nullif(x["city"], F.lit("")), F.nullif(x["region"], F.lit("")), F.nullif(x["country"], F.lit(""))))), " | ")
    return posting(rows, "workable", job_id=F.col("shortcode"), title=F.col("title"), company=F.lit(company), location=place, employment_type=F.col("employment_type"), url=F.col("url"), apply_url=F.coalesce("application_url", "url"), published_at=F.col("published_on"), description=html_to_text("description"), is_remote=F.col("telecommuting"))


_WORKABLE_GLOBAL = "struct<id:string,title:string,url:string,description:string,employmentType:string,created:string,updated:string,workplace:string,company:struct<title:string>,location:struct<city:string,subregion:string,countryName:string>>"


@scan.feed("jobs", _WORKABLE_GLOBAL)
def workable_global(rows: DataFrame) -> DataFrame:
    """Landed pages of the board's own search; only a workplace named remote is remote."""
    place = F.concat_ws(", ", *(F.nullif(F.col(f"location.{c}"), F.lit("")) for c in ("city", "subregion", "countryName")))
    names = ("title", "url")
    return posting(rows, "workable_global", job_id=F.coalesce("id", "url", "title"), company=F.col("company.title"), location=place, apply_url=F.col("url"), employment_type=F.col("employmentType"), published_at=F.coalesce("created", "updated"), description=html_to_text("description"), is_remote=F.when(F.lower("workplace") == "remote", True), **{c: F.col(c) for c in names})


def from_store(stored: DataFrame) -> DataFrame:
    """Postings as a snapshot keeps them: null texts become empty, raw and salary are not restored."""
    lost = {"raw": F.lit("{}"), "salary": F.lit("")}
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in stored.columns else F.lit("")
    remote = F.col("is_remote").cast("boolean") if "is_remote" in stored.columns else F.lit(None).cast("boolean")
    return stored.select(*(lost.get(f.name, remote if f.name == "is_remote" else text(f.name)).alias(f.name) for f in POSTING.fields))


def exclusion_entries(spark: SparkSession, path: str) -> DataFrame:
    """ord, source, company, title, url, stable_id and job_id of a list in TOML: tables ``applied`` or ``exclusions``; a bare text is a url.

    The list is kept by hand and read on the driver; a missing file is an empty list.
    """
    names = ("source", "company", "title", "url", "stable_id", "job_id")
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = ""
    listed = tomllib.loads(text)
    entries = listed.get("applied") or listed.get("exclusions") or []
    rows = [(i, *((e if isinstance(e, dict) else {"url": e}).get(c) for c in names)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "ord int, " + ", ".join(f"{c} string" for c in names))


_HIMALAYAS = "struct<guid:string,title:string,companyName:string,applicationLink:string,pubDate:string,employmentType:string,excerpt:string,description:string,locationRestrictions:array<string>,minSalary:string,maxSalary:string,currency:string,salaryPeriod:string>"


@scan.feed("jobs", _HIMALAYAS)
def himalayas(rows: DataFrame) -> DataFrame:
    """No restriction of place means remote worldwide; an excerpt that the description lacks is added; seconds become ISO text."""
    places = F.filter(F.coalesce("locationRestrictions", F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")
    where = F.when(F.size(places) > 0, F.array_join(places, ", ")).otherwise("Worldwide")
    text = html_to_text("description")
    body = F.when(F.coalesce("excerpt", F.lit("")) == "", text).when(F.contains(text, F.col("excerpt")), text).otherwise(F.concat_ws("\n", F.nullif(text, F.lit("")), "excerpt"))
    when = F.coalesce(F.date_format(F.timestamp_seconds(F.col("pubDate").try_cast("double")), "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.col("pubDate"))
    pay = F.concat_ws(" ", F.nullif(F.concat_ws("-", "minSalary", "maxSalary"), F.lit("")), F.nullif("currency", F.lit("")), F.nullif("salaryPeriod", F.lit("")))
    paid = F.when(F.col("minSalary").isNotNull() | F.col("maxSalary").isNotNull(), pay)
    link = F.nullif("applicationLink", F.lit(""))
    return posting(rows, "himalayas", job_id=F.coalesce(F.nullif("guid", F.lit("")), link, "title"), title=F.col("title"), company=F.col("companyName"), url=link, apply_url=link, published_at=when, employment_type=F.col("employmentType"), description=body, salary=paid, location=where, is_remote=F.when(F.contains(F.lower(where), F.lit("worldwide")), True))


_DETAIL = "struct<show_salary:string,not_disclosed:string,paid_unpaid:string,currency:string,min_salary:string,max_salary:string,pay_in:string>"
_UNSTOP = f"struct<id:string,short_id:string,title:string,status:string,seo_url:string,public_url:string,start_date:string,end_date:string,region:string,subtype:string,type:string,details:string,approved_date:string,updated_at:string,organisation:struct<name:string>,locations:array<struct<name:string,city:string,label:string>>,required_skills:array<struct<skill_name:string,skill:string>>,workfunction:array<struct<work_function_name:string>>,jobDetail:{_DETAIL},regn_open:int,regnRequirements:struct<start_regn_dt:string,end_regn_dt:string>>"


@scan.feed("data", _UNSTOP, needs_rows=True)
def unstop(rows: DataFrame) -> DataFrame:
    """Only LIVE rows, or those without a status; the description is put together from typed fields, pay and dates included (fixed texts)."""
    rows = rows.where("coalesce(upper(status), '') in ('', 'LIVE')")
    filled = lambda c: F.nullif(c, F.lit(""))
    region = F.initcap(F.trim(F.replace(F.coalesce("region", F.lit("")), F.lit("_"), F.lit(" "))))
    names = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.coalesce(*(filled(x[f]) for f in fields))), ", ")
    place = F.concat_ws(", ", filled(names("locations", "name", "city", "label")), filled(region))
    dates = F.when((F.coalesce("start_date", F.lit("")) != "") & (F.coalesce("end_date", F.lit("")) != ""), F.concat(F.lit("Internship starts: "), F.split("start_date", "T")[0], F.lit(" - "), F.split("end_date", "T")[0]))
    labelled = lambda label, c: F.concat(F.lit(label), filled(c))
    text = F.concat_ws("\n", dates, labelled("Work function: ", names("workfunction", "work_function_name")), filled(html_to_text("details")), labelled("Required skills: ", names("required_skills", "skill_name", "skill")), filled(salary_text(F.col("jobDetail"))))
    public = F.when(F.col("public_url").startswith("http"), F.col("public_url")).otherwise(F.concat(F.lit("https://unstop.com/"), F.ltrim("public_url", F.lit("/"))))
    url = F.coalesce(filled(F.col("seo_url")), F.when(F.coalesce("public_url", F.lit("")) != "", public))
    return posting(rows, "unstop", job_id=F.coalesce(filled(F.col("id")), filled(F.col("short_id")), url), title=F.col("title"), company=F.col("organisation.name"), url=url, apply_url=url, location=place, employment_type=F.when(F.col("subtype") == "internships", "Internship").otherwise(F.col("type")), published_at=F.coalesce(filled(F.col("approved_date")), "updated_at"), description=text, is_remote=F.when(F.lower("region").rlike("online|remote"), True))


_THE_MUSE = "struct<id:string,name:string,contents:string,publication_date:string,company:struct<name:string>,refs:struct<landing_page:string>,locations:array<struct<name:string>>,levels:array<struct<name:string>>>"


@scan.feed("results", _THE_MUSE)
def the_muse(rows: DataFrame) -> DataFrame:
    """Levels are the employment type; places named remote or flexible make it remote; the id falls back to the page, then the title."""
    filled = lambda c: F.nullif(c, F.lit(""))
    names = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    places, page = names("locations"), F.col("refs.landing_page")
    remote = F.when(F.exists(places, lambda x: F.lower(x).rlike("remote|flexible")), True)
    return posting(rows, "themuse", job_id=F.coalesce(filled("id"), filled(page), "name"), title=F.col("name"), company=F.col("company.name"), url=page, apply_url=page, published_at=F.col("publication_date"), employment_type=F.array_join(names("levels"), ", "), description=html_to_text("contents"), location=F.array_join(places, ", "), is_remote=remote)


#: Elements that have no end tag (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_URN = re.compile(r"urn:li:jobPosting:(\d+)")
#: Fields of a card: the elements and the class that hold them (fixed values of the page).
_HELD = {"title": ({"h3"}, "base-search-card__title"), "company": ({"h4"}, "base-search-card__subtitle"), "location": ({"span", "div"}, "job-search-card__location")}
_CARD = "card_ord int, job_id string, url string, title string, company string, location string, posted string"


class _CardStack(HTMLParser):
    """Search cards of a page. Every open element stands on a stack with what it began: a card, or a field of one.

    An end tag closes its innermost open element and all that were left open within; one without an open element
    is ignored. So markup inside a field doesn't end it, and a card that was not closed ends with what surrounds it.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards, self.stack, self.card, self.into = [], [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes, begun = (a.get("class") or "").split(), None
        if self.card is None:
            if m := _URN.search(a.get("data-entity-urn") or ""):
                self.card, begun = dict.fromkeys(("url", "title", "company", "location", "posted"), "") | {"job_id": m.group(1)}, "card"
        elif tag == "a" and "base-card__full-link" in classes and not self.card["url"]:
            self.card["url"] = a.get("href") or ""
        elif tag == "time":
            self.card["posted"] = a.get("datetime") or ""
        elif self.into is None:
            begun = next((f for f, (tags, c) in _HELD.items() if tag in tags and c in classes), None)
            if begun:
                self.into, self.text = begun, []
        if tag in _VOID:
            self._ended(begun)
        else:
            self.stack.append((tag, begun))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is not None and tag not in _VOID:
            self._cut(at)

    def handle_data(self, data):
        if self.into:
            self.text.append(data)

    def _ended(self, begun):
        if begun == "card":
            self.cards.append(self.card)
            self.card = None
        elif begun:
            if text := " ".join("".join(self.text).split()):
                self.card[begun] = text
            self.into = None

    def _cut(self, at):
        while len(self.stack) > at:
            self._ended(self.stack.pop()[1])

    def close(self):
        super().close()
        self._cut(0)


@F.udtf(returnType=_CARD)
class Cards:
    """Table function: a row for each search card of a page."""

    def eval(self, html: str):
        p = _CardStack()
        p.feed(html or "")
        p.close()
        for i, c in enumerate(p.cards):
            yield i, c["job_id"], c["url"].split("?")[0], c["title"], c["company"], c["location"], c["posted"]


def search_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """A row (card_ord, job_id, url, title, company, location, posted) for each search card of stored pages, joined laterally to its page.

    Other columns of ``pages`` stay. Pages without cards, null ones included, give no row.
    """
    kept = [c for c in pages.columns if c != html]
    return pages.where(F.col(html).isNotNull()).lateralJoin(Cards(F.col(html).outer())).select(*kept, *(f.split()[0] for f in _CARD.split(", ")))


def card_postings(pages: DataFrame, max_results: int | None = None) -> DataFrame:
    """Postings of the search pages (query_ord, page_ord, html) of several queries: the first card of each job, the first ``max_results`` in order."""
    cards = search_cards(pages).where("job_id <> ''")
    first = first_seen(cards, ["job_id"], ["query_ord", "page_ord", "card_ord"]).orderBy("query_ord", "page_ord", "card_ord")
    first = first.limit(max_results) if max_results is not None else first
    url = F.when(F.col("url").startswith("/"), F.concat(F.lit("https://www.linkedin.com"), F.col("url"))).otherwise(F.col("url"))
    remote = F.when(F.contains(F.lower("location"), F.lit("remote")), True)
    place = scan.place(F.col("query_ord"), page=F.col("page_ord"), pos=F.col("card_ord"))
    out = posting(first, "linkedin", place, job_id=F.col("job_id"), title=F.col("title"), company=F.col("company"), location=F.col("location"), url=url, apply_url=url, published_at=F.col("posted"), is_remote=remote)
    return out


def manual_row(source: Column, url: Column, title: Column, company: Column) -> Column:
    """A posting entered by hand: its id is made from the URL."""
    return F.struct(source.alias("source"), F.concat(F.lit("manual-"), F.substring(F.sha1(F.trim(url)), 1, 16)).alias("job_id"), F.trim(title).alias("title"), F.trim(company).alias("company"), F.trim(url).alias("url"))


def manual_problem(source: Column, url: Column, title: Column, known: dict[str, bool]) -> Column:
    """Why a posting entered by hand is not taken: its source is unknown or off (``known``: whether each is on), or its URL or title is missing; null if it is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    on = [k for k, v in known.items() if v]
    return F.when(~F.coalesce(source.isin(*known), F.lit(False)), "unknown source").when(~source.isin(*on), "source is disabled").when(blank(url), "no url").when(blank(title), "no title")


READERS: dict[str, Callable[..., DataFrame]] = {"local": local_file, "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable, "workable_global": workable_global, "himalayas": himalayas, "unstop": unstop, "themuse": the_muse, "cards": card_postings}


def scan_feeds(spark: SparkSession, feeds: list[tuple[str, dict]]) -> scan.Scan:
    """All feeds in order with the outcomes of feeds, queries and files; see :func:`postmill.sources.scan.scan`."""
    empty = spark.createDataFrame([], T.StructType([*POSTING.fields, T.StructField("row_ord", T._parse_datatype_string(scan.PLACE))]))
    return scan.scan(spark, feeds, READERS, empty)


def discover(spark: SparkSession, feeds: list[tuple[str, dict]]) -> tuple[DataFrame, DataFrame]:
    """All feeds in order as one table, the first row of each stable_id kept; and (source, status, rows, error) of each feed."""
    found = scan_feeds(spark, feeds)
    return found.rows, found.outcomes
