"""Text normalisation, phrase search and term extraction as column expressions."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLOCKS = frozenset("p div br li ul ol tr td th table section article header footer h1 h2 h3 h4 h5 h6 hr pre blockquote".split())
_SKIPPED = frozenset(("script", "style", "noscript", "svg"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it; keeps generated code small."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def filled(c: Column | str) -> Column:
    """Null where a text is null or empty, as empty means missing in source rows."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def searchable_text(*cols: str) -> Column:
    """The non-empty parts joined by one space."""
    return F.concat_ws(" ", *(filled(c) for c in cols))


def clean_whitespace(c: Column) -> Column:
    """Runs of any white space, no-break spaces included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case, plain quotes and hyphens, single blanks: the form in which phrases are looked for."""
    return F.regexp_replace(F.translate(F.lower(c), "’–—", "'--"), r"(?U)\s+", " ")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _SKIPPED
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in _SKIPPED))
        if tag in _BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def _plain(text: str | None) -> str | None:
    if text is None:
        return None
    if "<" in text:
        p = _Text()
        p.feed(text)
        p.close()
        text = "".join(p.out)
    else:
        text = html.unescape(text)
    lines = (" ".join(x.split()) for x in text.replace("\xa0", " ").split("\n"))
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    """Visible text of HTML, a line for each block; Spark has no function that resolves entities."""
    return s.map(_plain, na_action="ignore")


def whole(term: str, also: str = "") -> str:
    """A pattern for a phrase with no letter, digit or ``also`` next to it; for lower-case text."""
    edge = f"[a-z0-9{also}]"
    return f"(?<!{edge}){re.escape(term.strip().lower())}(?!{edge})"


def any_of(phrases) -> str:
    """A pattern for the longest of some phrases; a blank stands for white space. Common beginnings are tested once."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        ways = [(r"\s+" if c == " " else re.escape(c)) + pattern(rest) for c, rest in at.items() if c]
        if not ways:
            return ""
        body = ways[0] if len(ways) == 1 and "" not in at else f"(?:{'|'.join(ways)})"
        return body + "?" if "" in at else body

    return f"(?:{pattern(tree)})"


def slots(*words: tuple[str, ...]) -> list[str]:
    """Phrases that take one word from each slot in turn; the empty word leaves a slot out."""
    out = [""]
    for choice in words:
        out = [f"{p} {w}".strip() if w else p for p in out for w in choice]
    return out


def constants(rows: list[tuple], names: tuple[str, ...]) -> Column:
    """A constant array of structs: what a row is tested against stands in the plan once, not as an expression for each."""
    kinds = ("int" if isinstance(v, int) else "string" for v in rows[0])
    schema = f"array<struct<{','.join(f'{n}:{t}' for n, t in zip(names, kinds, strict=True))}>>"
    return F.from_json(F.lit(json.dumps([dict(zip(names, r, strict=True)) for r in rows])), schema)


_WORD = re.compile(r"[a-z0-9]+")


def head(phrase: str) -> str:
    """A phrase's first word. Where the phrase stands whole, this stands as a word of the text."""
    m = _WORD.search(phrase.strip().lower())
    return m.group() if m else ""


def heads_in(text: Column, phrases: list[str]) -> Column:
    """Those first words of ``phrases`` that are words of a lower-case text: the text is cut once and met with all phrases as sets."""
    heads = sorted({head(p) for p in phrases} - {""})
    return F.array_intersect(F.array(*map(F.lit, heads)).cast("array<string>"), F.split(text, "[^a-z0-9]+"))


def _may_stand(heads: Column, row: Column) -> Column:
    return (row["head"] == "") | F.array_contains(heads, row["head"])


def find_terms(text: Column, lists: dict[str, list[str]]) -> Column:
    """A struct with, for each named list, its first term, in the order listed, that stands in the text as a whole phrase; null if none does.

    The text is lowered once for all lists. A plain search comes before the pattern, which on texts of some
    hundred letters costs less than cutting them into words (measured).
    """

    def first(t: Column, terms: list[str]) -> Column:
        rows = [(x, x.strip().lower(), whole(x)) for x in terms if x]
        if not rows:
            return F.lit(None).cast("string")
        return F.get(F.filter(constants(rows, ("term", "word", "rx")), lambda r: F.contains(t, r["word"]) & F.rlike(t, r["rx"])), 0)["term"]

    return let(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.struct(*(first(t, terms).alias(name) for name, terms in lists.items())))


def find_term(text: Column, terms: list[str]) -> Column:
    """The first of ``terms``, in the order listed, that stands in the text as a whole phrase; null if none does."""
    return find_terms(text, {"term": terms})["term"]


def extract_terms(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The canonical terms whose name or alias stands in the text, by first place; ties by longer phrase, then lexicon order."""
    rows = []
    for rank, (name, aliases) in enumerate(lexicon.items()):
        phrases = [p for p in dict.fromkeys([name.lower(), *(a.lower() for a in aliases)]) if len(p) > 1]
        rows += [(p, whole(p, "+"), -max(map(len, phrases)), rank, name, head(p)) for p in phrases]
    if not rows:
        return F.array().cast("array<string>")

    def places(t: Column) -> Column:
        there = let(heads_in(t, [r[0] for r in rows]), lambda h: F.filter(constants(rows, ("word", "rx", "size", "rank", "term", "head")), lambda r: _may_stand(h, r) & F.contains(t, r["word"])))
        return F.filter(F.transform(there, lambda r: F.struct(F.regexp_instr(t, r["rx"]).alias("at"), r["size"].alias("size"), r["rank"].alias("rank"), r["term"].alias("term"))), lambda x: x["at"] > 0)

    return F.array_distinct(F.transform(F.array_sort(let(fold(F.coalesce(text, F.lit(""))), places)), lambda x: x["term"]))


def norm_url(c: Column) -> Column:
    """A URL as it is compared: lower-case scheme, host and path, no trailing slash, sorted query, no fragment."""
    u = F.trim(F.split(c, "#")[0])
    has = u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://")
    base = F.regexp_replace(F.lower(F.split(u, r"\?")[0]), "/+$", "")
    query = F.when(F.instr(u, "?") > 0, F.regexp_extract(u, r"\?(.*)$", 1))
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.when(has, F.concat(base, F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("?"), ordered)).otherwise(""))).otherwise(F.lower(F.regexp_replace(u, "/+$", "")))


def slug(c: Column, longest: int = 60, fallback: str = "item") -> Column:
    """Lower-case letters, digits and hyphens."""
    s = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, longest), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def truthy(c: Column) -> Column:
    """False for null, empty and the words for no; true for anything else."""
    return ~F.coalesce(F.lower(F.trim(c.cast("string"))), F.lit("")).isin("", "0", "false", "no", "none", "null")


def json_list(c: Column) -> Column:
    """A JSON list of texts, trimmed and without blanks; empty if it is no list."""
    got = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(got, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def plain_of_latex(c: Column) -> Column:
    """A text without formulas, commands and the signs of LaTeX; each leaves a blank."""
    bare = F.when(F.contains(c, F.lit("$")) | F.contains(c, F.lit("\\")), F.regexp_replace(F.regexp_replace(c, r"\$[^$]*\$", " "), r"\\[A-Za-z@]+\*?", " ")).otherwise(c)
    return F.translate(bare, "\\{}$&~", "      ")


def content_tokens(c: Column) -> Column:
    """Distinct words of two characters or more, in order; a word begins with a letter and may hold digits and + # . -, the latter two not at its ends."""
    words = F.regexp_extract_all(F.lower(plain_of_latex(F.coalesce(c, F.lit("")))), F.lit(r"[a-z][a-z0-9+#.\-]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(".-"))), lambda w: F.length(w) > 1))


def numbers_in(c: Column) -> Column:
    """Distinct numbers in order, without thousands separators and blanks; a per cent sign stays, a fraction also gives its two parts."""
    got = F.regexp_extract_all(plain_of_latex(F.coalesce(c, F.lit(""))), F.lit(r"\d[\d,.]*(?<=\d)(?:[ \t]*/[ \t]*\d+)?(?:[ \t]*%)?"), F.lit(0))
    flat = F.transform(got, lambda x: F.regexp_replace(x, r"[,\s]", ""))
    return F.array_distinct(F.flatten(F.transform(flat, lambda x: F.when(F.contains(x, F.lit("/")), F.concat(F.array(x), F.split(x, "/"))).otherwise(F.array(x)))))


def nfc(c: Column) -> Column:
    """Unicode's composed form; Spark has no function for it, so only texts beyond ASCII go to Python."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), c).otherwise(_nfc(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def string_list(value) -> list[str]:
    """A parameter given as one text or as several: trimmed, without blanks and repeats, in order."""
    items = [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]
    return list(dict.fromkeys(t for t in (str(x).strip() for x in items) if t))


def term_split(terms: Column, known: Column) -> Column:
    """Terms that a profile has and lacks, in order, with the share that it has: 0 without terms."""
    both = F.filter(terms, lambda t: F.array_contains(known, t))
    return F.struct(both.alias("matched"), F.filter(terms, lambda t: ~F.array_contains(known, t)).alias("missing"), F.coalesce(F.size(both) / F.nullif(F.size(terms), F.lit(0)), F.lit(0.0)).alias("ratio"))


#: Headings that begin the part of a description about the role (fixed values).
ROLE_HEADINGS = (
    "what you'll do", "what you will do", "what you'll be doing", "what you will be doing", "responsibilities",
    "your responsibilities", "key responsibilities", "the role", "your role", "about the role", "about this role",
    "role overview", "position overview", "job overview", "job description", "role description", "the opportunity",
    "requirements", "qualifications", "your qualifications", "what we're looking for", "what we are looking for",
    "who you are", "who we're looking for", "your background", "skills and experience", "what you'll need",
    "what you will need", "about the internship", "internship overview", "the internship",
)


def role_description(c: Column) -> Column:
    """A description from the first line on that is a heading of the role, at most 48 characters long; all of it without one."""
    heads = "|".join(map(re.escape, ROLE_HEADINGS))
    lines = F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n")
    bare = lambda x: F.btrim(fold(x), F.lit(" :*#-\t"))
    from_there = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: let(
            acc["on"] | let(bare(x), lambda h: (F.length(h) <= 48) & h.rlike(f"^(?:{heads})(?: |$)")),
            lambda on: F.struct(on.alias("on"), F.when(on, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept")),
        ),
    )
    return let(from_there, lambda r: F.when(r["on"], F.array_join(r["kept"], "\n")).otherwise(F.coalesce(c, F.lit(""))))


def surface_forms(terms: Column, text: Column, lexicon: dict[str, list[str]]) -> Column:
    """For each of ``terms`` its names and aliases that stand in the text, or the term itself if none does."""
    rows = [(name, p, p.lower(), whole(p, "+")) for name, aliases in lexicon.items() for p in [name, *aliases]]
    if not rows:
        return terms
    forms = lambda t: F.filter(constants(rows, ("term", "form", "word", "rx")), lambda r: F.array_contains(terms, r["term"]) & F.contains(t, r["word"]) & F.rlike(t, r["rx"]))
    own = lambda found, x: F.transform(F.filter(found, lambda r: r["term"] == x), lambda r: r["form"])
    of_each = lambda found: F.flatten(F.transform(terms, lambda x: let(own(found, x), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(x)))))
    return let(let(fold(F.coalesce(text, F.lit(""))), forms), of_each)


def emphasise(c: Column) -> Column:
    """Figures that stand alone, with their per cent sign or denominator, as bold LaTeX; commands stay as they are."""
    figure = r"(?<![A-Za-z0-9.\\{])(\d+(?:\.\d+)?(?:[ \t]*/[ \t]*\d+(?:\.\d+)?)?(?:[ \t]*%)?)(?![A-Za-z0-9}])"
    return F.regexp_replace(c, figure, r"\\textbf{$1}")
