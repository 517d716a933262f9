"""What a text may claim: words and numbers against a profile, keyword survival, answers, recipients, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.functions.text import clean_whitespace, content_tokens, filled, fold, numbers_in

#: Quotes and hyphens as they are compared (fixed values).
_TYPOGRAPHIC, _PLAIN = "‘’“”–—", '\'\'""--'

#: Endings that an inflected form may have (fixed value).
_SUFFIXES = ("ing", "es", "s", "ed", "ly")


def violations(texts: DataFrame, vocabulary: DataFrame, numbers: DataFrame) -> DataFrame:
    """(id, kind, token): each word and number of ``texts`` (id, text) that ``vocabulary`` (word) and ``numbers`` (number) lack.

    A word also passes if it is an inflected form (-ing, -es, -s, -ed, -ly) whose stem of four letters
    or more is a word, begins one, or, for a stem of four or more, begins with one of four or more.
    Only distinct unknown words meet the vocabulary a second time, and by equality of prefixes: no pair
    of words is compared that shares no beginning.
    """
    words = vocabulary.select(F.lower("word").alias("token")).distinct()
    seen = texts.select("id", F.explode(content_tokens(F.col("text"))).alias("token"))
    unknown = seen.join(words, "token", "left_anti")
    stems = F.array_compact(F.array(*(F.when(F.col("token").endswith(s) & (F.length("token") - len(s) >= 4), F.expr(f"left(token, length(token) - {len(s)})")) for s in _SUFFIXES)))
    forms = unknown.select("token").distinct().select("token", F.explode(stems).alias("stem"))
    begins = lambda c: F.transform(F.sequence(F.lit(4), F.length(c)), lambda n: F.substring(c, F.lit(1), n))
    long = words.where(F.length("token") >= 4).select(F.col("token").alias("word"))
    prefixes = long.select(F.explode(begins(F.col("word"))).alias("stem")).distinct()
    of_word = forms.join(prefixes, "stem", "left_semi").select("token")
    from_word = forms.select("token", F.explode(begins(F.col("stem"))).alias("word")).join(long, "word", "left_semi").select("token")
    strange = unknown.join(of_word.union(from_word).distinct(), "token", "left_anti").select("id", F.lit("unknown-word").alias("kind"), "token")
    odd = texts.select("id", F.explode(numbers_in(F.col("text"))).alias("token")).join(numbers.select(F.col("number").alias("token")).distinct(), "token", "left_anti")
    return strange.unionByName(odd.select("id", F.lit("number").alias("kind"), "token"))


def _compared(c: Column) -> Column:
    """Lower case, plain quotes and hyphens, single blanks."""
    return fold(clean_whitespace(F.translate(c, _TYPOGRAPHIC, _PLAIN)))


def survival(text: Column, required: Column) -> Column:
    """The share of ``required`` phrases that the text holds, case and typography aside; 1 if none is required.

    Texts that may hold decomposed letters go through :func:`postmill.functions.text.nfc` before, as a
    column of its own: Spark lets no Python function stand within a lambda.
    """
    flat = _compared(F.coalesce(text, F.lit("")))
    asked = F.filter(required, lambda k: k.isNotNull() & (k != ""))
    there = F.filter(asked, lambda k: F.contains(flat, _compared(k)))
    return F.when(F.size(asked) > 0, F.size(there) / F.size(asked)).otherwise(F.lit(1.0))


def parseability(text: Column, sections: list[str], keywords: Column, contacts: Column, least: float = 0.5) -> Column:
    """A struct of ok and problems: sections or contact data that the text lacks, and too few keywords."""
    flat = _compared(F.coalesce(text, F.lit("")))
    lacking = lambda a: F.filter(a, lambda k: k.isNotNull() & (k != "") & ~F.contains(flat, _compared(k)))
    no_section, no_contact, kept = lacking(F.array(*map(F.lit, sections))), lacking(contacts), survival(text, keywords)
    percent = lambda c: F.concat(F.rint(c * 100).cast("int").cast("string"), F.lit("%"))
    problems = F.array_compact(
        F.array(
            F.when(F.size(no_section) > 0, F.concat(F.lit("missing sections: "), F.array_join(no_section, ", "))),
            F.when(F.size(no_contact) > 0, F.concat(F.lit("missing contact details: "), F.array_join(no_contact, ", "))),
            F.when(kept < least, F.concat(F.lit("keyword survival "), percent(kept), F.lit(" below "), percent(F.lit(least)))),
        )
    )
    return F.struct((F.size(problems) == 0).alias("ok"), problems.alias("problems"))


def pages(text: Column) -> Column:
    """Pages of extracted text, which a form feed ends or parts; 0 for none."""
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit("")))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(feeds + F.when(text.endswith("\f"), 0).otherwise(1))


def answer(field: Column, book: Column, name: Column, contact: Column) -> Column:
    """A form field's answer: the book's own, else what the profile says; null if neither knows."""
    key = F.lower(F.trim(field))
    parts = F.split(F.trim(name), r"\s+")
    own = (
        F.when(key.isin("email", "e-mail"), contact["email"])
        .when(key.isin("phone", "phone_number"), contact["phone"])
        .when(key.isin("full_name", "name"), name)
        .when(key == "first_name", F.get(parts, 0))
        .when((key == "last_name") & (F.size(parts) > 1), F.array_join(F.slice(parts, 2, 1000), " "))
        .when(key.isin("linkedin", "github", "org"), contact[key])
    )
    return F.when(F.map_contains_key(book, key), book[key]).otherwise(own)


def recipient(email: Column, allowed: list[str]) -> Column:
    """The address, if it is one and, with a list of allowed ones, stands there; else null."""
    a = F.trim(F.coalesce(email, F.lit("")))
    fits = a.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")
    return F.when(fits & (F.lower(a).isin(*(x.strip().lower() for x in allowed)) if allowed else F.lit(True)), a)


def followup(company: Column, title: Column) -> Column:
    """The draft of a letter that asks after an application, without any claim."""
    role, team = F.coalesce(filled(title), F.lit("the position")), F.coalesce(filled(company), F.lit("hiring"))
    return F.concat(F.lit("Subject: My application for "), role, F.lit("\n\nDear "), team, F.lit(" team,\n\nI am writing to ask how my application for "), role, F.lit(" stands, and whether you need anything else from me.\n\nKind regards,\n[name]"))
