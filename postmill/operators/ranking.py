"""Ranking a profile's entries, bullets and skills by what a posting asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions.text import content_tokens, extract_terms, fold


def relevance(text: Column, terms: Column, vocabulary: Column, lexicon: dict[str, list[str]]) -> Column:
    """Two for each distinct term of the posting that a text names, a tenth for each of its words that the posting has, 25 words at most."""
    hits = F.size(F.array_intersect(extract_terms(text, lexicon), terms))
    words = F.size(F.array_intersect(content_tokens(text), vocabulary))
    return hits * F.lit(2.0) + F.least(words, F.lit(25)) * F.lit(0.1)


def best_entries(scored: DataFrame, keys: list[str], order: str, most: int, score: str = "relevance") -> DataFrame:
    """The ``most`` most relevant rows of each key, ties in ``order``, with rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(order))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def cover_bullets(bullets: DataFrame, terms: Column, lexicon: dict[str, list[str]], keys: list[str], order: str, most: int = 2) -> DataFrame:
    """The bullets (text, ...) of each key that name most of a posting's ``terms``, ties in ``order``, with relevance and rank."""
    named = F.size(F.array_intersect(extract_terms(F.col("text"), lexicon), terms))
    return best_entries(bullets.withColumn("relevance", named), keys, order, most)


def skills_first(skills: Column, posting: Column) -> Column:
    """Skills that a posting's text names, then the others, each part in order."""
    flat = fold(F.coalesce(posting, F.lit("")))
    named = F.filter(skills, lambda s: F.contains(flat, fold(s)))
    return F.concat(named, F.filter(skills, lambda s: ~F.contains(flat, fold(s))))


def category_relevance(skills: Column, posting: Column) -> Column:
    """How many of a category's skills a posting's text names."""
    flat = fold(F.coalesce(posting, F.lit("")))
    return F.size(F.filter(skills, lambda s: F.contains(flat, fold(s))))
