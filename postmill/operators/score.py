"""The weighted rubric, bands and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.config import Rubric
from postmill.functions.text import constants, extract_terms, fold, let, role_description, term_split, whole
from postmill.lexicon import LEXICON


def role_relevance(title: Column, body: Column, terms: dict[str, list[str]]) -> Column:
    """For each domain 0.5 for a term in the title and 0.1 for each distinct one in the body, the latter up to 0.4; at most 1."""
    rows = lambda words: constants([(w, whole(w)) for w in words], ("word", "rx"))
    there = lambda t: lambda r: F.contains(t, r["word"]) & F.rlike(t, r["rx"])

    def scores(x: Column) -> Column:
        out = []
        for name, words in terms.items():
            listed = rows(words)
            hits = F.size(F.filter(listed, there(x["b"])))
            out += [F.lit(name), F.round(F.least(F.lit(1.0), F.when(F.exists(listed, there(x["t"])), 0.5).otherwise(0.0) + F.least(F.lit(0.4), hits * F.lit(0.1))), 4)]
        return F.create_map(*out)

    text = lambda c: fold(F.coalesce(c, F.lit("")))
    return let(F.struct(text(title).alias("t"), text(body).alias("b")), scores) if terms else F.create_map().cast("map<string,double>")


def best_domain(scores: Column) -> Column:
    """The highest value of a map of scores; 0 without any."""
    return F.coalesce(F.array_max(F.map_values(scores)), F.lit(0.0))


def rubric_score(components: dict[str, Column], rubric: Rubric) -> Column:
    """Weighted mean of the components."""
    total = sum(rubric.weights.get(k, 0.0) for k in components) or 1.0
    return sum((c * F.lit(rubric.weights.get(k, 0.0)) for k, c in components.items()), F.lit(0.0)) / F.lit(total)


def band(score: Column, relevance: Column, rubric: Rubric) -> Column:
    """strong needs the role's relevance as well; without it a high score is but a shortlist."""
    return F.when((score >= rubric.strong) & (relevance >= rubric.strong_relevance), "strong").when(score >= rubric.shortlist, "shortlist").otherwise("reject")


def band_note(score: Column, relevance: Column, rubric: Rubric) -> Column:
    """Why a score that would be strong is not; null else."""
    held = (score >= rubric.strong) & (relevance < rubric.strong_relevance)
    domains = ", ".join(rubric.target_terms) or "none configured"
    return F.when(held, F.format_string(f"strong band withheld: role relevance %.2f is below the {rubric.strong_relevance:.2f} minimum for the configured target domains ({domains})", relevance))


def shortlist(df: DataFrame, threshold: float, limit: int | None = None, score: str = "score", order: str = "ord") -> DataFrame:
    """Rows that reach the threshold, best first, ties in order of discovery."""
    out = df.where(F.col(score) >= threshold).orderBy(F.desc(score), F.asc(order))
    return out.limit(limit) if limit is not None else out


def technical_relevance(scores: Column, matched: Column, domains: list[str], guarded: list[str], core: list[str]) -> Column:
    """A struct of score, domain and core_hit: the best of the listed domains, the first in a tie; guarded ones count only with a core skill."""
    hit = F.arrays_overlap(matched, F.array(*map(F.lit, core)).cast("array<string>"))
    ranked = [F.struct((F.coalesce(scores[d], F.lit(0.0)) * (hit.cast("int") if d in guarded else F.lit(1))).alias("s"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(domains)]
    best = F.array_max(F.array(*ranked))
    return F.struct(best["s"].alias("score"), F.when(best["s"] > 0, best["d"]).otherwise("").alias("domain"), hit.alias("core_hit"))


def reasons(matched: Column, missing: Column, lines: list[Column], note: Column | None = None, most: int = 12) -> Column:
    """Lines that explain a score: coverage, ``lines``, a note if there is one, gaps and supported terms, lists cut after ``most`` words."""
    total = F.size(matched) + F.size(missing)
    percent = F.when(total > 0, F.rint(100 * F.size(matched) / F.nullif(total, F.lit(0)))).otherwise(0).cast("int")
    listed = lambda a: F.array_join(F.slice(a, 1, most), ", ")
    more = F.when(F.size(missing) > most, F.format_string(" (+%d more)", F.size(missing) - most)).otherwise("")
    return F.array_compact(
        F.array(
            F.format_string("skill coverage %d%% (%d/%d JD terms supported by profile)", percent, F.size(matched), total),
            *lines,
            *([note] if note is not None else []),
            F.when(F.size(missing) > 0, F.concat(F.lit("gaps (never inserted): "), listed(missing), more)),
            F.when(F.size(matched) > 0, F.concat(F.lit("supported JD terms: "), listed(matched))),
        )
    )


def match_postings(df: DataFrame, known: Column, rubric: Rubric | None = None, lexicon: dict[str, list[str]] | None = None) -> DataFrame:
    """Postings that :func:`postmill.operators.filters.filter_postings` has read, with coverage, domain_scores, components, score, band and match_reasons.

    ``known`` is the array of terms that the profile supports. Terms and relevance are read from the
    title and the part of the description about the role, so what a company says of itself adds
    nothing. Without terms the coverage counts a half in the score, but is reported as 0.
    """
    r, words = rubric or Rubric(), lexicon or LEXICON
    df = df.withColumn("__role", role_description(F.col("description")))
    spoken = F.concat_ws(" ", F.nullif("title", F.lit("")), F.nullif("__role", F.lit("")))
    df = df.withColumns({"coverage": let(extract_terms(spoken, words), lambda t: term_split(t, known)), "domain_scores": role_relevance(F.col("title"), F.col("__role"), {k: list(v) for k, v in r.target_terms.items()})})
    c, w = F.col("coverage"), F.col("window")
    terms = F.size(c["matched"]) + F.size(c["missing"])
    parts = {
        "skill_coverage": F.when(terms > 0, c["ratio"]).otherwise(0.5),
        "role_relevance": best_domain(F.col("domain_scores")),
        "location_fit": F.col("place.score"),
        "window_fit": F.when(w["overlaps"], w["confidence"]).when(~w["overlaps"], 0.0).otherwise(0.3),
        "seniority_fit": F.col("is_internship").cast("double"),
    }
    df = df.withColumn("components", F.struct(*(v.alias(k) for k, v in parts.items())))
    part = {k: F.col(f"components.{k}") for k in parts}
    df = df.withColumn("score", rubric_score(part, r)).withColumn("band", band(F.col("score"), part["role_relevance"], r))
    two = lambda x: F.format_string("%.2f", x)
    by_domain = [x for i, k in enumerate(r.target_terms) for x in (F.lit(f"{', ' if i else ''}{k}="), two(F.col("domain_scores")[k]))]
    lines = [
        F.concat(F.lit("role relevance "), two(part["role_relevance"]), F.lit(" ("), *(by_domain or [F.lit("no target domains")]), F.lit(")")),
        F.concat(F.lit("location fit "), two(part["location_fit"]), F.lit(": "), F.col("place.detail")),
        F.concat(F.lit("window fit "), two(part["window_fit"]), F.lit(": "), w["detail"]),
        F.concat(F.lit("seniority fit "), two(part["seniority_fit"]), F.lit(": "), F.when(F.col("is_internship"), "internship").otherwise("not an internship")),
    ]
    return df.withColumn("match_reasons", reasons(c["matched"], c["missing"], lines, band_note(F.col("score"), part["role_relevance"], r))).drop("__role")
