"""Hard filters: each gives a struct of name, passed, detail, score and review_only; all are evaluated and every reason is kept.

The texts of details are fixed values of the rules. Columns are built in steps: lower-case texts
once, then the terms found in them, then the ladders that decide, so nothing is searched twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill.config import Rules
from postmill.functions.money import stipend, stipend_label
from postmill.functions.temporal import window
from postmill.functions.text import any_of, find_terms, let, searchable_text

#: Characters of a description that are read for the kind of work, and for places.
KIND_CHARS, PLACE_CHARS = 1500, 600


def check(name: str, passed: Column | bool, detail: Column | str, score: Column | float, review: bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(name).alias("name"), lit(passed).alias("passed"), lit(detail).alias("detail"), lit(score).cast("double").alias("score"), F.lit(review).alias("review_only"))


def _said(before: str, hit: Column, after: str = "") -> Column:
    return F.concat(F.lit(f"{before} '"), hit, F.lit(f"'{after}"))


def _find(text: Column, **lists: tuple[str, ...]) -> Column:
    return find_terms(text, {name: list(terms) for name, terms in lists.items()})


def kind_hits(r: Rules) -> Column:
    """The terms found for the kind of work: of full-time work in head and body, of internships in title, head, body and all of it, of seniority."""
    text = lambda c: F.coalesce(c, F.lit(""))
    title, kind, body = text("title"), text("employment_type"), F.substring(text("description"), 1, KIND_CHARS)
    head, every = F.concat_ws(" ", title, kind), F.concat_ws(" ", title, kind, body)
    found = F.struct(
        _find(head, ft_head=r.full_time, head=r.internship).alias("h"), _find(body, ft_body=r.full_time, body=r.internship).alias("b"),
        _find(title, title=r.internship, senior=r.seniority).alias("t"), _find(every, any=r.internship).alias("e"),
    )
    return let(found, lambda x: F.struct(*(x[p][n].alias(n) for p, n in (("h", "ft_head"), ("b", "ft_body"), ("t", "title"), ("h", "head"), ("b", "body"), ("e", "any"), ("t", "senior")))))


def internship(h: Column) -> Column:
    return F.when(h["any"].isNotNull(), check("internship", True, _said("matched internship keyword", h["any"]), 1.0)).otherwise(check("internship", False, "not identifiable as an internship", 0.0))


def full_time(h: Column) -> Column:
    c = lambda *a, **k: check("fulltime", *a, **k)
    both = F.concat(_said("ambiguous: full-time signal", h["ft_body"]), _said(" in the description alongside internship signal", h["any"], "; review before applying"))
    return (
        F.when(h["ft_head"].isNotNull() & h["title"].isNotNull(), c(True, _said("ambiguous: internship title with full-time signal", h["ft_head"], "; review before applying"), 0.3, review=True))
        .when(h["ft_head"].isNotNull(), c(False, _said("full-time signal", h["ft_head"]), 0.0))
        .when(h["ft_body"].isNotNull() & h["any"].isNotNull(), c(True, both, 0.3, review=True))
        .when(h["ft_body"].isNotNull(), c(False, _said("full-time signal", h["ft_body"], " in the description"), 0.0))
        .when(h["head"].isNotNull(), c(True, "internship keyword present", 1.0))
        .when(h["body"].isNotNull(), c(True, "internship keyword in description", 0.7))
        .otherwise(c(True, "no full-time signal", 0.5))
    )


def seniority(h: Column) -> Column:
    return F.when(h["senior"].isNotNull() & h["title"].isNull(), check("seniority", False, _said("seniority keyword", h["senior"], " in title"), 0.0)).otherwise(check("seniority", True, "no seniority conflict", 1.0))


def quoted(c: str) -> Column:
    """A text in single quotes; in double ones if it holds a single quote and no double one, and else with its single quotes escaped."""
    x = F.col(c)
    single, double = F.contains(x, F.lit("'")), F.contains(x, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'")))


def place_hits(r: Rules) -> Column:
    """The terms found for the place, in the location and in the beginning of the description."""
    place, head = F.lower(F.coalesce("location", F.lit(""))), F.substring(F.lower(F.coalesce("description", F.lit(""))), 1, PLACE_CHARS)
    both = F.concat_ws(" ", place, head)
    # what is left of a location without the words for remote and everywhere
    plain = any_of(t.strip().lower() for t in (*r.everywhere, *r.remote))
    left = F.regexp_replace(place, rf"(?<![a-z0-9]){plain}(?![a-z0-9])", " ")
    found = F.struct(
        _find(place, home=r.home, abroad=r.abroad, world=r.everywhere, remote=r.remote, barred=r.restricted).alias("p"),
        _find(both, barred_text=r.restricted, home_text=r.home).alias("b"), _find(head, barred=r.restricted, rights=r.work_rights).alias("h"),
    )
    return let(found, lambda x: F.struct(
        *(x["p"][n].alias(n) for n in ("home", "abroad", "world", "remote", "barred")), x["b"]["barred_text"].alias("barred_text"), x["b"]["home_text"].alias("home_text"), F.coalesce(x["h"]["barred"], x["h"]["rights"]).alias("stated"),
        F.coalesce(F.col("is_remote"), F.lit(False)).alias("typed"), (F.trim(place) == "").alias("blank"), left.rlike("[a-z0-9]").alias("named"), quoted("location").alias("spot"),
    ))


def location(h: Column, r: Rules) -> Column:
    """score, eligible, detail and auto_ok of the place, by the first rule that applies to :func:`place_hits`."""
    out = lambda score, ok, detail, auto=True: F.struct(F.lit(score).cast("double").alias("score"), F.lit(ok).alias("eligible"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"), F.lit(auto).alias("auto_ok"))
    bars = "location/work-authorization restriction:"
    country, remote = h["home"].isNotNull() | h["abroad"].isNotNull(), h["typed"] | h["remote"].isNotNull()
    told = F.concat(F.lit("location/work-authorization restriction stated in the description ('"), h["stated"], F.lit("'); review before applying"))
    unknown = ~h["blank"] & ~country & h["world"].isNull() & h["named"]
    return (
        F.when(h["barred"].isNotNull(), out(0.0, False, _said(bars, h["barred"])))
        .when(country & h["barred_text"].isNotNull(), out(0.0, False, _said(bars, h["barred_text"])))
        .when(~country & h["stated"].isNotNull() & remote, out(0.85, True, told, False))
        .when(~country & h["stated"].isNotNull(), out(0.5, True, told, False))
        .when(h["home"].isNotNull(), out(1.0, True, "location is in India"))
        .when(h["world"].isNotNull(), out(0.95, True, "globally remote"))
        .when(unknown & (h["home_text"].isNotNull() | remote), out(0.5, True, F.concat(F.lit("location "), h["spot"], F.lit(" is not confirmably open to India; review before applying")), False))
        .when(~country & h["home_text"].isNotNull(), out(0.9, True, "India mentioned in posting"))
        .when(remote & h["abroad"].isNull(), out(0.85, True, "remote with no country restriction"))
        .when(remote & F.lit(r.allow_onsite_abroad), out(0.5, True, F.concat(F.lit("remote restricted to "), h["abroad"], F.lit(", allowed by config"))))
        .when(remote, out(0.1, False, _said("remote restricted to non-India region", h["abroad"])))
        .when(h["blank"] & F.lit(r.allow_unknown_location), out(0.4, True, "location unspecified (allowed by config)"))
        .when(h["blank"], out(0.0, False, "location unspecified"))
        .when(h["abroad"].isNotNull() & F.lit(r.allow_onsite_abroad), out(0.4, True, F.concat(F.lit("onsite abroad ("), h["abroad"], F.lit("), allowed by config"))))
        .when(h["abroad"].isNotNull(), out(0.0, False, F.concat(F.lit("onsite location abroad ('"), h["abroad"], F.lit("')"))))
        .otherwise(out(0.2, False, F.concat(F.lit("location not confirmably open to India ("), h["spot"], F.lit(")"))))
    )


def with_place(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``df`` (location, description, is_remote) with place: score, eligible, detail, auto_ok."""
    r = rules or Rules()
    return df.withColumn("place", let(place_hits(r), lambda h: location(h, r)))


def filter_postings(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """``df`` with checks, eligible, reject_reasons, window, stipend, place and review_reasons.

    Needs title, company, location, employment_type, description, is_remote, and open: the struct of
    :func:`postmill.functions.temporal.open_state`.
    """
    r = rules or Rules()
    text = searchable_text("title", "company", "location", "employment_type", "description")
    df = with_place(df, r).withColumns({"__kind": kind_hits(r), "stipend": stipend(F.col("description"), r.stipend_floor), "window": window(text, *r.window_months, prose=F.col("description"))})
    w, s, p, o, k = (F.col(c) for c in ("window", "stipend", "place", "open", "__kind"))
    timing = (
        F.when(w["overlaps"], F.concat(w["detail"], F.lit(" overlaps Jan-Jun")))
        .when(~w["overlaps"], F.concat(w["detail"], F.lit(" does not overlap Jan-Jun")))
        .otherwise(F.concat(w["detail"], F.lit("; unknown window allowed by config" if r.allow_unknown_window else "; unknown window, eligible for review only")))
    )
    closed = o["state"] == "closed"
    checks = F.array(
        internship(k),
        full_time(k),
        seniority(k),
        check("india_eligible", p["eligible"], p["detail"], p["score"]),
        check("application_open", ~closed, F.coalesce(F.nullif(o["reason"], F.lit("")), F.lit("not stated")), F.when(closed, 0.0).otherwise(0.5)),
        check("stipend", ~s["state"].isin("confirmed_below_floor", "unpaid"), stipend_label(s), F.when(s["state"] == "confirmed_ge_floor", 1.0).when(s["state"] == "unstated", 0.5).otherwise(0.0)),
        check("window", F.coalesce(w["overlaps"], F.lit(True)), timing, F.when(w["overlaps"], w["confidence"]).when(w["overlaps"].isNull() & F.lit(r.allow_unknown_window), 0.3).otherwise(0.0)),
    )
    df = df.withColumn("checks", checks)
    soft = F.array_compact(
        F.array(
            F.when(~p["auto_ok"], p["detail"]),
            F.get(F.transform(F.filter("checks", lambda c: (c["name"] == "fulltime") & c["review_only"]), lambda c: c["detail"]), 0),
            F.when(s["state"] == "unstated", F.lit("stipend not stated; verify before applying")),
        )
    )
    df = df.withColumns({"reject_reasons": F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: F.concat_ws(": ", c["name"], c["detail"])), "review_reasons": soft})
    return df.withColumn("eligible", F.size("reject_reasons") == 0).withColumn("is_internship", k["any"].isNotNull()).drop("__kind")


def red_flags(df: DataFrame) -> Column:
    """Warnings about a matched posting, in a fixed order: place, remoteness, kind, gaps, coverage, pay.

    Needs what :func:`filter_postings` and :func:`postmill.operators.score.match_postings` add.
    """
    p, c = F.col("place"), F.col("coverage")
    gaps = F.size(c["missing"])
    return F.array_compact(F.array(
        F.when(~p["eligible"], F.concat(F.lit("location may not be open to India: "), p["detail"])),
        F.when(F.col("is_remote").isNull() & ~F.contains(F.lower(F.coalesce("location", F.lit(""))), F.lit("remote")), "remote eligibility is not stated; confirm the work location"),
        F.when(~F.col("is_internship"), "posting does not clearly read as an internship"),
        F.when(gaps >= 8, F.concat(F.lit("JD asks for "), gaps.cast("string"), F.lit(" skills absent from the profile; these are reported as gaps and were not inserted"))),
        F.when((c["ratio"] < 0.25) & (F.size(c["matched"]) + gaps > 0), "low keyword coverage; the resume may not speak to this JD"),
        F.when(F.contains(F.lower(F.coalesce("description", F.lit(""))), F.lit("unpaid")), "posting may be unpaid; confirm"),
    ))
