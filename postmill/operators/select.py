"""Selection: buckets with reasons, routes, the guard chain, robots rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.config import Lifecycle
from postmill.operators.state import within_cap


def buckets(df: DataFrame, include: float = 0.5, borderline: float = 0.4, most_borderline: int = 8) -> DataFrame:
    """``df`` with bucket and reason, by the first rule that applies.

    Needs id, open_state, excluded, stipend_state, title_hit, relevance and score. Borderline rows are
    shown, best first and a bounded number, only where nothing is included; else they are held.
    """
    reason = (
        F.when(F.col("open_state") == "closed", "closed")
        .when(F.col("excluded"), "already applied")
        .when(F.col("stipend_state").isin("confirmed_below_floor", "unpaid"), "stipend")
        .when(F.col("title_hit"), "non-technical title")
    )
    first = F.when(reason.isNotNull(), "excluded").when(F.col("relevance") >= include, "included").when(F.col("relevance") >= borderline, "held").otherwise("excluded")
    out = df.withColumn("bucket", first).withColumn("reason", F.coalesce(reason, F.when(F.col("bucket") == "excluded", "low relevance"), F.lit("")))
    any_in = out.agg(F.count_if(F.col("bucket") == "included").alias("n_in"))
    best = out.where("bucket = 'held'").orderBy(F.desc("score"), "id").limit(most_borderline).select("id", F.lit(True).alias("shown"))
    out = out.join(best, "id", "left").crossJoin(F.broadcast(any_in))
    return out.withColumn("bucket", F.when((F.col("n_in") == 0) & F.col("shown"), "borderline").otherwise(F.col("bucket"))).drop("shown", "n_in")


def route(source: Column, band: Column, category: Column, reason: Column, limits: Lifecycle) -> Column:
    """A struct of route, label and detail: by hand for some sources, automatic for a strong row that waits for a passing reason only, else to review.

    ``category`` and ``reason`` are those of the posting's latest review. The texts are fixed values.
    """
    out = lambda r, label, detail: F.struct(F.lit(r).alias("route"), F.lit(label).alias("label"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    text = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    strong, passing = band == "strong", F.coalesce(category, F.lit("")).isin(*limits.transient)
    why = F.coalesce(text(reason), text(category), F.lit("the pipeline's guardrails"))
    return (
        F.when(source == "linkedin", out("linkedin", "Review-only (LinkedIn)", "Not submitted. LinkedIn is discovered, tailored and packaged, never auto-submitted."))
        .when(source.isin(*limits.manual_sources), out("linkout", "Review-only link-out", "Not submitted. Manual link-out source: the pipeline prepares the packet and you submit."))
        .when(strong & passing & F.lit(limits.armed), out("auto", "Auto-apply eligible", "Not submitted. Strong auto-apply band, queued only for a transient reason (daily cap, missing channel or auto-apply config); auto-apply is enabled, so a later run can submit it once that condition clears."))
        .when(strong & ~F.lit(limits.armed), out("review", "Review-only (auto-apply off)", "Not submitted. Strong auto-apply band, but auto-apply is off in config, so it was queued for review."))
        .when(strong, out("review", "Review-only", F.concat(F.lit("Not submitted. Strong auto-apply band, but the pipeline routed it to review: "), why, F.lit("."))))
        .otherwise(out("review", "Review-only", F.concat(F.lit("Not submitted. Band '"), F.coalesce(text(band), F.lit("unknown")), F.lit("' is review-only; you submit from the direct link."))))
    )


def guards(**blocked: Column) -> Column:
    """The name of the first guard that blocks, in the order given; submit if none does."""
    out = F.lit(None).cast("string")
    for name, c in reversed(blocked.items()):
        out = F.when(c, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("submit"))


def guard_chain(df: DataFrame, blocked: DataFrame, used_today: DataFrame, limits: Lifecycle, order: list[Column | str], *, allow_unknown_window: bool = False, enabled: bool = True, dry_run: bool = False) -> DataFrame:
    """``df`` with guard: the first that keeps a planned application from being submitted, in the fixed order of the chain, or dry_run or submit.

    Needs stable_id, source, requires_review, window, band, review_reasons and can_submit; ``blocked``
    has the stable_ids that :func:`postmill.operators.state.blocking` finds. The daily cap counts those
    that pass all else in ``order``; ``used_today`` has one row, n.
    """
    marked = df.join(blocked.select("stable_id").distinct().withColumn("__known", F.lit(True)), "stable_id", "left")
    chain = {
        "linkedin": F.col("source") == "linkedin",
        "manual_source": F.col("source").isin(*limits.manual_sources),
        "generation": F.coalesce("requires_review", F.lit(False)),
        "window": F.lit(not allow_unknown_window) & ~F.coalesce(F.col("window.overlaps"), F.lit(False)),
        "match": F.coalesce(F.col("band"), F.lit("")) != "strong",
        "filter": F.size("review_reasons") > 0,
        "config": F.lit(not (enabled and limits.armed)),
        "duplicate": F.coalesce("__known", F.lit(False)),
        "no_channel": ~F.coalesce("can_submit", F.lit(False)),
    }
    first = marked.withColumn("guard", guards(**chain)).drop("__known")
    ready = within_cap(first.where("guard = 'submit'").select("stable_id", *(c for c in ("score",) if c in first.columns)), used_today, limits.daily_cap, order)
    out = first.join(ready.select("stable_id", F.col("capped").alias("__capped")), "stable_id", "left")
    last = "dry_run" if dry_run else "submit"
    return out.withColumn("guard", F.when(F.col("guard") != "submit", F.col("guard")).when(F.col("__capped"), "capped").otherwise(last)).drop("__capped")


#: Fields that make a text one of robots rules (fixed values).
ROBOTS_FIELDS = ("user-agent", "allow", "disallow", "sitemap", "crawl-delay", "host")


def robots_rules(policies: DataFrame) -> DataFrame:
    """``policies`` (host, status, body) with readable and rules, an array of (grp, allow, pattern) by lower-case agent.

    A missing policy (404) is readable and has no rules; so is an empty body. A host that answered
    otherwise, not at all (null status), or with a body without any known field is not readable.
    Agents that follow each other share the rules below them; blank lines change nothing.
    """
    lines = F.transform(F.split(F.coalesce("body", F.lit("")), r"\R"), lambda x: F.trim(F.split(x, "#")[0]))
    pairs = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("f"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("v")))
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(True).alias("open"), F.array().cast("array<struct<grp:string,allow:boolean,pattern:string>>").alias("rules"))

    def step(acc: Column, p: Column) -> Column:
        agent, rule = p["f"] == "user-agent", p["f"].isin("allow", "disallow") & (F.size(acc["agents"]) > 0)
        added = F.transform(acc["agents"], lambda g: F.struct(g.alias("grp"), (p["f"] == "allow").alias("allow"), p["v"].alias("pattern")))
        return (
            F.when(agent, F.struct(F.concat(F.when(acc["open"], acc["agents"]).otherwise(F.array().cast("array<string>")), F.array(F.lower(p["v"]))).alias("agents"), F.lit(True).alias("open"), acc["rules"].alias("rules")))
            .when(rule, F.struct(acc["agents"].alias("agents"), F.lit(False).alias("open"), F.concat(acc["rules"], added).alias("rules")))
            .otherwise(acc)
        )

    known = F.exists(pairs, lambda p: p["f"].isin(*ROBOTS_FIELDS))
    read = (F.col("status") == 200) & (known | (F.trim(F.coalesce("body", F.lit(""))) == ""))
    rules = F.when(F.col("status") == 200, F.aggregate(pairs, start, step)["rules"]).otherwise(start["rules"])
    return policies.select("host", F.coalesce(read | (F.col("status") == 404), F.lit(False)).alias("readable"), rules.alias("rules"))


def robots_allowed(urls: DataFrame, policies: DataFrame, agent: str) -> DataFrame:
    """(url_id, allowed): whether both the rules for ``agent``, or for all if it has none, and those for all allow a path.

    ``urls`` has url_id, host, path; ``policies`` is that of :func:`robots_rules`, one row a host, its
    rules in one array, so a host with very many URLs is joined like any other. In a pattern * stands for
    anything and $ for the end; both sides are compared without %-escapes. The longest match
    decides, disallow in a tie; no match allows. A host without a readable policy allows nothing.
    """
    plain = lambda c: F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)
    regex = lambda p: F.concat(F.lit("^"), F.replace(F.regexp_replace(p, r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))

    def verdict(rules: Column, path: Column) -> Column:
        hits = F.filter(F.transform(rules, lambda r: F.struct(F.length(plain(r["pattern"])).alias("n"), (~r["allow"]).alias("bad"), regex(plain(r["pattern"])).alias("rx"))), lambda r: (r["n"] > 0) & F.rlike(path, r["rx"]))
        return ~F.coalesce(F.array_max(F.transform(hits, lambda r: F.struct(r["n"].alias("n"), r["bad"].alias("bad"))))["bad"], F.lit(False))

    joined = urls.join(policies, "host", "left")
    of = lambda g: F.filter("rules", lambda r: r["grp"] == g)
    path = F.coalesce(F.nullif(plain(F.col("path")), F.lit("")), F.lit("/"))
    own = F.when(F.size(of(agent.lower())) > 0, of(agent.lower())).otherwise(of("*"))
    return joined.select("url_id", F.coalesce(F.col("readable") & verdict(own, path) & verdict(of("*"), path), F.lit(False)).alias("allowed"))


def sectioned_rank(df: DataFrame, section: str, score: str, order: str, top: int) -> DataFrame:
    """The first ``top`` rows of two ordered sections with a running number: a top-k, then a window over what is left."""
    by = [F.asc(section), F.desc(score), F.asc(order)]
    return df.orderBy(*by).limit(top).withColumn("rank", F.row_number().over(Window.orderBy(*by)))


def weakest(df: DataFrame, entry: str, relevance: str, order: str, n: int) -> DataFrame:
    """The ``n`` rows of least relevance, each entry's best row being safe."""
    w = Window.partitionBy(entry).orderBy(F.desc(relevance), F.asc(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn > 1").drop("__rn").orderBy(relevance, entry, order).limit(n)
