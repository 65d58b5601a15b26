"""Operator 6: URL filters with redirect equivalence.

Rules (host and path prefix, block or allow) decide pages by themselves; the
longest that fits wins. Pages are aliases of each other when their addresses
differ in scheme, ``www.``, fragment, query order, tracking parameters, a
trailing slash or ``.html`` only (one normal form), or when a redirect
(``<meta http-equiv=refresh>``, or a row of ``redirects``) or a canonical link
(``rel=canonical``) leads from one to the other. Components of that graph are
found distributedly. A page without a rule of its own is blocked if a page of
its component is blocked by a rule, unless a rule allows a page of it
explicitly: an allow rule comes first. Otherwise it is allowed.

Defined results: a null address, or one without ``://``, has an empty host and
path, fits no rule and is nobody's alias; null html has no links; a relative
link counts from the page's address (a query from its path, ``./`` and ``../``
resolved, none above the root), and one of another scheme without a host
(``mailto:``) leads nowhere; repeated page ids are judged row by row. Columns
other than page_id, url and html stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components

Rules = list[tuple[str, str, str]]  # (host, path with its leading slash, block or allow)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+)(=|$)"
_TAG = r"(?is)<(?:link|meta)\b[^>]*\b(?:rel\s*=\s*[\"']?canonical\b|http-equiv\s*=\s*[\"']?refresh\b)[^>]*>"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def normal(url: Column) -> Column:
    """One form for all aliases by spelling; null if there is no host."""
    h = F.regexp_replace(host(url), r"^www\.|:(80|443)$", "")
    p = F.regexp_replace(path(url), r"(/|/index\.html?|\.html?)$", "")
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(_TRACKING))), "&")
    return F.when(h != "", F.concat(h, p, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_of(h: Column, p: Column, rules: Rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for rh, rp, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        hit = F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def absolute(url: Column, to: Column) -> Column:
    """Where a link on the page of address url leads; null if nowhere."""
    base = F.concat(F.lit("http://"), host(url))
    folder = F.concat(F.regexp_replace(path(url), r"[^/]*$", ""), F.when(path(url).contains("/"), F.lit("")).otherwise(F.lit("/")))
    tail = F.regexp_extract(to, r"^[^?#]*(.*)$", 1)

    def step(a: Column, x: Column) -> Column:
        return F.when((x == "..") & (F.size(a) > 1), F.slice(a, F.lit(1), F.size(a) - 1)).when(x.isin(".", ".."), a).otherwise(F.array_append(a, x))

    parts = F.split(F.concat(folder, F.regexp_extract(to, r"^[^?#]*", 0)), "/")
    ends = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), ends)
    return (
        F.when(to.contains("://"), to).when(to.startswith("//"), F.concat(F.lit("http:"), to)).when(to.startswith("/"), F.concat(base, to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string")).when(to.startswith("#"), F.lit(None).cast("string"))
        .when(to.startswith("?"), F.concat(base, path(url), to)).otherwise(F.concat(base, joined, tail))
    )


def links(pages: DataFrame) -> DataFrame:
    """(source, target) normal forms of the redirects and canonical links in html."""
    tags = pages.where(F.col("html").isNotNull() & F.col("url").isNotNull()).select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0)).alias("tag"))
    to = F.coalesce(
        F.nullif(F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1), F.lit("")),
    )
    full = absolute(F.col("url"), to)
    return tags.select(normal(F.col("url")).alias("source"), normal(full).alias("target")).where("source <> target")


def judge(pages: DataFrame, rules: Rules, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url, html)."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(normal(F.col("source")), normal(F.col("target"))).where("source <> target"))
    comps = connected_components(edges, "source", "target")
    h, p = host(F.col("url")), path(F.col("url"))
    judged = pages.select("page_id", h.alias("host"), p.alias("path"), normal(F.col("url")).alias("_key"), rule_of(h, p, rules).alias("_rule"))
    judged = judged.select("page_id", "host", "path", "_key", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_own"))
    # decisions by normal form first: a form that a third of all pages share is one row a task
    forms = judged.where("_own is not null and _key is not null").groupBy("_key").agg(F.bool_or(F.col("_own") == "allow").alias("_allow"), F.bool_or(F.col("_own") == "block").alias("_block"))
    forms = forms.join(comps, F.col("_key") == F.col("node"), "left").select(F.coalesce("component", "_key").alias("_comp"), "_allow", "_block")
    decided = forms.groupBy("_comp").agg(F.when(F.bool_or("_allow"), "allow").when(F.bool_or("_block"), "block").alias("_passed"))
    open_ = judged.where("_own is null")
    keys = open_.where("_key is not null").select("_key").distinct().join(comps, F.col("_key") == F.col("node"), "left").select("_key", F.coalesce("component", "_key").alias("_comp"))
    passed = keys.join(decided, "_comp").select("_key", "_passed")
    own = judged.where("_own is not null").select("page_id", "host", "path", "rule", F.col("_own").alias("verdict"))
    rest = open_.join(passed, "_key", "left").select("page_id", "host", "path", "rule", F.coalesce("_passed", F.lit("allow")).alias("verdict"))
    return own.unionByName(rest)
