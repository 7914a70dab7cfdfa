"""URL filters with redirect equivalence, in DataFrame functions only.

A url's own rule decides first: rules name a host (and all its subdomains)
and a path prefix, the longest fitting rule wins.  A url without a rule gets
the decision of its aliases: pages are linked by redirect and canonical-link
edges, and in each connected component an explicit allow takes precedence
over a block (the rules of linked addresses count, crawled or not); a component without any decision is allowed.

Edges come from the page itself: ``<link rel=canonical>`` and
``<meta http-equiv=refresh>`` in its html (every one; relative targets are
resolved against the page's url), and the url's
canonical form, to which sites redirect (scheme, ``www.``/``m.`` prefix,
fragment, tracking parameters, ``.html`` and a trailing slash removed).  A
table of observed redirects (from_url, to_url) may be given as well.

The canonical form is a function of the url, so it needs no join: nodes are
canonical forms, and only edges between different forms enter the component
search (bounded shuffles, no per-component collection; hot components are
aggregated on the map side).

Defined results: null or non-absolute urls have empty host and path, no rule
and no aliases, and are allowed; repeated urls share a component and each
keeps its row; null html has no links; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, rule): a host and a path, the path from the first slash on.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DEFAULT = "allow"
TRACKING = r"(?i)^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: The tags that may name another address of the page, and the address in them.
LINK_TAG = r"(?is)<link\b[^>]*>"
IS_CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?is)<meta\b[^>]*>"
IS_REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
#: A target with a scheme but no host (mailto:, javascript:) is no address.
OPAQUE = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(len, rule, verdict) of the longest rule that fits, or null.  At
    equal length an allow wins."""
    fits = []
    for verdict, rule in rules:
        rhost, slash, rpath = rule.partition("/")
        rpath = slash + rpath
        ok = ((host == rhost) | F.endswith(host, F.lit("." + rhost))) & F.startswith(
            path, F.lit(rpath))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("len"),
                                        F.lit(int(verdict == "allow")).alias("allow"),
                                        F.lit(rule).alias("rule"),
                                        F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def canonical_form(url: Column) -> Column:
    """The form of an absolute url that its variants redirect to; else null."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(after_scheme(url), r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)), "&")
    form = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query))
                    .otherwise(F.lit("")))
    return F.when(host != "", form)


def resolved(url: Column, target: Column) -> Column:
    """The absolute form of a link target of the page at ``url``: absolute,
    ``//host/path``, ``/path``, ``?query`` or relative to the page's folder,
    with ``./`` and ``../`` taken out; null for other schemes and for pages
    without an absolute url."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.concat(scheme, F.lit("://"), F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*", 0))
    own = path_of(url)
    folder = F.coalesce(F.nullif(F.regexp_extract(own, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    full = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    # a stack of segments: ".." drops the last one, "." and the first "" add none
    parts = F.split(F.substring(full, 2, F.length(full)), "/")
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(
        x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(
        F.concat(a, F.array(x))))
    ends = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(stack) > 0), F.lit("/")).otherwise(F.lit(""))
    absolute = F.when(F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target) \
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target)) \
        .when(F.rlike(target, F.lit(OPAQUE)), F.lit(None).cast("string")) \
        .when(path == "", F.concat(base, own, rest)) \
        .otherwise(F.concat(base, F.lit("/"), F.array_join(stack, "/"), ends, rest))
    return F.when((F.instr(url, "://") > 0) | F.rlike(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), absolute)


def page_links(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical and refresh link in the html."""
    def targets(tag: str, kind: str, address: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: x.rlike(kind))
        return F.transform(tags, lambda x: F.regexp_extract(x, address, 1))

    html = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.select("url", html.alias("html")).filter(
        F.col("html").rlike(r"(?i)canonical|http-equiv\s*=\s*[\"']?refresh"))
    found = marked.select("url", F.explode(F.concat(
        targets(LINK_TAG, IS_CANONICAL, HREF), targets(META_TAG, IS_REFRESH, REFRESH_URL)))
        .alias("target")).filter(F.col("target") != "")
    return found.select("url", resolved(F.col("url"), F.col("target")).alias("target")) \
        .filter(F.col("target").isNotNull())


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None,
                default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, alias_class."""
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("from_url").alias("url"),
                                                   F.col("to_url").alias("target")))
    def rule_of(c: str) -> Column:
        return longest_rule(host_of(F.col(c)), path_of(F.col(c)), rules)

    # both ends of a link are addresses with rules of their own, crawled or not
    links = materialize(links.select(
        canonical_form(F.col("url")).alias("a"), canonical_form(F.col("target")).alias("b"),
        rule_of("url").getField("allow").alias("allow_a"),
        rule_of("target").getField("allow").alias("allow_b")).distinct(), "url_links")
    edges = links.select("a", "b").filter(
        F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    roots = materialize(components(edges), "url_components")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"),
                        path_of(F.col("url")).alias("path"),
                        canonical_form(F.col("url")).alias("node"))
    rows = rows.withColumn("own", longest_rule(F.col("host"), F.col("path"), rules))
    rows = rows.join(roots, "node", "left").withColumn("alias_class", F.coalesce("root", "node"))
    rows = materialize(rows.drop("node", "root"), "url_rows")
    ends = links.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("allow_a").alias("allow")),
        F.struct(F.col("b").alias("node"), F.col("allow_b").alias("allow")))).alias("e")).select("e.*") \
        .filter(F.col("allow").isNotNull()).join(roots, "node", "left") \
        .select(F.coalesce("root", "node").alias("alias_class"), "allow")
    # decisions of a class: one row per class that has any, allow before block
    decided = rows.filter(F.col("own").isNotNull()).select("alias_class", "own.allow").unionByName(ends) \
        .filter(F.col("alias_class").isNotNull()).groupBy("alias_class").agg(F.max("allow").alias("allow"))
    decided = materialize(decided, "url_decisions")
    got = rows.join(decided, "alias_class", "left")
    inherited = F.when(F.col("allow") == 1, F.lit("allow")).when(
        F.col("allow") == 0, F.lit("block")).otherwise(F.lit(default))
    return got.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                      F.coalesce(F.col("own.verdict"), inherited).alias("verdict"),
                      "alias_class")
