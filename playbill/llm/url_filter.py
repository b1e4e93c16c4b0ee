"""Block and allow rules for URLs, carried to other addresses of the same page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace
from .components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits host and path, or null."""
    fits = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        mine = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        fits = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), mine).otherwise(fits)
    return fits


#: Names of parameters that count visits and choose no page.
TRACKERS = r"^(utm_[^=]*|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|igshid)(=|$)"


def url_query(url: Column) -> Column:
    """What follows the first ? up to #, without parameters that only track visits; else empty."""
    text = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.array_join(F.filter(F.split(text, "&"), lambda p: (p != "") & ~p.rlike(TRACKERS)), "&")


def canonical_spelling(url: Column) -> Column:
    """The address without what does not choose a page: scheme, www. or m., trackers, fragment, .html, last slash."""
    host = F.regexp_replace(url_host(url), r"^((www|m)\.)+", "")
    query = url_query(url)
    page = F.concat(F.lit("page://"), host, F.regexp_replace(url_path(url), r"(\.html?|/)+$", ""))
    return F.when(host != "", F.concat(page, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


#: Entities that stand in addresses.
ENTITIES = {"&(lt|#60|#x3c);": "<", "&(gt|#62|#x3e);": ">", "&(quot|#34|#x22);": '"', "&(apos|#39|#x27);": "'", "&(#47|#x2f|sol);": "/", "&(#58|#x3a|colon);": ":", "&(amp|#38|#x26);": "&"}


def decoded(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.regexp_replace(text, "(?i)" + entity, char)
    return text


def resolved(link: Column, url: Column) -> Column:
    """The absolute address of a link on the page of this url: whole, from //, /, ? or the page's folder on; null if it has no host or is a place on that page."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), url_host(url))
    folder = F.regexp_replace(url_path(url), r"[^/]*$", "")
    path, rest = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(.*)$", 1)
    joined = F.when(path.startswith("/"), path).when(path == "", url_path(url)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    up = lambda found, s: F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(1)))
    step = lambda found, s: F.when(s == ".", found).when(s == "..", up(found, s)).otherwise(F.array_append(found, s))
    parts = F.split(F.regexp_replace(joined, r"(^|/)(\.\.?)$", "$1$2/"), "/", -1)  # a last dot names a folder
    clean = F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step), "/")
    own = F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
    return own.when(link.rlike(r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:|#)"), None).when(url_host(url) != "", F.concat(root, clean, rest))


def html_targets(html: Column, url: Column) -> Column:
    """Addresses that a page names as its canonical link or redirects to at once, made absolute."""
    flags, value = "(?is)", r"""(?:"[^"]*"|'[^']*'|[^"'\s>]+)"""
    rel = rf"""<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*({value})"""
    refresh = r"""<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(flags + p), F.lit(1)) for p in (rel, refresh)])
    plain = F.transform(found, lambda u: F.trim(decoded(F.regexp_replace(u, "^[\"']|[\"']$", ""))))
    return F.filter(F.transform(F.filter(plain, lambda u: u != ""), lambda u: resolved(u, url)), lambda u: u.isNotNull())


def filter_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row for each page: key, host, path, rule, verdict, component (null: no alias).

    Addresses are joined by edges: from a page to its canonical spelling, to the canonical link and
    the redirect target in its html, and those of `redirects` (columns from_url, to_url). A page
    that a rule names has the rule's verdict. Any other is blocked if an address in its connected
    component is blocked by rule, and else allowed: an allow rule always stands for its own page,
    but frees no alias. Links are made absolute by their page's address; a base element is not read. Null or malformed
    addresses have no host and no alias and are allowed; repeated rows get equal verdicts; a page of any length is searched
    whole; an empty table gives no rows; other columns, whatever their names, are ignored.
    """
    ws = Workspace(pages.sparkSession, "urls")
    at = F.col(url)
    known = pages.select(F.col(key).alias("_k"), at.alias("_u"), F.explode_outer(F.array_append(html_targets(F.col(html), F.coalesce(at, F.lit(""))), canonical_spelling(at))).alias("_to"))
    edges = known.filter("_u is not null and _to is not null").select(F.col("_u").alias("a"), F.col("_to").alias("b"))
    # A target counts under its canonical spelling too, so that chains of redirects close.
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), canonical_spelling(F.col("b")).alias("b")).filter("a <> b"))
    if redirects is not None:
        hops = redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")).dropna()
        ends = hops.select("a").unionByName(hops.select(F.col("b").alias("a"))).select("a", canonical_spelling(F.col("a")).alias("b")).dropna()
        edges = edges.unionByName(hops).unionByName(ends)
    edges = ws.save(edges.distinct(), "edges")
    names = connected_components(edges, ws)
    bad = names.withColumn("_r", longest_rule(url_host(F.col("node")), url_path(F.col("node")), rules)).filter("_r.verdict = 'block'")
    # Many pages of one component send one row.
    blocked = bad.select(F.col("component").alias("_c")).distinct().withColumn("_blocked", F.lit(True))
    # Pages without address or alias have no partner: each gets a key of its own, so that they don't meet in one task.
    own = lambda c: F.coalesce(F.col(c), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    judged = (
        pages.select(F.col(key).alias("_k"), at.alias("_u")).withColumn("_j", own("_u"))
        .join(names.select(F.col("node").alias("_j"), F.col("component").alias("_c")), "_j", "left").withColumn("_j", own("_c"))
        .join(blocked.withColumnRenamed("_c", "_j"), "_j", "left")
        .withColumn("_rule", longest_rule(url_host(F.col("_u")), url_path(F.col("_u")), rules))
    )
    alias = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("_k").alias(key), url_host(F.col("_u")).alias("host"), url_path(F.col("_u")).alias("path"), F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), alias).alias("verdict"), F.col("_c").alias("component"),
    )


def op10_url_aliases(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("component")


#: Without redirects in the tables, a component is the set of pages with one canonical spelling.
OP10_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|gclid|fbclid|msclkid|dclid|mc_cid|mc_eid|igshid)(=|$)')), '&') AS query
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule,
    CASE WHEN host = '' THEN 'page' || page_id ELSE regexp_replace(host, '^((www|m)\.)+', '') || regexp_replace(path, '(\.html?|/)+$', '') || '?' || query END AS page
  FROM p
), v AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS own FROM r
)
SELECT page_id, host, path, rule,
  coalesce(own, CASE WHEN bool_or(own = 'block') OVER (PARTITION BY page) THEN 'block' ELSE 'allow' END) AS verdict
FROM v
"""
