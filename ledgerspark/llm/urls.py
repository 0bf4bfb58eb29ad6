"""URL filters by redirect equivalence (operator 9), in DataFrame functions only.

Rules are given as ``(verdict, "host/path")``. A rule fits its host and all subdomains if
the url's path starts with the rule's path; the longest rule that fits decides. A url that
no rule fits takes the decision of its aliases: urls joined by redirect or canonical-link
edges form a class (distributed connected components); an explicit allow in the class
outranks blocks, a block without one blocks, and without either the url is allowed.

Edges come from a page's canonical link and meta refresh, from any link table given, and
from each url to its own canonical spelling (scheme, ``www.``/``m.``, fragment, tracking
parameters, ``.html`` and a closing slash dropped), which is where such hosts redirect.

A null url, or one without ``://``, has an empty host and path, no rule, and is allowed.
Repeated pages give repeated rows, an empty table none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical spelling, or null without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html$", ""), "/$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[^=&]*|ref)(=[^&]*)?", ""), "^&", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The (rule, verdict) that decides, or null; of equal rules an allow."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "allow")):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p))
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def link_edges(pages: DataFrame) -> DataFrame:
    """``u, v`` of canonical links and meta refreshes in ``html``, absolute targets only."""
    tag = F.regexp_extract("html", r"(?is)<link\s[^>]*rel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    link = F.regexp_extract(tag, r"(?is)href\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract("html", r"(?is)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    to = F.regexp_extract(meta, r"(?is)url\s*=\s*[\"']?([^\"'\s>;]+)", 1)
    out = pages.select(F.col("url").alias("u"), F.explode(F.array(link, to)).alias("v"))
    return out.where(F.contains("v", F.lit("://")) & F.col("u").isNotNull())


def judge(pages: DataFrame, scratch: Scratch, rules=RULES, links: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page."""
    own = pages.select("page_id", "url")
    edges = link_edges(pages.select("url", "html"))
    edges = edges if links is None else edges.unionByName(links.select("u", "v"))
    ends = own.select("url").unionByName(edges.select(F.col("v").alias("url"))).unionByName(edges.select(F.col("u").alias("url")))
    spelt = ends.where(F.col("url").isNotNull()).distinct().select(F.col("url").alias("u"), canonical(F.col("url")).alias("v"))
    groups = scratch.keep(components(edges.unionByName(spelt.where(F.col("v").isNotNull())), scratch), "groups")
    decided = groups.withColumn("r", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules))
    blocked = (
        decided.groupBy("component")
        .agg(F.bool_or(F.col("r.verdict") == "allow").alias("allowed"), F.bool_or(F.col("r.verdict") == "block").alias("blocked"))
        .where("blocked and not coalesce(allowed, false)")
        .select("component")
    )
    ruleless = decided.where("r is null").select("component", F.col("node").alias("url"))
    aliases = ruleless.join(blocked, "component").select("url", F.lit("block").alias("by_alias"))
    # plain joins: a hot class or url is split by adaptive execution
    out = own.withColumn("r", rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)).join(aliases, "url", "left")
    return out.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "by_alias", F.lit("allow")).alias("verdict"),
    )


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "op9"))


def _sql_rule() -> str:
    whens = []
    for verdict, rule in sorted(RULES, key=lambda x: (-len(x[1]), x[0] != "allow")):
        h, slash, p = rule.partition("/")
        whens.append(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}') THEN '{verdict} {rule}'")
    return f"CASE {' '.join(whens)} END"


def _sql_parts(url: str) -> str:
    return (
        f"translate(coalesce(regexp_extract({url}, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, "
        f"coalesce(regexp_extract({url}, '://[^/?#]*([^?#]*)', 1), '') AS path"
    )


ORACLE = rf"""
WITH RECURSIVE linked AS (
  SELECT url AS u, unnest([
    regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)url\s*=\s*["'']?([^"''\s>;]+)', 1)]) AS v FROM pages),
links AS (SELECT u, v FROM linked WHERE contains(v, '://') AND u IS NOT NULL),
ends AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT u FROM links UNION SELECT v FROM links),
parts AS (SELECT url, {_sql_parts('url')},
  regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^=&]*|ref)(=[^&]*)?', '', 'g'), '^&', '') AS kept FROM ends),
edges AS (SELECT u, v FROM links UNION
  SELECT url, 'https://' || regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html$', ''), '/$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END
  FROM parts WHERE contains(url, '://')),
both_ AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(n, r) AS (SELECT u, u FROM both_ UNION SELECT b.v, x.r FROM reach x JOIN both_ b ON b.u = x.n),
groups_ AS (SELECT n, min(r) AS g FROM reach GROUP BY n),
decided AS (SELECT n, g, {_sql_rule()} AS d FROM (SELECT n, g, {_sql_parts('n')} FROM groups_)),
blocked AS (SELECT g FROM decided GROUP BY g HAVING coalesce(bool_or(d LIKE 'block%'), false) AND NOT coalesce(bool_or(d LIKE 'allow%'), false)),
aliases AS (SELECT n FROM decided JOIN blocked USING (g) WHERE d IS NULL),
own AS (SELECT page_id, url, host, path, {_sql_rule()} AS d FROM (SELECT page_id, url, {_sql_parts('url')} FROM pages))
SELECT page_id, host, path, CASE WHEN d IS NOT NULL THEN split_part(d, ' ', 2) END AS rule,
  CASE WHEN d IS NOT NULL THEN split_part(d, ' ', 1) WHEN url IN (SELECT n FROM aliases) THEN 'block' ELSE 'allow' END AS verdict
FROM own
"""
