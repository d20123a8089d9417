"""URL filters with redirect equivalence.

A url's own rule decides first: the longest rule whose host is the url's host or a parent
domain of it and whose path starts the url's path.  Urls without a rule share the fate of
their aliases: redirects (meta refresh) and canonical links join urls to components, and a
component with a blocked url is blocked, except for urls that a rule explicitly allows.
Everything else is allowed.

Links are resolved against their page's url, or against its first base element; comments,
scripts and styles have no links.  For aliases, urls are the same if they agree but for the
case of scheme and host, the scheme's own port, dot segments, an empty path for "/", and the
fragment; components run over 128-bit digests of that form.  A url without a rule of its own
whose form has one takes that rule's verdict.

Defined results: a null or malformed url has empty host and path, no rule, and verdict
allow; every row of the table gives one row, repeated rows too; null or empty html has no
links, and links of null or malformed urls are ignored, as are links to other things than
urls with "://" (mailto: and the like); very long html is read whole; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .common import written

#: (verdict, host, path); a short list, compiled to one expression.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
CANONICAL = r"""(?is)<link\b[^>]*\srel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical[\s/>])[^>]*>?"""
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)"
BASE = r"(?is)<base\b[^>]*\shref\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _normal(url: Column) -> Column:
    """The form that stands for a url's aliases; null without "://"."""
    scheme, p = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), path(url)
    # each segment in turn: ".." takes back the one before it
    folded = F.aggregate(F.slice(F.split(p, "/"), F.lit(2), F.size(F.split(p, "/"))), F.lit(""), lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s)))
    folded = F.concat(folded, F.when(p.rlike(r"/\.\.?$"), "/").otherwise(""))
    clean = F.when(p == "", "/").when(p.contains("/."), folded).otherwise(p)
    bare = F.when(scheme == "http", F.regexp_replace(host(url), ":80$", "")).when(scheme == "https", F.regexp_replace(host(url), ":443$", "")).otherwise(host(url))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), bare, clean, F.regexp_extract(url, PARTS, 4)))


def resolved(url: Column, target: Column) -> Column:
    """The whole url of a link on a page; null for a fragment."""
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(url), "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?):", 1), F.lit(":"), target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.startswith("?"), F.concat(origin, path(url), target))
        .when(~target.startswith("#"), F.concat(origin, folder, target))
    )


def _key(normal: Column) -> Column:
    return F.unhex(F.md5(normal))


def alias_edges(pages: DataFrame, rules=RULES) -> DataFrame:
    """(a, b, a_blocked, b_blocked): keys of a page's url and of the target of each of its redirects and canonical links."""
    unquoted = r"[\"']?\s*([^\"'\s>]+)"
    shown = pages.where("contains(url, '://') and html is not null").select("url", F.regexp_replace("html", HIDDEN, " ").alias("html"))
    base = F.nullif(F.regexp_extract("html", BASE, 1), F.lit(""))
    tags = shown.select(
        "url",
        F.coalesce(resolved(F.col("url"), F.replace(base, F.lit("&amp;"), F.lit("&"))), F.col("url")).alias("base"),
        F.explode(
            F.concat(
                F.transform(F.regexp_extract_all("html", F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, r"(?is)\shref\s*=\s*" + unquoted, 1)),
                F.transform(F.regexp_extract_all("html", F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*" + unquoted, 1)),
            )
        ).alias("target"),
    )
    url = F.col("url")
    whole = resolved(F.when(F.contains("base", F.lit("://")), F.col("base")).otherwise(url), F.replace("target", F.lit("&amp;"), F.lit("&")))
    ends = tags.where("target <> ''").select("url", _normal(url).alias("a"), _normal(whole).alias("b")).where("a <> b")
    blocked = lambda u: F.coalesce(rule_of(host(u), path(u), rules)["verdict"] == "block", F.lit(False))
    return ends.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b"), (blocked(url) | blocked(F.col("a"))).alias("a_blocked"), blocked(F.col("b")).alias("b_blocked")).distinct()


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), _normal(F.col("url")).alias("form"))
    own = own.withColumns({"own": rule_of(F.col("host"), F.col("path"), rules), "alike": rule_of(host(F.col("form")), path(F.col("form")), rules), "node": _key(F.col("form"))}).drop("form")
    edges = written(alias_edges(pages, rules), "aliases")
    nodes = written(components(edges), "alias-components")
    sources = edges.where("a_blocked").select(F.col("a").alias("node")).unionByName(edges.where("b_blocked").select(F.col("b").alias("node"))).distinct()
    # written, so that both sides of the join are shuffles and a hot component's partition can be split
    blocked = written(nodes.join(sources.hint("merge"), "node", "left_semi").select("component").distinct(), "blocked-components")
    aliases = nodes.join(blocked.hint("merge"), "component", "left_semi").select(F.col("node"), F.lit("block").alias("alias"))
    judged = own.join(written(aliases, "blocked-aliases").hint("merge"), "node", "left")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alike.verdict", "alias", F.lit("allow")).alias("verdict"))


_TAGS = r"""list_transform(regexp_extract_all(html, '<link\b[^>]*\srel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical[\s/>])[^>]*>?', 0, 'is'), lambda t: regexp_extract(t, '\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is'))
    || list_transform(regexp_extract_all(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), lambda t: regexp_extract(t, '\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is'))"""
_HOST = "translate(coalesce(regexp_extract({0}, '^(.*?)://([^/?#]*)([^?#]*)', 2, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract({0}, '^(.*?)://([^/?#]*)([^?#]*)', 3, 's'), '')"
ORACLE = rf"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS row_id, page_id, url, html, {_HOST.format("url")} AS host, {_PATH.format("url")} AS path FROM pages),
shown AS (SELECT url, path, regexp_replace(html, '<!--(?:.*?-->|.*$)|<script\b[^>]*>(?:.*?</script\s*>|.*$)|<style\b[^>]*>(?:.*?</style\s*>|.*$)', ' ', 'gis') AS html FROM base WHERE contains(url, '://') AND html IS NOT NULL),
heads AS (SELECT *, replace(nullif(regexp_extract(html, '<base\b[^>]*\shref\s*=\s*["'']?\s*([^"''\s>]+)', 1, 'is'), ''), '&amp;', '&') AS h, regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') AS origin FROM shown),
based AS (SELECT url, html, CASE WHEN h IS NULL OR h LIKE '#%' THEN url WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(h, '://') THEN h ELSE url END WHEN h LIKE '//%' THEN regexp_extract(url, '^(.*?):', 1, 's') || ':' || h
  WHEN h LIKE '/%' THEN origin || h WHEN h LIKE '?%' THEN origin || path || h ELSE origin || coalesce(nullif(regexp_extract(path, '^(.*/)', 1, 's'), ''), '/') || h END AS spot FROM heads),
tags AS (SELECT url, spot, {_PATH.format("spot")} AS path, replace(unnest({_TAGS}), '&amp;', '&') AS t FROM based),
links AS (
  SELECT DISTINCT url, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN t WHEN t LIKE '//%' THEN regexp_extract(spot, '^(.*?):', 1, 's') || ':' || t
    WHEN t LIKE '/%' THEN origin || t WHEN t LIKE '?%' THEN origin || path || t
    WHEN t NOT LIKE '#%' THEN origin || coalesce(nullif(regexp_extract(path, '^(.*/)', 1, 's'), ''), '/') || t END AS target
  FROM (SELECT *, regexp_extract(spot, '^(.*?://[^/?#]*)', 1, 's') AS origin FROM tags WHERE t <> '')),
forms AS (
  SELECT raw, translate(regexp_extract(raw, '^(.*?)://', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || regexp_replace({_HOST.format("raw")}, CASE WHEN regexp_matches(raw, '^http://', 'i') THEN ':80$' WHEN regexp_matches(raw, '^https://', 'i') THEN ':443$' ELSE '\\z.' END, '') || CASE WHEN p = '' THEN '/' ELSE
    list_reduce(string_split(p, '/'), lambda done, s: CASE s WHEN '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN '.' THEN done ELSE done || '/' || s END) || CASE WHEN regexp_matches(p, '/\.\.?$') THEN '/' ELSE '' END END
    || coalesce(regexp_extract(raw, '^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?', 4, 's'), '') AS node
  FROM (SELECT raw, {_PATH.format("raw")} AS p FROM (SELECT url AS raw FROM base UNION SELECT target FROM links) WHERE contains(raw, '://'))),
directed AS (SELECT l.url, l.target, f.node AS a, g.node AS b FROM links l JOIN forms f ON f.raw = l.url JOIN forms g ON g.raw = l.target WHERE f.node <> g.node),
edges AS (SELECT a, b FROM directed UNION SELECT b, a FROM directed),
verdicts(rule, host, path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
ends AS (SELECT url AS raw, a AS node FROM directed UNION SELECT a, a FROM directed UNION SELECT b, b FROM directed),
judged_ends AS (
  SELECT n.raw, n.node, arg_max(v.verdict, length(v.rule)) AS verdict
  FROM (SELECT raw, node, {_HOST.format("raw")} AS host, {_PATH.format("raw")} AS path FROM ends) n
  JOIN verdicts v ON (n.host = v.host OR ends_with(n.host, '.' || v.host)) AND starts_with(n.path, v.path) GROUP BY n.raw, n.node),
reached AS (SELECT node FROM judged_ends WHERE verdict = 'block' UNION SELECT e.b FROM reached r JOIN edges e ON e.a = r.node),
alike AS (
  SELECT f.node, arg_max(v.verdict, length(v.rule)) AS verdict FROM (SELECT DISTINCT node, {_HOST.format("node")} AS host, {_PATH.format("node")} AS path FROM forms) f
  JOIN verdicts v ON (f.host = v.host OR ends_with(f.host, '.' || v.host)) AND starts_with(f.path, v.path) GROUP BY f.node),
own AS (
  SELECT b.row_id, b.page_id, b.host, b.path, f.node, arg_max(v.rule, length(v.rule)) AS rule, arg_max(v.verdict, length(v.rule)) AS verdict
  FROM base b LEFT JOIN forms f ON f.raw = b.url LEFT JOIN verdicts v ON (b.host = v.host OR ends_with(b.host, '.' || v.host)) AND starts_with(b.path, v.path)
  GROUP BY b.row_id, b.page_id, b.host, b.path, f.node)
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, a.verdict, CASE WHEN r.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM own o LEFT JOIN reached r ON r.node = o.node LEFT JOIN alike a ON a.node = o.node
"""
