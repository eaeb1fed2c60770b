"""URL filters with redirect equivalence (operator 3).

Rules of (host, path prefix) decide urls directly; the longest rule that fits wins. Pages
also name other urls of themselves: ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``.
Relative targets are resolved against the page's url (a <base> element is not looked at), ``rel``
may list several values, and what stands in an html comment is no link.
Those edges, between urls without scheme, default port and fragment, form components, and a
block decision holds for every alias in its component. An explicit allow takes precedence:
an allow rule is never overruled, and an alias without a rule is allowed where any member of
its component is allowed by a rule. All else is allowed.

Defined cases: a null url, or one without ``://``, has empty host and path, no rule and no
edges, and is allowed; null html has no edges; urls that occur on many pages are one node,
so repeated rows get equal verdicts, each on its own row; an empty table gives an empty
result; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.shared import materialise


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    pattern: str  # host, then the path prefix from its first slash

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "com/"),
    UrlRule("block", "example.com/en/"),
    UrlRule("allow", "www.example.com/en/"),
    UrlRule("block", "net/es/"),
    UrlRule("block", "net/fr/"),
)

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without scheme, default port and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(rest == "", F.lit("/")).otherwise(rest)))


def match_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. The rule list is a parameter of fixed size."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.pattern).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, without its segments ``.`` and ``..``."""
    segments = F.split(path, "/", -1)
    none = F.array().cast("array<string>")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), none, step)
    end = F.when(path.rlike(r"/\.\.?\z"), F.array(F.lit(""))).otherwise(none)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))).otherwise(path)


def resolve(url: Column, target: Column) -> Column:
    """The absolute form of a link on the page ``url``; null for one to the page itself and for schemes without ``//``."""
    bare = F.regexp_replace(target, r"(?s)#.*\z", "")
    path, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)^[^?]*(.*)\z", 1)
    own = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    site = F.concat(F.lit("http://"), host_of(url))
    return (
        F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (bare == ""), F.lit(None).cast("string"))
        .when(path == "", F.concat(site, own, query))
        .when(path.startswith("/"), F.concat(site, without_dots(path), query))
        .otherwise(F.concat(site, without_dots(F.concat(folder, path)), query))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and each canonical or redirect target in its html."""
    tags = F.regexp_extract_all(F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", ""), F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
    p = pages.filter(F.lower("html").rlike(r"canonical|refresh")).select("url", F.explode(tags).alias("tag"))
    quoted = r"""\s*=\s*["']?([^"'>\s]+)"""
    rel = F.regexp_extract("tag", r"""(?i)\srel\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    canonical = F.when(rel.rlike(r"""(?i)(^|[\s"'])canonical([\s"']|\z)"""), F.regexp_extract("tag", "(?i)\\shref" + quoted, 1))
    redirect = F.when(F.col("tag").rlike(r"""(?i)http-equiv\s*=\s*["']?refresh\b"""), F.regexp_extract("tag", r"""(?i)url\s*=\s*["']?([^"'>\s]+)""", 1))
    target = resolve(F.col("url"), F.coalesce(canonical, redirect))
    return p.select(node_of(F.col("url")).alias("a"), node_of(target).alias("b")).filter("a is not null and b is not null and a <> b").distinct()


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, host, path, rule, verdict, component, by ('rule', 'alias' or 'default')."""
    url = F.col("url")
    own = pages.select("page_id", "url", "html").withColumns({"host": host_of(url), "path": path_of(url), "node": node_of(url)}).withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    edges = materialise(alias_edges(pages), "aliases")
    labels = materialise(connected_components(edges), "url-components")
    # every member url of a component counts, also one that is no page of the table
    node_hit = match_rule(F.regexp_extract("node", r"^([^/?]*)", 1), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1), rules)
    sums = labels.withColumn("verdict", node_hit["verdict"]).groupBy("component").agg(F.max((F.col("verdict") == "allow").cast("int")).alias("allows"), F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    spread = labels.join(sums, "component").select("node", "component", F.when(F.col("allows") == 1, "allow").when(F.col("blocks") == 1, "block").alias("spread"))
    spread = materialise(spread, "url-verdicts")
    # urls without a node have no alias; each gets a key of its own, as equal nulls would meet in one task
    alone = F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))
    out = own.drop("html").withColumn("node", F.coalesce("node", alone)).join(spread, "node", "left")
    by = F.when(F.col("hit").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", "spread", F.lit("allow")).alias("verdict"), "component", by.alias("by"))


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


_HIT = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.pattern}'" for r in sorted(RULES, key=lambda r: -len(r.pattern))
)
_VERDICT = " ".join(f"WHEN '{r.pattern}' THEN '{r.verdict}'" for r in RULES)


def _sql() -> str:
    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}')"
    node = lambda u: f"CASE WHEN contains({u}, '://') THEN regexp_replace({host(u)}, ':(80|443)$', '') || CASE WHEN regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END END"
    dots = lambda p: f"""CASE WHEN contains({p}, '/.') THEN '/' || array_to_string(list_concat(list_reduce(list_transform(string_split({p}, '/')[2:], lambda x: [x]), lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[:len(acc) - 1] ELSE list_concat(acc, x) END, []::VARCHAR[]), CASE WHEN regexp_matches({p}, '/\\.\\.?\\z') THEN [''] ELSE [] END), '/') ELSE {p} END"""
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, {node('url')} AS node, html FROM pages),
tags AS (SELECT url, host, path AS own, node AS a, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\\z)', '', 'g'), '(?is)<(?:link|meta)\\s[^>]*>')) AS tag FROM p),
targets AS (SELECT host, CASE WHEN own = '' THEN '/' ELSE own END AS own, a, coalesce(
    CASE WHEN regexp_matches(regexp_extract(tag, '(?i)\\srel\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), '(?i)(^|[\\s"''])canonical([\\s"'']|\\z)') THEN regexp_extract(tag, '(?i)\\shref\\s*=\\s*["'']?([^"''>\\s]+)', 1) END,
    CASE WHEN regexp_matches(tag, '(?i)http-equiv\\s*=\\s*["'']?refresh\\b') THEN regexp_extract(tag, '(?i)url\\s*=\\s*["'']?([^"''>\\s]+)', 1) END) AS t FROM tags),
cut AS (SELECT *, regexp_extract(bare, '(?s)^([^?]*)', 1) AS way, regexp_extract(bare, '(?s)^[^?]*(.*)\\z', 1) AS query, regexp_extract(own, '(?s)^(.*/)', 1) AS folder FROM (SELECT *, regexp_replace(t, '(?s)#.*\\z', '') AS bare FROM targets)),
links AS (SELECT a, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN 'http:' || t
    WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') OR bare = '' THEN NULL WHEN way = '' THEN 'http://' || host || own || query
    WHEN starts_with(way, '/') THEN 'http://' || host || {dots('way')} || query ELSE 'http://' || host || {dots('(folder || way)')} || query END AS u FROM cut),
edges AS (SELECT DISTINCT a, {node('u')} AS b FROM links),
both_ways AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
ruled AS (SELECT node, CASE (CASE {_HIT.replace('host', "regexp_extract(other, '^([^/?]*)', 1)").replace('(path', "(regexp_extract(other, '^[^/?]*([^?]*)', 1)")} END) {_VERDICT} END AS v FROM reach),
spread AS (SELECT node, CASE WHEN max(CASE WHEN v = 'allow' THEN 1 ELSE 0 END) = 1 THEN 'allow' WHEN max(CASE WHEN v = 'block' THEN 1 ELSE 0 END) = 1 THEN 'block' END AS v FROM ruled GROUP BY node),
hit AS (SELECT page_id, host, path, node, CASE {_HIT} END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {_VERDICT} END, spread.v, 'allow') AS verdict
FROM hit LEFT JOIN spread ON hit.node = spread.node"""


OP3_SQL = _sql()
