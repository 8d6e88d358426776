"""URL filters with redirect equivalence.

A rule (verdict, host and path) fits its host and all subdomains where the url's path starts with the rule's; the longest
rule wins, allow before block at equal length. Urls that redirects (meta refresh) or canonical links connect are aliases:
connected components over those edges carry a block to all aliases that no rule decides; a url that a rule allows stays
allowed, whatever its aliases are. Urls in no blocked component are allowed.

Every `link` whose rel words hold canonical and every `meta` refresh of a page makes an edge, outside comments, scripts
and styles. The JVM finds pages that mention either; these are read in Arrow batches, once from front to end (a comment,
script or tag that never closes ends the page, as HTML says), entities decoded, and the target resolved as RFC 3986 says against the page's url or its `base`: scheme, `//host`, `/path`, relative paths with dot segments, `?query`
alone. Targets without a host (mailto, data, javascript) make none. A url's node is its host, its path without dot segments
and its query, so scheme and fragment make no difference. Ports and percent-encoded bytes count as they are written.

Up to FEW rules are one expression evaluated row by row, with no join; longer lists are a table that urls join by host
suffix and path prefix of each length that a rule has (at most labels times lengths rows a url). The results are the same.

Nulls and edge cases: a null url, or one without ://, has empty host and path, fits no rule and has no aliases; a null
html has no edges; page_ids may repeat, and so may urls; of two rules of equal length allow wins, then the greater by code
point; extra columns stay out of the way; an empty table gives an empty result."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, lookup, only, settle, stage

#: The rules of the query: host/path, block or allow.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
FEW = 256

# Patterns of tags and what hides them (Java), of attributes and refresh contents (Python), of urls (both and RE2).
OPENS = re.compile(r"(?i)<(?:!--|(script|style|link|meta|base)\b)")
ENDS = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>")}
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
CONTENT = re.compile(r"""(?is)^\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*)$)""")
REFERENCE = re.compile(r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")
AFTER = r"(?s)^.*?://([^/?#]*)([^?#]*)"
QUERY = r"(?s)^.*?://[^?#]*(\?[^#]*)"


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, AFTER, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AFTER, 2), F.lit(""))


def _undotted(path: Column) -> Column:
    """Without `.` and `..` segments; what ends in one ends in a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))),
    )
    # a last dot segment leaves its folder
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), "/"))


def node_of(url: Column) -> Column:
    """Null where there is no host."""
    host, path = host_of(url), path_of(url)
    path = F.when(path == "", F.lit("/")).when(path.contains("/."), _undotted(path)).otherwise(path)
    return F.when(host != "", F.concat(host, path, F.regexp_extract(url, QUERY, 1)))


def _split(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def _by_expression(urls: DataFrame, rules) -> DataFrame:
    out = F.lit(None).cast("struct<rule:string,said:string>")
    # the longest is asked first, so it stands outermost
    for rule, said in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", r[0])):
        host, path = _split(rule)
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(said).alias("said"))).otherwise(out)
    return urls.withColumn("r", out).withColumns({"rule": F.col("r.rule"), "said": F.col("r.said")}).drop("r")


def _by_join(urls: DataFrame, rules) -> DataFrame:
    spark = urls.sparkSession
    table = spark.createDataFrame([(r, s, *_split(r)) for r, s in rules], "rule string, said string, r_host string, r_path string").distinct()
    lengths = F.array(*(F.lit(n) for n in sorted({len(_split(r)[1]) for r, _ in rules})))
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    prefix = F.array_distinct(F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    keys = pairs.select("host", "path", F.explode(suffix).alias("r_host"), prefix.alias("p")).select("host", "path", "r_host", F.explode("p").alias("r_path"))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("said") == "allow").alias("a"), "rule", "said"))
    told = keys.join(table, ["r_host", "r_path"]).groupBy("host", "path").agg(best.alias("b")).select("host", "path", F.col("b.rule").alias("rule"), F.col("b.said").alias("said"))
    return urls.join(told, ["host", "path"], "left")


def with_rule(urls: DataFrame, rules=RULES, few: int = FEW) -> DataFrame:
    """urls (host, path) with rule and said (allow, block or null)."""
    return (_by_expression if len(rules) <= few else _by_join)(urls, rules)


def undotted(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for x in parts:
        if x == "..":
            del out[-1:]
        elif x != ".":
            out.append(x)
    return "/" + "/".join([*out, *[""] * (parts[-1] in (".", ".."))])


def resolve(base: str, reference: str) -> str | None:
    """The reference's url (with any scheme that has a host, without its fragment), None where it has no host."""
    scheme, host, path, query = REFERENCE.match(re.sub(r"[\t\n\r]", "", reference.strip())).groups()
    if scheme is None or (host is None and scheme.lower() in ("http", "https")):  # https:path is read as a path alone
        from_scheme, from_host, from_path, from_query = REFERENCE.match(base).groups()
        if host is None:
            host = from_host
            if not path:
                path, query = from_path, from_query if query is None else query
            elif not path.startswith("/"):
                path = (from_path or "/").rpartition("/")[0] + "/" + path
        scheme = scheme or from_scheme
    if not host:
        return None
    path = undotted(path) if "/." in path else path
    return f"{scheme}://{host}{path or '/'}" + ("" if query is None else "?" + query)


def tags_of(html: str) -> list[str]:
    """link, meta and base tags outside comments, scripts and styles. Each place is passed once."""
    found, at = [], 0
    while m := OPENS.search(html, at):
        name = (m[1] or "").lower()
        if not name or name in ENDS:
            end = html.find("-->", m.end()) + 3 if not name else (e.end() if (e := ENDS[name].search(html, m.end())) else 2)
            if end == 2:
                return found
            at = end
            continue
        at = m.end()
        while (stop := STOP.search(html, at)) and stop[0] != ">":
            at = html.find(stop[0], stop.end()) + 1
            if not at:
                return found
        if not stop:
            return found
        at = stop.end()
        found.append(html[m.start() : at])
    return found


def targets(url: str, tags: list[str]) -> list[str]:
    """Where a page's canonical links and refreshes lead, from its tags."""
    base, found = url, []
    for tag in tags:
        name, _, rest = tag[1:].partition(tag[5:6])
        values: dict[str, str] = {}
        for key, *value in ATTRIBUTE.findall(rest[:-1]):
            values.setdefault(key.lower(), entities.unescape("".join(value)))
        if name.lower() == "base" and values.get("href"):
            base = resolve(url, values["href"]) or base if base == url else base
        elif name.lower() == "link" and "canonical" in values.get("rel", "").lower().split():
            found.append(values.get("href", ""))
        elif name.lower() == "meta" and values.get("http-equiv", "").strip().lower() == "refresh" and (m := CONTENT.match(values.get("content", "").strip())):
            found.append(next((x for x in m.groups() if x), ""))
    return [to for x in found if x.strip() and (to := resolve(base, x))]


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple[str, str]] = []
        for url, html in zip(batch.column(0), batch.column(1), strict=True):  # one page at a time as a Python string
            out += [(url.as_py(), to) for to in targets(url.as_py(), tags_of(html.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["url", "target"])


def edges(pages: DataFrame) -> DataFrame:
    """a, b: one row for each redirect or canonical link of a page (url, html) to another url, as nodes."""
    marked = only(pages, url="string", html="string").where(F.col("html").rlike("(?i)canonical|refresh") & F.col("url").contains("://"))
    led = marked.mapInArrow(_targets, "url string, target string")
    out = led.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    return out.where("a is not null and b is not null and a <> b")


def judge(pages: DataFrame, rules=RULES, few: int = FEW) -> DataFrame:
    """pages (page_id, url, html) -> page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), "html")
    linked = edges(pages).distinct()
    groups = components(linked)
    nodes = groups.withColumn("url", F.concat(F.lit("x://"), "v"))
    told = with_rule(nodes.select("v", "component", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules, few)
    bad = told.groupBy("component").agg(F.max(F.coalesce(F.col("said") == "block", F.lit(False))).alias("bad"), F.count("*").alias("vertices"))
    blocked = stage(lookup(groups, bad, ["component"], "vertices").where("bad").select(F.col("v").alias("node")))
    own = with_rule(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node")), rules, few)
    # a url may be that of very many pages; those without a host have no alias
    urls = own.where("node is not null").groupBy("node").agg(F.count("*").alias("n")).join(blocked.withColumn("alias", F.lit(True)), "node", "left")
    own = lookup(own.where("node is not null"), urls, ["node"], "n").drop("n").unionByName(own.where("node is null").withColumn("alias", F.lit(None).cast("boolean")))
    verdict = F.coalesce("said", F.when(F.col("alias"), F.lit("block")).otherwise(F.lit("allow")))
    return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return settle(lambda: judge(pages))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _host(x: str) -> str:
    return f"coalesce(translate(regexp_extract({x}, {_q(AFTER)}, 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"


def _path(x: str) -> str:
    return f"coalesce(regexp_extract({x}, {_q(AFTER)}, 2), '')"


def _rule(which: int) -> str:
    out = "CASE"
    for rule, said in sorted(RULES, key=lambda r: (-len(r[0]), r[1] != "allow")):
        host, path = _split(rule)
        out += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{(rule, said)[which]}'"
    return out + " END"


#: For pages that hold no link but absolute ones (those of the test tables hold none): regular expressions find tags,
#: and a recursion carries the block. tests/llm holds every kind of link against a resolver and a union-find of its own.
ORACLE = f"""
WITH RECURSIVE p AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, html,
  CASE WHEN {_host("url")} <> '' THEN {_host("url")} || CASE WHEN {_path("url")} = '' THEN '/' ELSE {_path("url")} END || regexp_extract(url, {_q(QUERY)}, 1) END AS node FROM pages),
t AS (SELECT node AS a, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\s[^>]*(?:rel\\s*=\\s*["'']?canonical|http-equiv\\s*=\\s*["'']?refresh)[^>]*>')) AS tag FROM p WHERE node IS NOT NULL),
l AS (SELECT a, regexp_extract(tag, '(?i)(?:href\\s*=|url\\s*=)\\s*["'']?([a-z]+://[^"''\\s>]+)', 1) AS url FROM t),
e AS (SELECT a, {_host("url")} || CASE WHEN {_path("url")} = '' THEN '/' ELSE {_path("url")} END || regexp_extract(url, {_q(QUERY)}, 1) AS b FROM l WHERE url <> ''),
u AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
n AS (SELECT DISTINCT a AS node, {_host("'x://' || a")} AS host, {_path("'x://' || a")} AS path FROM u),
r AS (SELECT node FROM n WHERE {_rule(1)} = 'block' UNION SELECT u.b FROM r JOIN u ON u.a = r.node)
SELECT page_id, host, path, {_rule(0)} AS rule, coalesce({_rule(1)}, CASE WHEN node IN (SELECT node FROM r) THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""
