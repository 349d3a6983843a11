"""Allow and block rules for URLs, held as one trie over reversed host labels and path segments."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import c, check_broadcast, fresh, table

ALLOW, BLOCK = "allow", "block"
PATTERN = r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)"
_SPLIT = re.compile(PATTERN)

_BAD = ("spam-farm", "cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x")
#: (action, host or host/path); production rules of the query over ``pages``.
RULES = [
    *((BLOCK, f"{name}.example.{tld}") for name in _BAD for tld in ("com", "org", "net")),
    (ALLOW, "www.cheap-pills.example.com/en"),
    (BLOCK, "www.cheap-pills.example.com/en/680"),
    (ALLOW, "m.casino-win.example.com"),
    (BLOCK, "m.casino-win.example.com/de"),
    (BLOCK, "blog.tionsh.example.com/es"),
    (ALLOW, "blog.tionsh.example.com/es/533"),
    (ALLOW, "example.org"),
    (BLOCK, "tionble.example.org/fr"),
]


def split_url(url: str | None) -> tuple[list[str], list[str]] | None:
    """Reversed host labels and path segments; None where there is no host."""
    found = _SPLIT.match(url) if url else None
    host = found[1].lower().rstrip(".") if found else ""
    if not host:
        return None
    labels = [host] if host[0] == "[" else host.split(".")[::-1]
    return labels, [s for s in found[2].split("/") if s]


def build_trie(rules) -> dict:
    """Nested dicts. Labels and segments are keys; "/" leads from a whole host to its paths, "" holds the rule.

    Where a pattern is both allowed and blocked, it is blocked.
    """
    root: dict = {}
    for action, pattern in rules:
        if action not in (ALLOW, BLOCK):
            raise ValueError(f"unknown action {action!r}")
        host, _, path = pattern.partition("/")
        segments = [s for s in path.split("/") if s]
        node = root
        for key in host.lower().rstrip(".").split(".")[::-1] + ["/"] * bool(segments) + segments:
            node = node.setdefault(key, {})
        if node.get("", ("",))[0] != BLOCK:
            node[""] = (action, pattern)
    return root


def match(trie: dict, url: str | None) -> tuple[str, str, int] | None:
    """(action, pattern, depth) of the longest match, or None."""
    parts = split_url(url)
    if parts is None:
        return None
    node, best, depth = trie, None, 0
    labels, segments = parts
    for label in labels:
        node = node.get(label) if label else None
        if node is None:
            return best
        depth += 1
        if "" in node:
            best = (*node[""], depth)
    node = node.get("/")
    for segment in segments:
        if node is None or (node := node.get(segment)) is None:
            return best
        depth += 1
        if "" in node:
            best = (*node[""], depth)
    return best


def url_verdicts(df: DataFrame, rules, url: str = "url", default: str = ALLOW, most_rules: int = 5_000_000) -> DataFrame:
    """Adds verdict, rule and depth to every row; one narrow stage that reads only what is selected after it.

    A rule for a host holds for it and its subdomains, a rule with a path for that very host and what lies
    under the path. The rule with most labels and segments matched wins; of an allow and a block rule with the
    same pattern, the block rule. Scheme, user, port, query, fragment and letter case of the host don't matter.
    A null, empty or hostless URL, or one without a match, gets the default verdict, a null rule and depth 0.
    Added columns whose names the table has already get a number (verdict_1). Rows are neither dropped nor merged.
    """
    rules = list(rules)
    check_broadcast(len(rules), most_rules, "URL rules")
    shared = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.arrow_udf("struct<verdict string, rule string, depth int>")
    def judge(urls: pa.Array) -> pa.Array:
        trie = shared.value
        found = [match(trie, u) or (default, None, 0) for u in urls.to_pylist()]
        columns = list(zip(*found)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32())
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["verdict", "rule", "depth"])

    at, *names = fresh(df.columns, "__verdict", "verdict", "rule", "depth")
    out = df.withColumn(at, judge(c(url)))
    for name, part in zip(names, ("verdict", "rule", "depth")):
        out = out.withColumn(name, c(at)[part])
    return out.drop(at)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def _sql() -> str:
    rows = ", ".join(f"('{a}', '{p}', '{p.partition('/')[0]}', '{p.partition('/')[2]}')" for a, p in RULES)
    return f"""
WITH rules(action, pattern, host, path) AS (VALUES {rows}),
parts AS (
  SELECT page_id, url, rtrim(lower(regexp_extract(url, '{PATTERN}', 1)), '.') AS h,
         regexp_replace(regexp_extract(url, '{PATTERN}', 2), '/+', '/', 'g') AS p
  FROM pages),
hits AS (
  SELECT t.page_id, t.url, r.action, r.pattern,
         CAST(len(string_split(r.host, '.')) + CASE WHEN r.path = '' THEN 0 ELSE len(string_split(r.path, '/')) END AS INTEGER) AS depth
  FROM parts t JOIN rules r ON CASE WHEN r.path = '' THEN t.h = r.host OR ends_with(t.h, '.' || r.host)
       ELSE t.h = r.host AND starts_with(t.p || '/', '/' || r.path || '/') END),
best AS (
  SELECT DISTINCT page_id, url, action, pattern, depth FROM hits
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY depth DESC, action DESC) = 1)
SELECT t.page_id, t.url, coalesce(b.action, 'allow') AS verdict, b.pattern AS rule, coalesce(b.depth, 0)::INTEGER AS depth
FROM pages t LEFT JOIN best b ON t.page_id = b.page_id AND t.url = b.url"""


SQL = _sql()
