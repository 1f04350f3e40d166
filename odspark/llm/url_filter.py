"""URL rules with redirect equivalence.

``judge_urls`` decides every url of a table. A rule ``host/path`` fits its host
and all subdomains when the url's path starts with the rule's path; of the
rules that fit, the longest wins, and of equally long ones an allow rule. A url without a fitting rule is blocked when
some url of its alias component (redirect targets and canonical links, taken
as undirected edges) is blocked by a rule; else it is allowed. An explicit
allow rule always decides its own url first: a block never overrides it, and
it does not lift the block of other members.

Edges are read from the page itself (``<link rel="canonical">``, ``<meta
http-equiv="refresh">``, ``og:url``; every one of them) and may be given as a
table (redirect logs). Targets are resolved against the page's url (``<base>``
is not read), ``&amp;`` is decoded, and urls meet with scheme and host lower-cased. Components are found by min-label hooking with pointer jumping over
written tables, restricted to urls that have an edge; a page without links
costs no shuffle.

Defined results: null url or one without ``://`` has empty host and path, no
rule, and is its own component (verdict ``allow``); null html has no edges;
repeated rows are judged row by row; an empty table gives an empty result;
columns of the input that clash with output columns are dropped unless they
are the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odspark.llm.components import components
from odspark.llm.staging import staged

# The rules of the registered query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

# Up to so many rules are a literal in the plan; more are a table that is joined.
RULES_IN_PLAN = 500

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ORIGIN = r"(?s)^(.*?://[^/?#]*)"
_CANONICAL = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_OG_URL = r"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']?og:url\b)[^>]*\bcontent\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = (r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)"
            r"[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?url\s*=\s*([^\"'\s>]+)")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def host_suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(action, rule) of the longest fitting rule, or nulls; of equally long
    ones an allow rule goes first, then the larger text.

    The rules become one lookup table in the expression, keyed by host, so a url
    costs one lookup per host suffix and no join."""
    by_host: dict[str, list[tuple]] = {}
    for action, rule in rules:
        h, p = split_rule(rule)
        by_host.setdefault(h, []).append((len(rule), action == "allow", rule, p, action))
    kind = "map<string,array<struct<len:int,allow:boolean,rule:string,path:string,action:string>>>"
    if not by_host:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    entry = lambda r: F.struct(*[F.lit(v).alias(n) for v, n in zip(r, ("len", "allow", "rule", "path", "action"))])
    table = F.create_map(*[x for h, rs in sorted(by_host.items())
                           for x in (F.lit(h), F.array(*[entry(r) for r in sorted(rs)]))]).cast(kind)
    found = F.flatten(F.transform(host_suffixes(host), lambda s: F.coalesce(
        F.try_element_at(table, s), F.array().cast(kind[len("map<string,"):-1]))))
    best = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return best["action"], best["rule"]


def with_rule(rows: DataFrame, rules: list[tuple[str, str]], in_plan: int = RULES_IN_PLAN) -> DataFrame:
    """``rows`` (host, path and others) with _m, the action and rule of the longest
    fitting rule (see ``matching_rule``), for any number of rules.

    A long list is a table. Distinct (host, path) pairs meet it by equality: of
    each parent domain that has rules, the beginnings of the path in the lengths
    that its rules have. So a domain with many rules costs a url its number of
    different lengths, not of rules. The best rule of each pair is joined back."""
    if len(rules) <= in_plan:
        action, rule = matching_rule(F.col("host"), F.col("path"), rules)
        return rows.withColumn("_m", F.struct(action.alias("action"), rule.alias("rule")))
    table = [(*split_rule(r), len(r), a == "allow", r, a) for a, r in set(rules)]
    known = staged(rows.sparkSession.createDataFrame(table, "h string, p string, len int, allow boolean, rule string, action string")
                   .groupBy("h", "p").agg(F.max(F.struct("len", "allow", "rule", "action")).alias("best")), "url-rules")
    lengths = staged(known.groupBy(F.col("h").alias("_h")).agg(F.collect_set(F.length("p")).alias("sizes")), "url-rule-lengths")
    pairs = rows.select("host", "path").distinct()
    begun = (pairs.select("host", "path", F.explode(host_suffixes(F.col("host"))).alias("h")).join(lengths, F.col("h") == F.col("_h"))
             .select("host", "path", "h", F.explode(F.filter("sizes", lambda k: k <= F.length("path"))).alias("k"))
             .select("host", "path", "h", F.substr("path", F.lit(1), F.col("k")).alias("p")))
    best = staged(begun.join(known, ["h", "p"]).groupBy(F.col("host").alias("_host"), F.col("path").alias("_path"))
                  .agg(F.max("best").alias("_best")), "url-best-rules")
    return (rows.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
            .withColumn("_m", F.struct(F.col("_best.action").alias("action"), F.col("_best.rule").alias("rule")))
            .drop("_host", "_path", "_best"))


def node_key(url: Column) -> Column:
    """The url with scheme and host lower-cased: pages and targets meet under it."""
    origin = F.regexp_extract(url, _ORIGIN, 1)
    return F.concat(F.translate(origin, _UPPER, _LOWER), F.substring(url, F.length(origin) + 1, F.length(url)))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/`` without its ``.`` and ``..`` segments."""
    parts = F.split(F.regexp_replace(path, r"/(\.\.?)$", "/$1/"), "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda acc, x: (
        F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x)))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolve(target: Column, page: Column) -> Column:
    """The absolute url of a link target on a page; null for the page itself, other schemes or a page without ``://``."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    origin, at = F.regexp_extract(page, _ORIGIN, 1), url_path(page)
    path = F.regexp_extract(t, r"(?s)^([^?#]*)", 1)
    rest = F.substring(t, F.length(path) + 1, F.length(t))
    folder = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(at, r"[^/]*$", ""), r"^/", ""))
    return (F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(t.rlike(r"^[^:/?#]+://"), t))
            .when((F.length(t) == 0) | t.startswith("#") | (origin == ""), F.lit(None))
            .when(t.startswith("//"), F.concat(F.regexp_extract(origin, r"(?s)^(.*?:)//", 1), t))
            .when(t.startswith("/"), F.concat(origin, _without_dots(path), rest))
            .when(t.startswith("?"), F.concat(origin, at, t))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest)))


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of all canonical links, og:urls and refresh redirects, targets resolved."""
    targets = F.concat(*[F.regexp_extract_all(F.col(html), F.lit(p), F.lit(1)) for p in (_CANONICAL, _OG_URL, _REFRESH)])
    has = F.col(html).rlike(r"(?i)rel\s*=\s*[\"']?canonical|og:url|http-equiv\s*=\s*[\"']?refresh")
    return (pages.where(has & F.col(url).isNotNull())
            .select(F.col(url).alias("src"), F.explode(targets).alias("target"))
            .select("src", resolve(F.col("target"), F.col("src")).alias("dst"))
            .where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], edges: DataFrame | None = None,
               key: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: key, url, host, path, rule, verdict, component."""
    parts = ([] if html is None else [page_edges(pages, url, html)]) + (
        [] if edges is None else [edges.select("src", "dst").where("src is not null and dst is not null")])
    rows = pages.select(F.col(key).alias(key), F.col(url).alias("url"))
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    judged = with_rule(rows.withColumn("host", host).withColumn("path", path), rules)
    linked = None
    for p in parts:
        linked = p if linked is None else linked.unionByName(p)
    if linked is not None:
        linked = staged(linked.select(node_key(F.col("src")).alias("a"), node_key(F.col("dst")).alias("b")), "links")
        if linked.isEmpty():
            linked = None
    if linked is None:
        out = judged.withColumn("component", node_key(F.col("url"))).withColumn("_blocked", F.lit(False))
    else:
        comp = components(linked)
        members = with_rule(comp.withColumn("host", url_host(F.col("node"))).withColumn("path", url_path(F.col("node"))), rules)
        flags = members.groupBy("component").agg(F.max(F.col("_m.action").eqNullSafe("block")).alias("_blocked"))
        alias = comp.join(flags, "component")
        out = (judged.join(alias, node_key(F.col("url")) == F.col("node"), "left")
               .withColumn("component", F.coalesce("component", node_key(F.col("url")))))
    verdict = F.coalesce(F.col("_m.action"), F.when(F.col("_blocked"), "block").otherwise("allow"))
    return out.select(key, "url", "host", "path", F.col("_m.rule").alias("rule"),
                      verdict.alias("verdict"), "component")
