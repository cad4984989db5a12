"""URL filtering with redirect equivalence.

Rules (host and path prefix) decide what they fit.  Redirect and canonical-link edges join
URLs into classes by distributed connected components; a URL that no rule fits takes the
verdict of its class, where one allowed member outweighs blocked ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the production rule set.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """A URL as a node: host, path and query, without scheme and fragment; null without ``://``."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), rest))


def _without_dots(path: Column) -> Column:
    """A path that starts with ``/`` with its ``.`` and ``..`` segments taken out."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    start = F.array().cast("array<string>")
    kept = F.aggregate(parts, start, lambda out, x: F.when(x == ".", out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    closing = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), closing)


def resolved(target: Column, url: Column) -> Column:
    """A link's target as an absolute URL: ``&amp;`` unescaped, relative and scheme-relative targets taken against the page's url.

    Null for an empty target, one of a scheme without ``://`` (mailto:), and a relative one on a page whose url has no ``://``.
    """
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(url, r"^((?s:.*?)://)", 1)
    site = F.regexp_extract(url, r"^((?s:.*?)://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"^((?s:.*)/)", 1)
    name = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.regexp_extract(target, r"^[^?#]*((?s:.*))", 1)
    full = F.when(name == "", F.concat(path_of(url), rest)).when(name.startswith("/"), F.concat(_without_dots(name), rest))
    full = full.otherwise(F.concat(_without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), name)), rest))
    relative = F.when(target.startswith("//"), F.concat(scheme, F.substring(target, 3, 1 << 30))).otherwise(F.concat(site, full))
    own = target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(own & target.contains("://"), target).when(~own & (target != "") & url.contains("://"), relative)


def _attribute(name: str) -> str:
    """A pattern whose first group is the value of an attribute, in its quotes where it has any."""
    return rf"""(?i)[ \t\r\n\f"'/]{name}[ \t\r\n\f]*=[ \t\r\n\f]*("[^"]*"|'[^']*'|[^ \t\r\n\f"'>]+)"""


#: A tag that may state an edge, and the target in a refresh's content.
TAG = r"(?i)<(?:link|meta)[ \t\r\n\f/][^>]*>"
TARGET = r"""(?i)(?:^|[;, \t\r\n\f])url[ \t\r\n\f]*=[ \t\r\n\f]*["']?([^"' \t\r\n\f]+)"""


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (src, dst) that pages state: all canonical links and meta refreshes in their html, relative ones taken against the page's url.

    ``rel`` is a list of words in any case, of which one is canonical.
    """
    lower = F.lower(F.col("html").cast("string"))
    stated = pages.where(lower.contains("canonical") | lower.contains("refresh")).select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    tags = stated.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAG), F.lit(0))).alias("tag"))
    of = lambda name: F.trim(F.regexp_extract("tag", _attribute(name), 1), F.lit("\"'"))
    link = F.lower(F.substring("tag", 1, 5)) == "<link"
    canonical = F.array_contains(F.split(F.lower(of("rel")), r"[ \t\r\n\f]+"), "canonical")
    refresh = F.lower(F.trim(of("http-equiv"))) == "refresh"
    to = F.when(link & canonical, F.trim(of("href"))).when(~link & refresh, F.regexp_extract(of("content"), TARGET, 1))
    found = tags.select("url", to.alias("to")).where("to is not null")
    edges = found.select(node_of(F.col("url")).alias("src"), node_of(resolved(F.col("to"), F.col("url"))).alias("dst"))
    return edges.where("src is not null and dst is not null and src <> dst").distinct()


def rule_matches(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict for the rows of ``places`` (host, path) that a rule fits.

    ``rules`` has verdict, host and path.  A rule fits its host and all subdomains where the
    path starts with the rule's; the longest rule (host and path as text) wins, then the first
    in text order.  A host's parent domains with at most as many labels as a rule's host has,
    and of a path the prefixes of the lengths that occur among the rules of such a domain, are
    joined by equality, so that the rule set may be of any size.
    """
    rules = rules.where("host is not null and path is not null").select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.length("path").alias("n"))
    labels = rules.agg(F.max(F.size(F.split("r_host", r"\."))).alias("n")).first()["n"] or 1
    parts = F.split("host", r"\.")
    ends = F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda k: k <= F.size(parts))
    parents = F.transform(ends, lambda k: F.array_join(F.slice(parts, -k, k), "."))
    wide = places.select("host", "path").distinct().select("host", "path", F.explode(parents).alias("r_host"))
    lengths = rules.groupBy("r_host").agg(F.array_sort(F.collect_set("n")).alias("lengths"))
    wide = wide.join(lengths, "r_host").select("host", "path", "r_host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    fits = wide.withColumn("r_path", F.col("path").substr(F.lit(1), F.col("n"))).join(rules.drop("n"), ["r_host", "r_path"])
    order = F.struct((-F.length("rule")).alias("k"), "rule", "verdict")
    return fits.groupBy("host", "path").agg(F.min(order).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, via.

    ``edges`` (src, dst as URLs' nodes) are further known redirects.  ``via`` is ``rule``,
    ``alias`` (from the class) or ``default``, which allows.  A null url, and one without
    ``://``, has empty host and path and fits no rule.  Repeated rows are judged each for
    itself; an empty table gives no row; columns other than the three are ignored.
    """
    url = F.col("url").cast("string")
    known = page_edges(pages)
    if edges is not None:
        known = known.unionByName(edges.select("src", "dst"))
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    classes = components(known)
    places = rows.select("host", "path")
    if not classes.isEmpty():
        members = classes.select("class", "node", F.regexp_extract("node", r"^[^/?#]*", 0).alias("host"), F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        places = places.unionByName(members.select("host", "path"))
        ruled = rule_matches(places, rules)
        voted = members.join(ruled, ["host", "path"]).groupBy("class").agg(F.max(F.when(F.col("verdict") == "allow", 2).otherwise(1)).alias("vote"))
        votes = members.join(voted, "class").select("node", F.when(F.col("vote") == 2, "allow").otherwise("block").alias("alias"))
    else:
        ruled, votes = rule_matches(places, rules), None
    judged = rows.join(ruled, ["host", "path"], "left")
    judged = judged.join(votes, "node", "left") if votes is not None else judged.withColumn("alias", F.lit(None).cast("string"))
    via = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"), via.alias("via"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_attribute(name: str) -> str:
    """An attribute of ``tag`` in DuckDB."""
    return f"trim(regexp_extract(tag, {_sql_text(_attribute(name))}, 1), {_sql_text(chr(34) + chr(39))})"


def _sql_without_dots(path: str) -> str:
    """A path without its dot segments: a fold over its parts."""
    parts = f"string_split(substr({path}, 2), '/')"
    kept = f"list_reduce(list_prepend(CAST([] AS varchar[]), list_transform({parts}, lambda x: [x])), lambda o, x: CASE WHEN x[1] = '.' THEN o WHEN x[1] = '..' THEN o[1:len(o) - 1] ELSE list_concat(o, x) END)"
    return f"('/' || array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END)"


def _judge_sql() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"coalesce(regexp_extract({u}, '^(?s:.*?)://([^/?#]*)', 1), '')")
    node = "CASE WHEN contains({u}, '://') THEN " + host + r" || regexp_extract({u}, '^(?s:.*?)://[^/?#]*([^#]*)', 1) END"
    refresh = f"regexp_extract({_sql_attribute('content')}, {_sql_text(TARGET)}, 1)"
    at_node = r"regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path"
    return rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
page AS (SELECT row_number() OVER () AS r, page_id, {host.format(u="url")} AS host, coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, {node.format(u="url")} AS node, url, html FROM pages),
tag AS (SELECT node AS src, path, url, unnest(regexp_extract_all(html, {_sql_text(TAG)})) AS tag FROM page WHERE html IS NOT NULL),
attr AS (SELECT src, path, url, CASE WHEN lower(substr(tag, 1, 5)) = '<link' AND list_contains(regexp_split_to_array(lower({_sql_attribute("rel")}), '[ \t\r\n\f]+'), 'canonical') THEN trim({_sql_attribute("href")})
  WHEN lower(substr(tag, 1, 5)) <> '<link' AND lower(trim({_sql_attribute("http-equiv")})) = 'refresh' THEN {refresh} END AS raw FROM tag),
stated AS (SELECT *, replace(raw, '&amp;', '&') AS t FROM attr WHERE raw IS NOT NULL),
cut AS (SELECT *, regexp_extract(t, '^([^?#]*)', 1) AS name, regexp_extract(t, '^[^?#]*((?s:.*))', 1) AS rest, regexp_extract(path, '^((?s:.*)/)', 1) AS folder FROM stated),
goal AS (SELECT src, CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(t, '://') THEN t END
  WHEN t <> '' AND contains(url, '://') THEN CASE WHEN starts_with(t, '//') THEN regexp_extract(url, '^((?s:.*?)://)', 1) || substr(t, 3)
    ELSE regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || CASE WHEN name = '' THEN path || rest WHEN starts_with(name, '/') THEN {_sql_without_dots("name")} || rest
      ELSE {_sql_without_dots("(CASE WHEN folder = '' THEN '/' ELSE folder END || name)")} || rest END END END AS target FROM cut),
edge AS (SELECT DISTINCT src, dst FROM (SELECT src, {node.format(u="target")} AS dst FROM goal) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
both_ways AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge),
reach AS (SELECT src AS node, src AS mate FROM both_ways UNION SELECT src, dst FROM both_ways UNION SELECT reach.node, b.dst FROM reach JOIN both_ways b ON b.src = reach.mate),
place AS (SELECT host, path FROM page UNION SELECT {at_node} FROM (SELECT DISTINCT node FROM reach)),
fit AS (SELECT p.host, p.path, rules.host || rules.path AS rule, verdict, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(rules.host || rules.path) DESC, rules.host || rules.path) AS k
  FROM place p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path)),
best AS (SELECT host, path, rule, verdict FROM fit WHERE k = 1),
mate AS (SELECT node, {at_node.replace("node", "mate")} FROM reach),
vote AS (SELECT m.node, CASE WHEN bool_or(b.verdict = 'allow') THEN 'allow' ELSE 'block' END AS alias FROM mate m JOIN best b ON b.host = m.host AND b.path = m.path GROUP BY m.node)
SELECT page_id, p.host, p.path, b.rule, coalesce(b.verdict, v.alias, 'allow') AS verdict, CASE WHEN b.rule IS NOT NULL THEN 'rule' WHEN v.alias IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM page p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN vote v ON v.node = p.node
"""


#: DuckDB SQL for ``judge_urls`` with the production rules over pages.
JUDGE_SQL = _judge_sql()
