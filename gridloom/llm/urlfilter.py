"""URL filter: host and path rules, carried to aliases along redirects and canonical links.

Built-in functions only.  Each page's html names its canonical address and a refresh
redirect; those edges join addresses that are one document, and a blocked address
blocks its connected component unless an address of the component is explicitly
allowed.  An address with a rule of its own keeps that verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

Rule = tuple[str, str, str]  #: verdict, host, path

# What html is read for.
UNSEEN = (r"(?s)<!--.*?(?:-->|\z)", r"(?is)<script\b.*?(?:</script\s*>|\z)")
TAG = r"(?is)<{0}\b[^>]*>"
ATTRIBUTE = r"""(?is)[\s"'/]{0}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)^\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?['"]?([^'"]*)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an address; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return F.when(none, "").otherwise(host), F.when(none, "").otherwise(path)


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule, as text, and its verdict; null where none fits.

    ``rules`` is a parameter, held in the plan; of equally long ones allow wins.
    """
    name = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its ``.`` and ``..`` segments resolved."""
    parts = F.split(F.substring(path, 2, F.length(path)), "/", -1)
    up = lambda so_far: F.regexp_replace(so_far, r"(?s)/[^/]*\z", "")
    folded = F.aggregate(parts, F.lit(""), lambda so_far, part: F.when(part == "..", up(so_far)).when(part == ".", so_far).otherwise(F.concat(so_far, F.lit("/"), part)))
    return F.concat(folded, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def absolute(target: Column, url: Column) -> Column:
    """``target`` resolved against ``url``; null for an empty one, a mere fragment, and schemes without a host."""
    target = F.replace(F.regexp_replace(target, r"^\s+|\s+\z", ""), F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(url, r"^([A-Za-z][\w+.-]*):", 1), F.regexp_extract(url, r"(?s)^[A-Za-z][\w+.-]*://[^/?#]*", 0)
    base = F.regexp_extract(F.substring(url, F.length(site) + 1, F.length(url)), r"(?s)^[^?#]*", 0)
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substring(target, F.length(path) + 1, F.length(target))
    folder = F.coalesce(F.nullif(F.regexp_extract(base, r"(?s)^.*/", 0), F.lit("")), F.lit("/"))
    merged = without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path)))
    return (
        F.when(target.rlike(r"^[A-Za-z][\w+.-]*://"), target)
        .when((target == "") | (site == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][\w+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(site, base, target))
        .otherwise(F.concat(site, merged, rest))
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name; null where it has none or an empty one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, ATTRIBUTE.format(name), i), F.lit("")) for i in (1, 2, 3)])


def targets(html: Column) -> Column:
    """Addresses that a page names as its canonical form or as a redirect, as an array; comments and scripts are not read."""
    for pattern in UNSEEN:
        html = F.regexp_replace(html, pattern, "")
    links, metas = (F.regexp_extract_all(html, F.lit(TAG.format(name)), 0) for name in ("link", "meta"))
    named = F.filter(links, lambda t: F.array_contains(F.split(F.lower(attribute(t, "rel")), r"\s+"), "canonical"))
    moved = F.filter(metas, lambda t: F.lower(F.trim(attribute(t, "http-equiv"))) == "refresh")
    return F.concat(F.transform(named, lambda t: attribute(t, "href")), F.transform(moved, lambda t: F.regexp_extract(attribute(t, "content"), REFRESH, 1)))


def node(url: Column) -> Column:
    """An address as a graph node: without fragment, scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    front = F.regexp_extract(bare, r"(?s)^[^:]*://[^/?]*", 0)
    return F.concat(F.lower(front), F.substring(bare, F.length(front) + 1, F.length(bare)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): nodes of pages and of the canonical and redirect targets in their html, all of them."""
    some = F.lower("html").contains("canonical") | F.lower("html").contains("refresh")
    found = pages.where(F.col("url").isNotNull() & F.col("html").isNotNull() & some).select("url", F.explode(targets(F.col("html"))).alias("target"))
    return found.select(node(F.col("url")).alias("a"), node(absolute(F.col("target"), F.col("url"))).alias("b")).where("a is not null and b is not null and a <> b")


def filter_urls(pages: DataFrame, rules: list[Rule], edges: DataFrame | None = None) -> DataFrame:
    """Verdict on every row of ``pages`` (page_id, url, html): host, path, rule and verdict.

    ``edges`` (a, b) are further redirects, as addresses.  Cases: a null url or one
    without ``://`` has empty host and path, no rule and no aliases, and is allowed;
    repeated rows are judged alike; null html has no edges; links are resolved against
    their page's url (a base element is not read), and a refresh without an address is
    none; an empty table gives no rows; further columns are ignored.
    """
    host, path = split_url(F.col("url"))
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("a")).alias("a"), node(F.col("b")).alias("b")))
    parts = connected_components(links, "aliases")
    h, p = split_url(F.col("node"))
    _, known = matching_rule(h, p, rules)
    ruled = parts.withColumn("known", known)
    spread = ruled.groupBy("component").agg(F.max(F.col("known") == "block").alias("blocked"), F.max(F.col("known") == "allow").alias("allowed")).where("blocked and not coalesce(allowed, false)")
    blocked = parts.join(spread, "component").select(F.col("node"), F.lit(True).alias("alias_blocked"))
    judged = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumn("rule", rule).withColumn("own", verdict).withColumn("node", node(F.col("url")))
    return judged.join(blocked, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("alias_blocked"), "block"), F.lit("allow")).alias("verdict"), F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"))
