"""URL filters whose decisions reach the aliases of a page.

Redirects and canonical links say that two addresses are one page. Connected components
over those edges form the pages; a block of one address holds for all its aliases, unless an
address of the component is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.components import components
from kindred.llm.stores import stored
from kindred.llm.words import ascii_lower

#: (verdict, host, path): a rule fits its host and all subdomains, and paths that begin with its own.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """Lower-cased (A-Z) host: from the first ``://`` to ``/``, ``?``, ``#`` or the end; else ''."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments (RFC 3986); ``..`` above the top stays there."""
    segments = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    last = F.element_at(segments, -1)
    step = lambda kept, x: (F.when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
                            .when(x == ".", kept).otherwise(F.concat(kept, F.array(x))))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    end = F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.size(kept) > 0, end).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), joined).otherwise(path)


def address(url: Column) -> Column:
    """The part of a url that a server sees, with its host in lower case; null without a host.

    The fragment, the scheme's default port and dot segments go, an empty path is ``/``; the query stays as it is.
    """
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    port = F.when(scheme == "http", F.lit(":80")).when(scheme == "https", F.lit(":443")).otherwise(F.lit("?"))
    host = F.when(F.endswith(host_of(url), port), F.regexp_replace(host_of(url), r":\d+$", "")).otherwise(host_of(url))
    path, query = path_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    path = F.when(path == "", F.lit("/")).otherwise(without_dots(path))
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, path, query))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else nulls. The list of rules is small.

    Of rules with one host and path, the allowing one counts.
    """
    best = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1:])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*["']([^"']*)["']""", 1)
    bare = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*([^\s>\"']+)", 1)
    return F.replace(F.when(quoted != "", quoted).otherwise(bare), F.lit("&amp;"), F.lit("&"))


def _absolute(target: Column, base: Column) -> Column:
    """A link's target as an absolute url: full, ``//host/..``, ``/path`` or relative to the page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#/]*)*?/)[^/?#]*(?:[?#].*)?$", 1)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(site, target))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(folder != "", F.concat(folder, target)).otherwise(F.concat(site, F.lit("/"), target)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses that a page declares to be itself: canonical links, refresh redirects.

    ``pages`` (url, html, and optionally ``redirect`` with the target of an HTTP redirect).
    Self links, null urls and unreadable targets give no edge.
    """
    html, base = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    tags = F.when(html.rlike("(?i)canonical|refresh"),
                  F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    lower = lambda tag: F.lower(tag)
    canonical = F.transform(F.filter(tags, lambda x: lower(x).rlike(r"^<link") & F.lower(_attribute(x, "rel")).rlike(r"(^|\s)canonical($|\s)")),
                            lambda x: _attribute(x, "href"))
    refresh = F.transform(F.filter(tags, lambda x: lower(x).rlike(r"^<meta") & (F.lower(_attribute(x, "http-equiv")) == "refresh")),
                          lambda x: F.regexp_extract(x, r"""(?is)url\s*=\s*["']?([^"'>;]+)""", 1))
    none = F.array().cast("array<string>")
    targets = F.concat(F.coalesce(canonical, none), F.coalesce(refresh, none))
    if "redirect" in pages.columns:
        targets = F.concat(targets, F.when(F.col("redirect").isNotNull(), F.array(F.col("redirect").cast("string"))).otherwise(none))
    found = pages.select(base.alias("url"), F.explode(targets).alias("target")).where("url IS NOT NULL AND trim(target) <> ''")
    return (found.select(address(base).alias("src"), address(_absolute(F.trim("target"), base)).alias("dst"))
            .where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct())


def judge(pages: DataFrame, rules=RULES, default: str = "allow") -> DataFrame:
    """``pages`` (page_id, url, html) -> page_id, host, path, rule, verdict, component (of its address).

    An own rule decides. Without one, an explicit allow anywhere in the page's component
    does, then a block, then ``default``. Link targets that are no page themselves count
    as members. A null url or one without host has no aliases. Repeated rows are judged
    alike; an empty table gives an empty one; further columns are ignored.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    edges = stored(link_edges(pages), "links")
    member = components(edges)  # (node, component): only addresses that have an alias
    verdicts = member.withColumn("v", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    decided = verdicts.groupBy("component").agg(
        F.when(F.max(F.col("v") == "allow"), F.lit("allow")).when(F.max(F.col("v") == "block"), F.lit("block")).alias("inherited"))
    aliases = member.join(decided, "component")
    judged = own.withColumn("node", address(F.col("url"))).join(aliases, "node", "left")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                         F.coalesce(F.col("own.verdict"), "inherited", F.lit(default)).alias("verdict"),
                         F.coalesce("component", "node").alias("component"))
