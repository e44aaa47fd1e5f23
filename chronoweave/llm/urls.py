"""URL verdicts: host and path rules, carried to aliases along redirects and canonical links. DataFrame functions only."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Saved, components, small

#: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url):
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url):
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and rule_verdict: the longest rule (host and path together; then the longer path, then the
    text) whose host is the page's host or a parent of it and whose path begins the page's path. The rules are a short
    list and become one expression; no join."""
    p = pages.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, q in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(q)
        rule, verdict = F.when(fits, F.lit(h + q)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return p.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _without_dots(p):
    """A path without its segments . and .. (RFC 3986, 5.2.4)."""
    parts = F.split(p, "/")
    empty = F.array().cast("array<string>")
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(empty)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), empty, step)
    end = F.when(p.rlike(r"/\.\.?$") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(p)


def resource(url):
    """A URL without its fragment, scheme and host lower-cased (A-Z), without dot segments: what redirects and canonical
    links lead to. Without :// only the fragment goes."""
    bare = F.regexp_replace(url, r"#(?s:.*)$", "")
    part = lambda k: F.regexp_extract(bare, r"^([^:/?#]+://[^/?#]*)([^?]*)((?s:.*))$", k)
    return F.when(bare.rlike(r"^[^:/?#]+://"), F.concat(F.translate(part(1), _UPPER, _LOWER), _without_dots(part(2)), part(3))).otherwise(bare)


def decoded(text):
    """An attribute's text with its HTML entities, named or by number, as characters."""
    pieces = F.regexp_extract_all(text, F.lit(r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![A-Za-z0-9=]))|[^&]+|&"), F.lit(0))
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def one(x):
        digits = F.regexp_extract(x, r"^&#[xX]?0*([0-9a-fA-F]{1,7});?$", 1)
        code = F.conv(digits, 16, 10).cast("long")
        code = F.when(x.rlike("^&#[xX]"), code).otherwise(F.regexp_extract(x, r"^&#0*([0-9]{1,7});?$", 1).try_cast("long"))
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code)), 8, "0")), "UTF-32")
        named = F.element_at(names, F.substring(x, 2, 64))
        return F.coalesce(F.when(x.startswith("&#"), char).when(x.startswith("&"), named), x)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def resolved(ref, url):
    """A reference against its page's url (RFC 3986, 5.2), not yet named as a resource."""
    base = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    own = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_extract(own, r"^((?s:.*)/)", 1))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(url, r"^([^:/?#]+:)", 1), ref))
        .when((ref == "") | ref.startswith("#"), url)
        .when(base == "", F.lit(None).cast("string"))
        .when(ref.startswith("/"), F.concat(base, ref))
        .when(ref.startswith("?"), F.concat(base, own, ref))
        .otherwise(F.concat(base, folder, ref))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): resources of a page and of the targets of its canonical links and refresh redirects, decoded and
    resolved against the page's url."""
    html = F.col("html").cast("string")
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = pages.where("url is not null").where(F.lower(html).rlike("canonical|refresh")).select("url", F.explode(tags).alias("tag"))
    low = F.col("tag")
    canonical = F.when(low.rlike(r"(?is)^<link\b[^>]*\brel\s*=\s*[\"']?\s*canonical\b"), F.regexp_extract(low, r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0))
    refresh = F.when(low.rlike(r"(?is)^<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), F.regexp_extract(low, r"(?is)\burl\s*=\s*['\"]?([^'\">\s]+)", 1))
    href = F.regexp_replace(F.regexp_replace(canonical, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", "")
    # an explode after each step, or the optimizer would copy every step into all places where the next one uses it
    step = lambda df, name, c, *keep: df.select(*keep, F.explode(F.array(c)).alias(name))
    found = step(found, "raw", F.coalesce(href, refresh), "url").where("raw is not null")
    found = step(found, "ref", F.regexp_replace(decoded(F.col("raw")), r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", ""), "url")
    found = step(found, "to", resolved(F.col("ref"), F.col("url")), "url")
    found = step(step(found, "b", resource(F.col("to")), "url"), "a", resource(F.col("url")), "b")
    return found.select("a", "b").where(r"b rlike '^[^:/?#]+://' and a <> b").distinct()


def judge(pages: DataFrame, rules=RULES, extra_edges: DataFrame | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html, any others): page_id, host, path, rule, verdict, aliased.

    A page that a rule fits takes that rule's verdict, so an explicit allow outlasts a block of its aliases. Any other
    page is blocked if a resource of its connected component (redirects, canonical links and extra_edges (a, b), in
    either direction, any number of steps) is blocked by a rule, be it a page or only a link's target; else allowed.
    aliased says that the verdict came so. Null or odd URLs have empty host and path and no aliases: allowed.
    Repeated rows each give a row; an empty table none. One component may hold most pages: minima and flags are combined
    before they are shuffled, and the flagged resources join as the small side where their counted rows are few."""
    ruled = with_rule(pages, rules)
    edges = alias_edges(pages)
    if extra_edges is not None:
        edges = edges.unionByName(extra_edges.select(resource(F.col("a")).alias("a"), resource(F.col("b")).alias("b"))).where("a is not null and b is not null").distinct()
    linked = Saved(edges, "aliases")
    out = ruled.select("page_id", "url", "host", "path", "rule", "rule_verdict")
    if not linked.df.limit(1).count():
        verdict = F.coalesce("rule_verdict", F.lit("allow"))
        return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.lit(False).alias("aliased"))
    named = linked.df.select(F.explode(F.array("a", "b")).alias("url")).distinct()
    # 128 bits: two resources of one name would join two components
    key = lambda c: F.unhex(F.md5(c))
    comp = components(linked.df.select(key("a").alias("a"), key("b").alias("b")))
    facts = with_rule(named, rules).select(key("url").alias("node"), (F.col("rule_verdict") == "block").alias("hit"))
    blocked = facts.where("hit").join(comp, "node").select("component").distinct()
    members = Saved(comp.join(blocked, "component", "left_semi").select("node"), "blocked")
    n = members.count()
    hit = small(members.df.distinct().withColumn("_hit", F.lit(True)), n, BROADCAST_ROWS)
    joined = out.withColumn("node", key(resource(F.col("url")))).join(hit, "node", "left")
    aliased = F.col("rule").isNull() & F.col("url").isNotNull() & F.coalesce("_hit", F.lit(False))
    verdict = F.when(aliased, F.lit("block")).otherwise(F.coalesce("rule_verdict", F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), aliased.alias("aliased"))
