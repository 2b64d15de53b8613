"""URL block rules, propagated over redirects and canonical links.

A rule (verdict, host, path) fits its host and all subdomains, if the path
starts with the rule's; the longest one that fits wins. URLs that are one page
under several names are joined: a page's canonical link and its refresh redirect
are edges between URLs, and connected components by alternating large-star and
small-star over these edges are the aliases. A block of any alias, found in the
table or only pointed to, reaches all aliases that no rule fits; if a rule
allows one of the aliases, that explicit allow goes before the block. A rule
that fits a page itself always decides it.

Only pages that hold such a tag are parsed, and only URLs with edges enter the
components. Rules may be a table of any size: URLs meet them by host suffix and
path prefix, both equal keys, and a (host, path) is looked up once however many
pages have it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm.common import text_of, written
from postlens.llm.components import connected_components

#: The production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
RULE_SCHEMA = "verdict string, host string, path string"
#: The host and path of a URL: after the first ://, up to / ? # and ? #.
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Tags that may hold a link to an alias.
ALIAS_TAG = r"(?is)<link\b[^>]*\bcanonical\b|<meta\b[^>]*\brefresh\b"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(text_of(url), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(text_of(url), PATH, 1)


def node_of(url: Column) -> Column:
    """A URL as a node: host, path (/ if empty) and query, whatever its scheme and fragment."""
    query = F.regexp_extract(text_of(url), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, query))


class _Aliases(HTMLParser):
    """Collects the targets of canonical links, refresh redirects, and a base URL."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []
        self.base = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        has = {k: v or "" for k, v in reversed(attrs)}  # the first of equal attributes counts
        if tag == "base" and not self.base:
            self.base = has.get("href", "")
        elif tag == "link" and "canonical" in has.get("rel", "").lower().split():
            self.found.append(has.get("href", ""))
        elif tag == "meta" and has.get("http-equiv", "").strip().lower() == "refresh":
            to = re.match(r"(?is)\s*[\d.]*\s*[;,]?\s*url\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|(.*))", has.get("content", ""))
            self.found.append(next((x for x in to.groups() if x), "") if to else "")

    handle_startendtag = handle_starttag


def targets(url: str, html: str) -> list[str]:
    """The absolute URLs that a page names as itself or redirects to."""
    parser = _Aliases()
    parser.feed(html)
    parser.close()
    found = []
    for target in parser.found:
        try:
            to = urljoin(urljoin(url, parser.base.strip()), target.strip()) if target.strip() else ""
        except ValueError:  # no URL, such as an open bracket in the host
            continue
        if "://" in to:
            found.append(to)
    return found


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): nodes that a page's canonical link or redirect joins."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(u, t) for u, h in zip(*(c.to_pylist() for c in batch.columns)) for t in targets(u, h)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["source", "target"])

    tagged = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("url").contains("://") & F.col("html").rlike(ALIAS_TAG))
    return tagged.mapInArrow(parse, "source string, target string").select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v"))


def matched_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the (host, path) that a rule fits; the
    longest rule, of equals the one with the longer host, then allow."""
    lengths = rules.select(F.col("host").alias("suffix"), F.length("path").alias("length")).distinct()
    keyed = rules.groupBy(F.col("host").alias("suffix"), F.col("path").alias("prefix")).agg(F.min("verdict").alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    # host suffixes that have rules, then the prefixes of the lengths that these rules have
    asked = places.distinct().select("host", "path", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    asked = asked.select("host", "path", "suffix", F.substring(F.col("path"), F.lit(1), F.col("length")).alias("prefix"), "length").where(F.length("path") >= F.col("length"))
    fitting = asked.join(keyed, ["suffix", "prefix"])
    size = F.struct((F.length("suffix") + F.col("length")).alias("size"), F.length("suffix").alias("host_size"))
    rule = F.concat("suffix", "prefix")
    return fitting.groupBy("host", "path").agg(F.max_by(F.struct(rule.alias("rule"), F.col("verdict")), size).alias("m")).select("host", "path", "m.rule", "m.verdict")


def url_verdicts(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule (null if none
    fits), verdict (allow or block), n_aliases (URLs of its component, 1 without
    edges) and by_alias (whether aliases decided).

    A null url, or one without ://, has empty host and path, no rule and no
    aliases, and is allowed. Null html has no edges. Repeated rows are judged
    each, alike. Rules with an empty host fit nothing; a rule's null path is
    empty; allow goes before block for equal rules. Further columns are
    ignored; an empty table gives an empty result.
    """
    u = F.col(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"))
    rules = rules.select(F.col("verdict"), F.translate("host", UPPER, LOWER).alias("host"), text_of("path").alias("path")).where("host <> ''")
    edges = written(alias_edges(pages, url, html), "alias_edges")
    aliases = written(connected_components(edges), "aliases")
    # a node has the host and the path of its URL, but / for an empty path
    of_node = F.col("node")
    named = aliases.select("node", "component", F.regexp_extract(of_node, r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract(of_node, r"(?s)^[^/]*([^?]*)", 1).alias("path"))
    matched = written(matched_rules(rows.select("host", "path").union(named.select("host", "path")), rules), "matched_rules")
    says = lambda what: F.coalesce(F.max(F.col("verdict") == what), F.lit(False))
    decided = named.join(matched, ["host", "path"], "left").groupBy("component").agg((says("block") & ~says("allow")).alias("alias_block"), F.count(F.lit(1)).alias("n_aliases"))
    known = written(aliases.join(decided, "component").select("node", "alias_block", "n_aliases"), "alias_verdicts")
    judged = rows.join(matched, ["host", "path"], "left").join(known, "node", "left")
    blocked = F.coalesce("alias_block", F.lit(False))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n_aliases", F.lit(1).cast("long")).alias("n_aliases"),
        (F.col("rule").isNull() & blocked).alias("by_alias"),
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)
