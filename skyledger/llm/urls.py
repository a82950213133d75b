"""URL filters: longest-match rules, and trust and distrust that spread over the host graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a rule is a host and a path prefix, written together.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Labels of a name that may be a site of its own, and parts of host names (between dots and hyphens) that make a host a blocked seed.
SITE_LABELS = 3
BLOCKED_PARTS = "adult ads bet bets casino pills porn poker spam track tracker viagra xxx".split()


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule ``struct(verdict, rule)`` that fits, else null. A rule fits its host and all
    subdomains if the path starts with its path. The rules are a fixed, small list."""
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight``: links from one host to another, counted, and merged before they are shuffled.
    Relative links stay on their host and are no edges."""
    link = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'>\s]+)"""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), 1)).alias("dst"))
    found = found.withColumn("dst", F.translate("dst", UPPER, LOWER))
    return found.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """``src, dst, weight`` between each host and the one it is a subdomain of, both ways: parts of one site.

    A site has at least ``SITE_LABELS`` labels in its name; shorter ones hold the sites of many. The parent need not have pages: then it
    links its subdomains with each other.
    """
    labels = F.split("host", "[.]")
    up = hosts.where(F.size(labels) > SITE_LABELS).select(F.col("host").alias("src"), F.array_join(F.slice(labels, 2, F.size(labels) - 1), ".").alias("dst"))
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("weight", F.lit(1).cast("long"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = 12, damping: float = 0.85, pull: bool = False) -> DataFrame:
    """Personalised PageRank of two kinds at once.

    seeds: ``kind, host, seed``; kind ``trust`` walks along the links, ``distrust`` against them, so a
    host that links to blocked ones is suspected. Returns ``kind, host, rank`` of the hosts reached.
    With ``pull`` the shares are those of the host that receives, so that a rank is the seeds' part of the walk that starts
    at the host: 1 at most, and not thinned by how many others link to a seed.
    Every round is an equi-join on (kind, host) and a grouping; each third round is written out.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    )
    side = "dst" if pull else "src"
    degree = both.groupBy("kind", side).agg(F.sum("weight").alias("degree"))
    flows = durable(both.join(degree, ["kind", side]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("degree")).alias("share")))
    rank = start = durable(seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")))
    if flows.isEmpty():  # without links between hosts the seeds alone have rank
        return start
    for k in range(rounds):
        moved = flows.join(rank, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        rank = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if k % 3 == 2:
            rank = durable(rank)
    return rank


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str]], blocked_parts: list[str], least: float = 0.02) -> DataFrame:
    """``host, blocked`` of every host among the pages. Edges are links between hosts, and those of a host with its subdomains.

    Trusted seeds are hosts with a page that an allow rule fits, blocked seeds hosts whose name has
    a blocked part or all of whose pages a rule blocks (a rule may be about some paths of a host alone). A host is blocked if its distrust exceeds both ``least`` and its trust.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    allowed = F.max(F.coalesce(matching_rule(host, path, rules)["verdict"] == "allow", F.lit(False)))
    ruled_out = F.min(F.coalesce(matching_rule(host, path, rules)["verdict"] == "block", F.lit(False)))
    hosts = durable(pages.where(host != "").groupBy(host.alias("host")).agg(allowed.alias("trusted"), ruled_out.alias("ruled_out")))
    bad = F.col("ruled_out") | F.arrays_overlap(F.split("host", "[.-]"), F.array(*map(F.lit, blocked_parts)))
    seeds = hosts.where(F.col("trusted") & ~bad).select(F.lit("trust").alias("kind"), "host", F.lit(1.0).alias("seed")).unionByName(
        hosts.where(bad).select(F.lit("distrust").alias("kind"), "host", F.lit(1.0).alias("seed"))
    )
    edges = host_edges(pages).unionByName(site_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    rank = propagate(seeds, edges, pull=True).groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))), F.lit(0.0)).alias("distrust"),
    )
    return rank.where((F.col("distrust") > least) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("blocked"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked_parts: list[str] = BLOCKED_PARTS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row.

    A rule decides where one fits; elsewhere the host's standing in the link graph does, and a host
    without standing is allowed. A url that is null or has no ``://`` has an empty host and path and is
    allowed. A null html has no links. Repeated rows are judged each.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), matching_rule(host, path, rules).alias("found"))
    blocked = host_verdicts(pages, rules, blocked_parts)
    return judged.join(blocked, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), F.lit("block")), F.lit("allow")).alias("verdict"),
    )
