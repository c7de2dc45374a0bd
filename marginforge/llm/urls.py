"""URL filters: fixed rules, and link-graph propagation for what no rule decides.

Hosts are nodes; links in the pages' html and the pages themselves give edges and
seeds. Personalised PageRank starts from hosts with allowed pages and follows the
edges (trust); a second one starts from hosts with blocked pages and follows them
backwards (distrust: who links to the blocked is suspect). Each walk's seeds have
mass 1 in all. A host is blocked if its distrust exceeds its trust by more than
``threshold`` times the mean mass of a host. Both walks run in the same rounds, over
one table of edges, until the mass still under way is at most ``tolerance``: no
host's mass is further than that from the limit. Mass that reaches a host without
links ends there.

Edges are counted per pair of hosts before anything is joined, so a host with a
third of all pages is a few rows; a hub's edges are split by Spark's skew join.
Ranks and edges stay in Spark, and each block of rounds is written out.

Null urls, and those without "://", have empty host and path and fit no rule; they
keep the default verdict of a host without mass (allow). Null html has no links, and
relative links stay on their host, so they are no edges between hosts. Repeated
pages count as often as they are there; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, dropped, written

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    at = F.coalesce(F.locate("://", F.coalesce(url, F.lit(""))), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    at = F.coalesce(F.locate("://", F.coalesce(url, F.lit(""))), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links that name a host."""
    found = F.expr(r"""regexp_extract_all(html, '(?:href|src)\\s*=\\s*["\']?((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^"\'\\s>]+)', 1)""")
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    return links.select("src", target.alias("dst")).where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4, block: int = 5) -> DataFrame:
    """(walk, host, mass) of walks along (walk, src, dst, n) that restart at (walk, host, weight).

    ``left`` is what still moves: a round settles 1 - damping of it and moves the
    rest along the edges. What has settled adds up to the stationary mass, short of
    at most ``tolerance`` a walk.
    """
    total = seeds.groupBy("walk").agg(F.sum("weight").alias("all"))
    left = seeds.groupBy("walk", "host").agg(F.sum("weight").alias("weight")).join(F.broadcast(total), "walk").select("walk", "host", (F.col("weight") / F.col("all")).alias("left"))
    out = edges.groupBy("walk", "src").agg(F.sum("n").alias("all"))
    share = written(edges.join(out, ["walk", "src"]).select("walk", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("p")), "edges")
    if share.isEmpty():
        return left.select("walk", "host", (F.col("left") * (1 - damping)).alias("mass"))
    state = written(left.withColumn("mass", F.lit(0.0)), "rank")
    while True:
        before, rest = state, state.groupBy("walk").agg(F.sum("left").alias("s")).agg(F.max("s")).head()[0]
        if (rest or 0.0) <= tolerance:
            return state.select("walk", "host", "mass")
        for _ in range(block):
            moved = state.where("left > 0").join(share, ["walk", "host"]).select("walk", F.col("dst").alias("host"), (F.col("left") * F.col("p") * damping).alias("left"), F.lit(0.0).alias("mass"))
            stay = state.select("walk", "host", F.lit(0.0).alias("left"), (F.col("mass") + F.col("left") * (1 - damping)).alias("mass"))
            state = stay.unionByName(moved).groupBy("walk", "host").agg(F.sum("left").alias("left"), F.sum("mass").alias("mass"))
        state = written(state, "rank")
        dropped(before)


def host_verdicts(pages: DataFrame, threshold: float = 0.1, **walk) -> DataFrame:
    """(host, trust, distrust, judged) from pages with host, html and the rules' verdict."""
    edges = written(host_edges(pages), "hosts")
    both = edges.withColumn("walk", F.lit("allow")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("block").alias("walk")))
    ruled = pages.where("host <> '' and verdict is not null").groupBy("host", "verdict").agg(F.count("*").cast("double").alias("weight"))
    mass = pagerank(both, ruled.withColumnRenamed("verdict", "walk"), **walk)
    of = lambda w: F.coalesce(F.sum(F.when(F.col("walk") == w, F.col("mass"))), F.lit(0.0))
    hosts = mass.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))
    mean = hosts.agg((F.lit(1.0) / F.count("*")).alias("mean"))
    return hosts.crossJoin(F.broadcast(mean)).select("host", "trust", "distrust", F.when(F.col("distrust") - F.col("trust") > threshold * F.col("mean"), "block").otherwise("allow").alias("judged"))


def judge(pages: DataFrame, rules: list[Rule], **how) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    base = base.select("*", rule.alias("rule"), verdict.alias("verdict"))
    hosts = host_verdicts(base, **how).select(F.col("host").alias("_host"), "judged")
    out = base.drop("html").join(hosts, F.col("host") == F.col("_host"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "judged", F.lit("allow")).alias("verdict"))
