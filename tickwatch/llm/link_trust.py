"""URL filter: rules first, then trust and distrust spread over the links between hosts.

A rule names a host with its subdomains and the beginning of a path; the longest rule that fits decides. Pages that
no rule judges get their host's verdict. Trust is personalised PageRank from the hosts of allowed pages, in proportion to
their number; distrust is the same on reversed links from the hosts of blocked pages, for who links to bad
hosts is suspect. A host is blocked if its distrust exceeds ``ratio`` times its trust, however small both are: ranks add up to 1
over the corpus, so a least distrust would mean something else on every table.

Ranks are converged host by host: rounds go on until no host is reached for the first time and no rank has grown by more than
TOLERANCE of itself in LOOK rounds. As a round keeps that bound for all later ones, n rounds leave each rank less than
(n + 1) * TOLERANCE of itself short, however small it is and however far from a seed. This takes as many rounds as the
longest shortest path from a seed has links, and about ROUNDS more if there are cycles.

Links are the ``href``s of the pages' html that name a host; there is one edge per pair of hosts, weighted by the pages that
have it. Links within a host say nothing and are left out. Edges and ranks stay tables; minima of work per round
are one join and one pre-aggregated sum, and LOOK rounds are one job.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is allowed unless
the empty host is found blocked, which no rule can cause; a null html has no links; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickwatch.llm.common import materialise, sized

Rule = tuple[str, str]  # (rule, "allow" or "block")
DAMPING = 0.85
#: Growth of any host's rank in LOOK rounds, relative to it, under which the rounds end.
TOLERANCE = 1e-10
#: Rounds between two looks at the growth.
LOOK = 8
#: Plain rounds that move all but TOLERANCE of the mass to its place.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of an absolute or scheme-relative link.
HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\s]+)"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, with its verdict; of equally long ones the first in order, block before allow."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, html: str = "html") -> DataFrame:
    """src, dst, weight: how many pages of one host link to another. ``pages`` has the column host."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html), F.lit(HREF), 1), lambda x: F.translate(x, UPPER, LOWER)))
    pairs = pages.where(F.col(html).contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    return pairs.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING) -> DataFrame:
    """Converged personalised PageRank: (host, rank) from seeds (host, seed), whose seeds add up to 1. Rank that a host
    without links would hand on goes back to the seeds. Hosts that no seed reaches are left out."""
    if edges.isEmpty():
        return seeds.select("host", F.col("seed").alias("rank"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    shares = edges.join(out, "src").select(F.col("src").alias("host"), "dst", (F.col("weight") / F.col("all") * damping).alias("share"))
    shares = sized(shares, "shares")
    seeds = seeds.select("host", F.col("seed").alias("rank"))
    ranks, moving = seeds, True
    while moving:
        new = ranks
        for _ in range(LOOK):
            moved = new.join(shares, "host").select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
            new = moved.union(seeds).groupBy("host").agg(F.sum("rank").alias("rank"))
        new = sized(new.join(ranks.withColumnRenamed("rank", "was"), "host", "left"), "ranks")
        moving = not new.where(F.col("was").isNull() | (F.col("rank") - F.col("was") > F.col("rank") * TOLERANCE)).isEmpty()
        ranks = new.select("host", "rank")
    total = ranks.agg(F.sum("rank")).first()[0] or 1.0
    return ranks.select("host", (F.col("rank") / total).alias("rank"))


def seeds_of(pages: DataFrame, verdict: str) -> DataFrame:
    found = pages.where((F.col("verdict") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"))
    found = materialise(found, "seeds")
    total = found.agg(F.sum("n")).first()[0] or 1
    return found.select("host", (F.col("n") / F.lit(float(total))).alias("seed"))


def judge(pages: DataFrame, rules: Sequence[Rule], ratio: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    host, path = split_url(F.col("url").cast("string"))
    named = pages.select("page_id", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    ruled = named.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "html", "host", "path", "r.rule", "r.verdict")
    edges = materialise(host_edges(ruled.select("host", "html")), "host-edges")
    trust = spread(edges, seeds_of(ruled, "allow"))
    distrust = spread(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), seeds_of(ruled, "block"))
    scores = trust.select("host", F.col("rank").alias("trust")).join(distrust.select("host", F.col("rank").alias("distrust")), "host", "full")
    scores = materialise(scores.select(F.col("host").alias("s_host"), "trust", "distrust"), "scores")
    out = ruled.drop("html").join(scores, F.col("host") == F.col("s_host"), "left")
    trust_, distrust_ = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    # who is reached by distrust alone is blocked, even if so many links divide it that a double holds 0
    only = F.col("trust").isNull() & F.col("distrust").isNotNull()
    spread_ = F.when(only | (distrust_ > trust_ * ratio), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", spread_).alias("verdict"), trust_.alias("trust"), distrust_.alias("distrust"))
