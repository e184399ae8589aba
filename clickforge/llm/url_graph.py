"""URL filtering: the longest fitting rule, else trust and distrust spread over the links between hosts.

Hosts of pages that an allow rule fits are trusted seeds, those of block rules are blocked seeds (each with
the number of such pages). Trust is personalised PageRank along the links; distrust is the same against the
links: who links to bad hosts is bad. A host is blocked where its share of distrust exceeds ``THRESHOLD``.

Scale: one pass extracts (host, linked host) pairs and rule hits; both are summed before and after one
shuffle, so hot hosts cost one row per task. Each round of PageRank is a join of host ranks with distinct
host edges and a partial sum. The loop ends when ranks change by less than ``TOLERANCE`` in total; the
damping makes sure that it does. Verdicts join pages with hosts (unique keys; adaptive execution splits hot ones).

Cases: a null url or one without ``://`` has an empty host and path, no rule fits and it is allowed unless
links say otherwise; a null html has no links; repeated rows count once each; self links are ignored; hosts
without any rank are allowed; extra columns are ignored; an empty table gives an empty result. Of rules of
equal length the block rule wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import ascii_lower
from clickforge.session import materialize

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-4, 0.5

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[1] != "block"), reverse=True):
        where, slash, start = rule.partition("/")
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, target, n): links from one host to another in the pages' anchors."""
    linked = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_LINK), F.lit(1))
    return (
        pages.select(host_of(F.col(url)).alias("source"), F.explode(linked).alias("t"))
        .select("source", ascii_lower(F.col("t")).alias("target"))
        .filter("source <> target and source <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of several kinds at once.

    ``edges`` (kind, source, target, n), ``seeds`` (kind, host, weight); returns (kind, host, rank), which sum to 1
    by kind. What hosts without links would pass on goes back to the seeds: that only scales all ranks, so it is
    left to the final division.
    """
    total = seeds.groupBy("kind").agg(F.sum("weight").alias("total"))
    start = materialize(seeds.join(total, "kind").select("kind", "host", (F.col("weight") / F.col("total")).alias("seed")), "seeds")
    out = edges.groupBy("kind", "source").agg(F.sum("n").alias("out"))
    edges = materialize(
        edges.join(out, ["kind", "source"]).select("kind", F.col("source").alias("host"), "target", (F.col("n") / F.col("out")).alias("share")),
        "host-edges",
    )
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    while not edges.isEmpty():
        passed = ranks.join(edges, ["kind", "host"]).groupBy("kind", F.col("target").alias("host")).agg(
            F.sum(F.col("rank") * F.col("share")).alias("come"))
        step = passed.join(start, ["kind", "host"], "full").select(
            "kind", "host",
            ((1 - damping) * F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("come", F.lit(0.0))).alias("rank"),
        )
        step = materialize(
            step.join(ranks.withColumnRenamed("rank", "was"), ["kind", "host"], "full").select(
                "kind", "host", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.coalesce("was", F.lit(0.0)).alias("was")),
            "ranks",
        )
        moved = step.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0] or 0.0
        ranks = step.select("kind", "host", "rank")
        if moved < tolerance:
            break
    mass = ranks.groupBy("kind").agg(F.sum("rank").alias("mass"))
    return ranks.join(mass, "kind").select("kind", "host", (F.col("rank") / F.col("mass")).alias("rank"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust of every page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    named = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    named = named.withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = named.filter("hit is not null and host <> ''").groupBy(
        F.when(F.col("hit.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host"
    ).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    links = materialize(host_edges(pages, url, html), "links")
    ways = [
        links.select(F.lit("trust").alias("kind"), "source", "target", "n"),
        links.select(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"),
    ]
    ranks = propagate(reduce(DataFrame.union, ways), seeds)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    hosts = ranks.groupBy("host").agg(of("trust"), of("distrust"))
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    method = F.when(share > THRESHOLD, "block").otherwise("allow")
    return named.join(hosts, "host", "left").select(
        key, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
