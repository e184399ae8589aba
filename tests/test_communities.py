"""Community merging: the number of rounds on graphs of growing size, and communities that are determined."""

import math

import pytest
from pyspark.sql import functions as F

from clickforge.operators import graph
from clickforge.session import materialize


def path(n):
    return [(i, i + 1) for i in range(n - 1)]


def star(n):
    return [(0, i) for i in range(1, n)]


def ring(m, k):
    """m cliques of k vertices, each joined to the next by one edge."""
    inner = [(c * k + i, c * k + j) for c in range(m) for i in range(k) for j in range(i)]
    return inner + [(c * k, (c + 1) % m * k + 1) for c in range(m)]


def merged(spark, edges):
    """Communities by vertex, number of rounds, modularity."""
    weights = materialize(graph.edge_weights(spark.createDataFrame(edges, "src bigint, dst bigint")))
    forest = materialize(graph.communities(weights))
    members = materialize(graph.trace_community(forest).select("v", F.col("root").alias("community")))
    rounds = forest.agg(F.max("round") + 1).first()[0]
    return {r.v: r.community for r in members.collect()}, rounds, graph.modularity(weights, members).first()[0]


@pytest.mark.parametrize("n", [100, 1600])
def test_rounds_on_a_path_grow_with_the_logarithm(spark, n):
    found, rounds, quality = merged(spark, path(n))
    assert rounds <= math.log2(n) + 2
    # communities of a path are stretches of it
    assert sum(found[v] != found[v + 1] for v in range(n - 1)) == len(set(found.values())) - 1
    assert quality > 0.75


def test_a_star_takes_one_round(spark):
    found, rounds, _ = merged(spark, star(1500))
    assert rounds == 1 and set(found.values()) == {0}


@pytest.mark.parametrize("m", [8, 128])
def test_cliques_of_a_ring_are_found(spark, m):
    found, rounds, quality = merged(spark, ring(m, 6))
    assert rounds <= math.log2(6 * m) + 2
    groups = {}
    for v, c in found.items():
        groups.setdefault(c, set()).add(v)
    cliques = [list(range(c * 6, c * 6 + 6)) for c in range(m)]
    apart = 30 / 32 - 1 / m
    if m < 32:  # two neighbouring cliques would lose
        assert sorted(map(sorted, groups.values())) == cliques and quality == pytest.approx(apart)
    else:  # joining neighbours gains 1 - 32 / m, but no clique is torn
        assert all(len({found[v] for v in clique}) == 1 for clique in cliques) and quality > apart


def test_one_clique_becomes_one_community(spark):
    # the bound on the gain leaves out edges among those who join, so the rounds are not logarithmic here
    found, rounds, _ = merged(spark, ring(1, 12)[:-1])
    assert len(set(found.values())) == 1 and rounds < 12


def test_proposals_are_stars_and_a_finished_community_waits(spark):
    # 1 -> 2 -> 3, and 9 (heavy) -> 1 (light), which itself sends to 2
    rows = [(1, 2, 1.0, 2.0, 3.0), (2, 3, 1.0, 3.0, 5.0), (3, 2, 1.0, 5.0, 3.0), (9, 1, 1.0, 8.0, 2.0)]
    proposals = spark.createDataFrame(rows, "v bigint, u bigint, w double, sv double, su double")
    senders = materialize(graph._senders(proposals))
    assert {(r.v, r.u) for r in senders.collect()} == {(1, 2), (2, 3)}
    seen = set()
    for seed in range(8):
        tries = {(r.v, r.u) for r in graph._attempts(senders, seed).collect()}
        assert tries in ({(1, 2)}, {(2, 3)}, set())
        seen |= tries
    assert seen == {(1, 2), (2, 3)}


def test_ties_by_the_hash_of_the_pair_agree_from_both_ends(spark):
    weights = graph.edge_weights(spark.createDataFrame(ring(1, 12)[:-1], "src bigint, dst bigint"))
    best = {r.v: r.u for r in graph.best_neighbor(weights, seed=3).collect()}
    mutual = [v for v, u in best.items() if best[u] == v]
    assert mutual and len(set(best.values())) > 2


def test_no_edges(spark):
    weights = spark.createDataFrame([], "src bigint, dst bigint, w double")
    assert [tuple(r) for r in graph.communities(weights, 3).orderBy("v").collect()] == [(v, v, -1) for v in range(3)]


def test_pairs_dealt_in_blocks_are_added_up_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 50)  # several groups of ids
    rows = spark.range(400).select(F.col("id").alias("pos"), F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(40))).alias("id"))
    plain = graph.cooccurrence_edges(rows, "id", "pos", 16)
    dealt = graph.cooccurrence_edges(rows, "id", "pos", 16, "block")
    assert sorted(dealt.select("batch", "src", "dst").collect()) == sorted(plain.collect())
    places = dealt.groupBy("src", "dst").agg(F.countDistinct("block").alias("n"))
    assert places.agg(F.max("n")).first()[0] == 1 and dealt.select("block").distinct().count() > 10
    weights = graph.edge_weights(dealt, block="block")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") > plan.index("posexplode")  # read from the end: no pair moves once it is made
    assert sorted(weights.collect()) == sorted(graph.edge_weights(plain).collect())


def test_best_neighbours_are_not_found_by_sorting_all_edges(spark):
    weights = materialize(graph.edge_weights(spark.createDataFrame(ring(5, 4), "src bigint, dst bigint")))
    plan = graph.best_neighbor(weights, seed=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "_top" in plan and "gain" in plan
    strength = {r.v: r.strength for r in graph.degrees(weights).collect()}
    total, best = sum(strength.values()), {}
    for r in weights.collect():
        gain = r.w - strength[r.src] * strength[r.dst] / total
        if gain > 0:
            best[r.src] = min(best.get(r.src, (0.0, r.dst)), (-gain, r.dst))
    assert {r.v: (-r.gain, r.u) for r in graph.best_neighbor(weights).collect()} == best
