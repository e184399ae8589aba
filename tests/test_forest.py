"""Depth-first numbering without path arrays, and vectors that are missing from a row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickforge.operators import graph, interaction


def numbered(parents):
    """Depth-first places, children and roots by id."""
    below = {}
    for v, p in parents.items():
        below.setdefault(None if v == p else p, []).append(v)
    places, stack = {}, sorted(below.get(None, []), reverse=True)
    while stack:
        v = stack.pop()
        places[v] = len(places)
        stack += sorted(below.get(v, []), reverse=True)
    return places


def sizes_of(parents):
    sizes = dict.fromkeys(parents, 0)
    for v in parents:
        while True:
            sizes[v] += 1
            if parents[v] == v:
                break
            v = parents[v]
    return sizes


@pytest.mark.parametrize("seed", range(2))
def test_places_and_sizes_of_random_forests(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(5000), 300)
    parents = {v: ids[rng.randrange(max(0, i - rng.choice([3, 300])), i + 1)] for i, v in enumerate(ids)}
    forest = spark.createDataFrame(list(parents.items()), "v bigint, parent bigint").repartition(4)
    assert {r.old: r.new for r in graph.permutation(forest).collect()} == numbered(parents)
    assert {r.v: r.size for r in graph.subtree_sizes(forest).collect()} == sizes_of(parents)
    paths = {r.v: r.path for r in graph.trace_community(forest, with_path=True).collect()}
    assert sorted(parents, key=paths.get) == sorted(parents, key=numbered(parents).get)


def test_a_fixed_forest(spark):
    #      3          8
    #    /   \\
    #   1     6
    #  / \\     \\
    # 7   2     0
    forest = spark.createDataFrame([(3, 3), (1, 3), (6, 3), (7, 1), (2, 1), (0, 6), (8, 8)], "v bigint, parent bigint")
    assert {r.old: r.new for r in graph.permutation(forest).collect()} == {3: 0, 1: 1, 2: 2, 7: 3, 6: 4, 0: 5, 8: 6}
    moved = graph.offset_permutation(graph.permutation(forest), 10)
    assert {r.old: r.new for r in moved.collect()}[8] == 16


def test_a_chain_of_100000_vertices(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("v"), F.greatest(F.col("id") - 1, F.lit(0)).alias("parent"))
    out = graph.permutation(chain)
    assert out.count() == n and out.filter("old <> new").count() == 0
    assert out.schema.simpleString() == "struct<old:bigint,new:bigint>"


def test_stars_circles_and_nothing(spark):
    star = spark.range(2000).select(F.col("id").alias("v"), F.lit(0).cast("bigint").alias("parent"))
    assert graph.permutation(star).filter("old <> new").count() == 0
    with pytest.raises(ValueError, match="circle"):
        graph.permutation(spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 1)], "v bigint, parent bigint"))
    assert graph.permutation(star.limit(0)).count() == 0


def test_missing_vectors_count_as_zeros(spark):
    rows = [(0, [1.0, 2.0], [None, [3.0, 4.0]]), (1, [5.0, 6.0], [[7.0, 8.0], None]), (2, [1.0, 1.0], [None, None])]
    df = spark.createDataFrame(rows, "k int, d array<double>, v array<array<double>>").coalesce(1)
    got = {r.k: r.features for r in interaction.pairwise_dot(df, "d", "v", 2).collect()}
    assert got == {0: [1.0, 2.0, 0.0, 11.0, 0.0], 1: [5.0, 6.0, 83.0, 0.0, 0.0], 2: [1.0, 1.0, 0.0, 0.0, 0.0]}
    upper = {r.k: r.features for r in interaction.pairwise_dot_upper(df, "d", "v", 2).collect()}
    assert upper[0] == [1.0, 2.0, 0.0, 11.0, 0.0]
    layer = [(np.eye(2), np.zeros(2))]
    top = [(np.ones((1, 5)), np.zeros(1))]
    scores = {r.k: r.score for r in interaction.score_batch(df, "d", "v", 2, 2, layer, top).collect()}
    assert abs(scores[0] - 1 / (1 + np.exp(-14.0))) < 1e-12


@pytest.mark.parametrize("bad", [[(0, [1.0, 2.0], [[1.0]])], [(0, [1.0, 2.0], None)], [(0, [1.0, 2.0], [[1.0, 2.0]]), (1, [1.0, 2.0], [[1.0, 2.0]] * 2)]])
def test_lists_of_other_lengths_end_the_job(spark, bad):
    df = spark.createDataFrame(bad, "k int, d array<double>, v array<array<double>>").coalesce(1)
    with pytest.raises(Exception, match="vectors"):
        interaction.pairwise_dot(df, "d", "v", 2).collect()


def test_weights_have_a_limit(spark, monkeypatch):
    monkeypatch.setattr(interaction, "WEIGHT_LIMIT_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        interaction.score_batch(None, "d", "v", 2, 2, [(np.eye(2), np.zeros(2))], [])
