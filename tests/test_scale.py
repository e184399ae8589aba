"""Skewed and chunked inputs: one group with most of the rows, chunk and partition borders, plans."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickforge.operators import graph, primitives, profile
from clickforge.operators.ordering import index_rows, rank_in_group, running, with_neighbor

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one group; the order key runs against the row order."""
    return spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 50).cast("bigint").alias("g"),
        (F.lit(5000) - F.col("id")).alias("o"), (F.col("id") % 13).alias("v"))


@pytest.mark.parametrize("few_groups", [True, False])
def test_rank_of_a_hot_group(skewed, few_groups):
    got = rank_in_group(skewed, ["g"], ["o"], "rank", few_groups).toPandas()
    expected = got.sort_values("o").groupby("g").cumcount()
    assert (got.loc[expected.index, "rank"] == expected).all() and len(got) == 4000


@pytest.mark.parametrize("how,inclusive", [("sum", True), ("sum", False), ("max", True), ("min", False)])
def test_running_values_of_a_hot_group(skewed, how, inclusive):
    got = running(skewed, ["o"], "v", "run", group=["g"], how=how, inclusive=inclusive).toPandas().sort_values(["g", "o"])
    grouped = got.groupby("g")["v"]
    expected = {"sum": grouped.cumsum, "max": grouped.cummax, "min": grouped.cummin}[how]().astype(float)
    if not inclusive:
        expected = expected.groupby(got["g"]).shift(1)
        expected = expected.fillna(0) if how == "sum" else expected
    same = (got["run"].astype(float) == expected) | (got["run"].isna() & expected.isna())
    assert same.all()


def test_a_hot_group_is_spread_over_partitions(spark, skewed):
    from clickforge.operators.ordering import PART, ranged

    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")  # tiny test partitions would be merged
    try:
        parts = ranged(skewed, ["g", "o"]).groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.max((F.col("g") == 7).cast("int")).alias("hot")).collect()
    finally:
        spark.conf.unset(setting)
    assert len(parts) > 4 and sum(r["hot"] for r in parts) > 2 and max(r["n"] for r in parts) < 2000


@pytest.mark.parametrize("step", [-1, 1])
def test_neighbors_across_chunks(spark, step):
    df = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 3).alias("x"))
    got = with_neighbor(df, "pos", {"y": "x"}, step=step, chunk=7).orderBy("pos").toPandas()
    expected = got["x"].shift(-step)
    assert len(got) == 100 and ((got["y"] == expected) | (got["y"].isna() & expected.isna())).all()


def test_ufunc_scan_over_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(primitives, "CHUNK_ROWS", 10)
    df = spark.range(1234).select(F.col("id").alias("pos"), ((F.col("id") * 7919) % 101).cast("double").alias("x"))
    for inclusive in (True, False):
        got = primitives.prefix_scan(df, "x", ["pos"], np.add, inclusive=inclusive).orderBy("pos").toPandas()
        expected = got["x"].cumsum() - (0 if inclusive else got["x"])
        assert (got["scan"] == expected).all() and len(got) == 1234


def test_hub_becomes_several_adjacency_rows(spark):
    star = spark.range(1, 51).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    lists = graph.adjacency_lists(graph.edge_weights(star), chunk=16).filter("src = 0").orderBy("chunk").collect()
    assert [len(r["neighbors"]) for r in lists] == [16, 16, 16, 2]
    assert [e["dst"] for r in lists for e in r["neighbors"]] == list(range(1, 51))


def test_no_plan_has_a_cross_join_or_a_forced_large_broadcast(spark):
    clicks = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") % 37).alias("u"))
    plan = graph.cooccurrence_edges(clicks, "u", "pos", 32)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Join" not in plan


def test_pairs_stay_linear_in_the_rows(spark):
    rows = spark.range(10_000).select(F.col("id").alias("pos"), (F.col("id") + 1).alias("u"))
    assert graph.cooccurrence_edges(rows, "u", "pos", 32).count() <= 10_000 * 31 // 2


@few
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60))
def test_positions_and_batches(spark, values):
    df = spark.createDataFrame([(i // 8, i % 8, v) for i, v in enumerate(values)], "batch bigint, in_batch bigint, u bigint")
    unique = profile.batch_unique(df, ["u"])
    inverse = profile.batch_inverse(df, ["u"])
    back = inverse.join(unique, ["batch", "field"]).select("batch", "in_batch", F.expr("ids[cast(inv as int)]").alias("u"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    offsets = profile.unique_offsets(profile.batch_sizes(df, ["u"])).orderBy("batch").collect()
    assert offsets[0]["lo"] == 0 and all(a["hi"] == b["lo"] for a, b in zip(offsets, offsets[1:]))
    ranks = profile.frequency_rank(profile.access_counts(df, ["u"], {"u": 6}))
    assert sorted(r["new_id"] for r in ranks.collect()) == list(range(6))


@few
@given(st.lists(st.integers(0, 2), min_size=1, max_size=50))
def test_runs_restore_the_sequence(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "pos bigint, x bigint")
    runs = primitives.run_length_encode(df, "x", "pos").orderBy("run").collect()
    assert [r["x"] for r in runs for _ in range(r["len"])] == values
    summed = primitives.reduce_by_run(df, "x", "pos", {"n": F.count(F.lit(1))}).orderBy("run").collect()
    assert [(r["x"], r["n"]) for r in summed] == [(r["x"], r["len"]) for r in runs]


def test_communities_keep_components_apart(spark):
    """Two separate cliques, and a star whose leaves must all join its centre."""
    edges = [(a, b) for c in (0, 5) for a in range(c, c + 5) for b in range(a + 1, c + 5)]
    edges += [(10, leaf) for leaf in range(11, 60)]
    weights = graph.edge_weights(spark.createDataFrame(edges, "src bigint, dst bigint"))
    forest = graph.communities(weights, 62).persist()
    roots = {r["v"]: r["root"] for r in graph.trace_community(forest).collect()}
    assert len({roots[v] for v in range(5)}) == 1 and len({roots[v] for v in range(5, 10)}) == 1
    assert len({roots[0], roots[5], roots[10], roots[60], roots[61]}) == 5
    assert {roots[v] for v in range(10, 60)} == {roots[10]}
    perm = graph.permutation(forest)
    verdict = graph.check_partition(forest, perm, 62).first()
    assert verdict["one_top_each"] and verdict["tops_are_roots"] and verdict["is_permutation"]
    places = {r["old"]: r["new"] for r in perm.collect()}
    spots = sorted(places[v] for v in range(5))
    assert spots == list(range(spots[0], spots[0] + 5))


def test_trace_path_runs_from_root_to_vertex(spark):
    parents = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (4, 3), (9, 9)], "v bigint, parent bigint")
    paths = {r["v"]: r["path"] for r in graph.trace_community(parents, with_path=True).collect()}
    assert paths == {0: [0], 1: [0, 1], 2: [0, 1, 2], 3: [0, 1, 2, 3], 4: [0, 1, 2, 3, 4], 9: [9]}


def test_compose_moves_only_cold_ids(spark):
    ranks = spark.createDataFrame([(i, (i * 3) % 10) for i in range(10)], "old_id bigint, new_id bigint")
    swap = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "old bigint, new bigint")
    final = {r["old_id"]: r["new_id"] for r in graph.compose_bijection(ranks, swap, hot=4).collect()}
    expected = {old: {5: 6, 6: 5}.get(new, new) for old, new in ((i, (i * 3) % 10) for i in range(10))}
    assert final == expected


def test_index_rows_covers_all_rows_once(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = index_rows(df, ["k"]).toPandas()
    assert (got["pos"] == got["k"]).all() and len(got) == 1000


def test_order_graph_of_an_edge_list(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (4, 5), (5, 6), (4, 6)], "src bigint, dst bigint")
    members, numbering = graph.order_graph(edges)
    groups = {r["v"]: r["community"] for r in members.collect()}
    assert groups[0] == groups[1] == groups[2] != groups[4] == groups[5] == groups[6] and len(groups) == 7
    assert sorted(r["new"] for r in numbering.collect()) == list(range(7))


def test_file_positions_over_several_splits(spark, tmp_path):
    from clickforge.operators.ordering import index_file_rows

    for part in range(3):
        (tmp_path / f"part-{part}.txt").write_text("".join(f"{part * 1000 + i}\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        got = index_file_rows(spark.read.text(str(tmp_path))).toPandas()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 3000 and (got["value"].astype(int) == got["pos"]).all()


def test_file_positions_survive_other_split_sizes(spark, tmp_path):
    from clickforge.operators.ordering import index_file_rows

    for k in range(3):
        (tmp_path / f"part{k}.txt").write_text("".join(f"{k * 1000 + i}\n" for i in range(1000)))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        numbered = index_file_rows(spark.read.text(str(tmp_path)))
        for n in names:
            spark.conf.set(n, "700")
        got = numbered.collect()
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(got) == 3000 and all(int(r["value"]) == r["pos"] for r in got)


@pytest.mark.parametrize("hub", [3, 1000])
def test_lists_of_hubs_and_others(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB_DEGREE", hub)
    weights = graph.edge_weights(spark.range(60).select(F.expr("id % 7").alias("src"), F.expr("id * id % 23 + 7").alias("dst")))
    lists = graph.adjacency_lists(weights, chunk=2)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert (hub < 7) == ("_part" in plan)  # nobody ranks the edges of small vertices
    by_hand = {}
    for r in sorted(weights.collect()):
        by_hand.setdefault(r.src, []).append((r.dst, r.w))
    assert {(r.src, r.chunk): [tuple(e) for e in r.neighbors] for r in lists.collect()} == {
        (v, k // 2): found[k : k + 2] for v, found in by_hand.items() for k in range(0, len(found), 2)}
