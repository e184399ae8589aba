"""Communities of a graph that is kept as the members of its batches: the same forest, and no pair is written out."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickforge.functions import proposals
from clickforge.operators import graph
from clickforge.session import materialize


@pytest.fixture
def plain_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def clicks(spark):
    """(pos, id) in batches of 4: every batch draws from one of six sets of four ids, sometimes with one of the next set or the
    hot id. With repeated rows, rows without an id and rows without a position."""
    drawn = np.random.default_rng(3).integers(1, 5, 240)
    rows = [(p, int(0 if p % 29 == 0 else (p // 4 + (p % 40 == 0)) % 6 * 4 + drawn[p])) for p in range(240)]
    rows += [rows[7], (8, None), (None, 5), (None, 9), (None, 11)]
    return materialize(spark.createDataFrame(rows, "pos bigint, id bigint"), "clicks")


def members_of(clicks):
    batches = clicks.select(graph.int_div("pos", 4).alias("batch"), F.col("id").alias("v")).filter("v > 0").distinct()
    return materialize(batches.withColumn("times", F.lit(1).cast("bigint")), "members")


@pytest.mark.parametrize("stored", [0, 1])
def test_the_forest_is_that_of_the_written_edges(spark, clicks, monkeypatch, plain_joins, stored):
    monkeypatch.setattr(graph, "TASK_PAIRS", 60)
    monkeypatch.setattr(graph, "STORED_EDGES", stored)
    weights = materialize(graph.edge_weights(graph.cooccurrence_edges(clicks, "id", "pos", 4)), "weights")
    n = graph.vertex_count(weights).first()["n"]
    known = sorted(map(tuple, graph.communities(weights, n).collect()))
    meetings = graph.Meetings(members_of(clicks))
    found = sorted(map(tuple, graph.communities(meetings, n).collect()))
    assert found == known and max(r[2] for r in known) > 0


def test_merged_members_count_as_often_as_their_parts(spark):
    rows = [(0, 1, 2), (0, 2, 3), (0, 3, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]  # id 2 is in batch 1 twice
    members = spark.createDataFrame(rows, "batch bigint, v bigint, times bigint")
    pairs = graph.cooccurrence_edges(members, "v", "batch", 1, "block", "times", 2)
    weights = graph.edge_weights(pairs, "w", "block", mirrored=False)
    assert {(r.src, r.dst): r.w for r in weights.collect()} == {(1, 2): 6 + 2, (1, 3): 2, (2, 3): 3}


def test_reordering_writes_out_no_pairs(spark, monkeypatch):
    stored = {}

    def counted(df, label="table", partition_by=None):
        table = materialize(df, label, partition_by)
        stored[label] = max(stored.get(label, 0), table.count())
        return table

    def alone(weights, n):
        """Every vertex on its own, after the proposals of one round."""
        assert counted(weights.proposals(weights.strengths.agg(F.sum("strength")).scalar(), 0, None), "proposals").count() > 800
        return spark.range(n).select(F.col("id").alias("v"), F.col("id").alias("parent"))

    monkeypatch.setattr(graph, "materialize", counted)
    monkeypatch.setattr(graph, "communities", alone)
    wide = spark.range(4000).select(F.col("id").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("id"))
    ranks = spark.range(900).select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    moved = graph.reorder_cold_ids(wide, ranks, "id", "pos", 45, 128).collect()
    assert sorted(r.new_id for r in moved) == sorted(r.old_id for r in moved) == list(range(900))
    cold = wide.select("pos", F.greatest(F.col("id") - 45, F.lit(0)).alias("v"))
    assert graph.cooccurrence_edges(cold, "v", "pos", 128).count() > 40 * 4000 and max(stored.values()) <= 4000


def test_pairs_stay_in_the_task_that_made_them(spark, clicks, monkeypatch, plain_joins):
    monkeypatch.setattr(graph, "TASK_PAIRS", 60)
    best = graph.Meetings(members_of(clicks)).proposals(F.lit(1e6), 0, None)
    physical = best._jdf.queryExecution().toString().split("Physical Plan")[-1]
    made = physical.split("MapInArrow")[1].split("Generate posexplode")[0]
    assert made.count("ShuffledHashJoin") == 2 and "Exchange" not in made and "Sort" not in made.replace("SortArray", "")


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_best_edges_of_a_task(monkeypatch, chunk):
    monkeypatch.setattr(proposals, "CHUNK_EDGES", chunk)
    rng = np.random.default_rng(0)
    ends = {tuple(sorted(p)) for p in rng.integers(0, 60, (900, 2)).tolist() if p[0] != p[1]}
    edges = [(a, b, 1.0, float(a), float(b), float(rng.integers(1, 4)), int(rng.integers(0, 2))) for a, b in sorted(ends)]
    rng.shuffle(edges)
    table = pa.table(dict(zip(("src", "dst", "w", "sv", "su", "gain", "tie"), map(list, zip(*edges)))))
    table = table.set_column(0, "src", table["src"].cast(pa.int64())).set_column(1, "dst", table["dst"].cast(pa.int64()))
    table = table.set_column(6, "tie", table["tie"].cast(pa.int64()))
    got = {r["v"]: (r["u"], r["w"], r["sv"], r["su"], r["gain"], r["tie"])
           for out in proposals.best_edges(iter(table.to_batches(max_chunksize=5))) for r in out.to_pylist()}
    known = {}
    for a, b, w, sa, sb, gain, tie in edges:
        for v, u, sv, su in ((a, b, sa, sb), (b, a, sb, sa)):
            key = (-gain, tie, u)
            if int(v) not in known or key < known[int(v)][0]:
                known[int(v)] = (key, (int(u), w, sv, su, gain, int(tie)))
    assert got == {v: row for v, (_, row) in known.items()}
    assert list(proposals.best_edges(iter([]))) == []
