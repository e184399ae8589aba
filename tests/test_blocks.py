"""Lookups and bags in blocks: each vector travels once to a block, results equal plain joins; ids without an edge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickforge.functions.vectors import vector_sum, zero_vector
from clickforge.llm import toxicity
from clickforge.operators import graph, vectors
from clickforge.operators.stores import VectorTable
from clickforge.plans.registry import QUERIES
import clickforge.plans.all_queries  # noqa: F401  registers the queries


def plan_of(df):
    return df._jdf.queryExecution().toString()


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def plain_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture(scope="module")
def table(spark):
    """Id 7 has two vectors."""
    return spark.createDataFrame([(i % 40, [float(i), -1.0]) for i in [*range(40), 47]], "id bigint, vec array<float>")


def test_rows_and_vectors_meet_in_blocks(spark, table, monkeypatch, plain_joins):
    monkeypatch.setattr(vectors, "BLOCK_IDS", 20)
    data = [(k, k % 45 if k % 9 else None, k * 7 % 40) for k in range(300)]
    rows = spark.createDataFrame([*data, data[1]], "k bigint, a bigint, b bigint")
    got = vectors.lookup_blocks(rows, {"a": "u", "b": "w"}, table)
    plain = rows.join(table.toDF("a", "u"), "a").join(table.toDF("b", "w"), "b").select("k", "a", "b", "u", "w")
    assert sorted_rows(got) == sorted_rows(plain)
    assert vectors.lookup_blocks(rows.limit(0), {"a": "u"}, table).count() == 0


@pytest.mark.parametrize("held, cells, slices", [(1 << 20, 9, 1), (240, 9, 3), (240, 8, 1)])  # 41 vectors of 16 bytes
def test_wide_rows_pass_by_the_vectors_of_their_block(spark, table, monkeypatch, plain_joins, held, cells, slices):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "HELD_BYTES", held)
    monkeypatch.setattr(vectors, "MAX_CELLS", cells)
    data = [(k, k % 45 if k % 9 else None, k * 7 % 40) for k in range(600)] + [(k, 3, 7) for k in range(300)]  # two hot keys
    rows = spark.createDataFrame(data, "k bigint, a bigint, b bigint")
    assert vectors._slices_and_rows(table, len(data), 2)[0] == slices
    got = vectors.lookup_blocks(rows, {"a": "u", "b": "w"}, table)
    plain = rows.join(table.toDF("a", "u"), "a").join(table.toDF("b", "w"), "b").select("k", "a", "b", "u", "w")
    assert sorted_rows(got) == sorted_rows(plain)
    physical = plan_of(got).split("Initial Plan")[-1]
    assert physical.count("ShuffledHashJoin") == 2 and "Sort [_block" not in physical  # rows with vectors are not sorted
    blocks = got.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in blocks) < 2 * 100  # id 7 has two vectors, and the blocks of a cell are drawn


@pytest.mark.parametrize("held", [1 << 20, 16 * 512])  # all 41 vectors, or 16 of them
def test_picked_rows_are_not_sorted_with_their_vectors(spark, monkeypatch, plain_joins, tmp_path, held):
    monkeypatch.setattr(vectors, "HELD_BYTES", held)
    table = spark.createDataFrame([(i % 40, [i / 40 - j / 64 for j in range(64)]) for i in [*range(40), 47]], "vec_id bigint, embedding array<float>")
    orders = [(k if k % 50 else 3, k * 7 % 45 if k % 9 else None, "P" if k % 10 == 0 else "O") for k in range(1100)]
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    picked = QUERIES["score_with_pick"](spark, str(tmp_path))
    scored = {(r.o_orderkey, r.score) for r in QUERIES["score_batch"](spark, str(tmp_path)).collect()}
    rows = picked.collect()
    physical = plan_of(picked).split("Initial Plan")[-1]
    assert physical.count("ShuffledHashJoin") == 3 and "Sort [_block" not in physical
    assert rows and {(r.o_orderkey, r.score) for r in rows} <= scored
    assert {r.label for r in rows} == {0, 1}


@pytest.mark.parametrize("hot", [False, True])
def test_bags_are_summed_inside_their_blocks(spark, table, monkeypatch, plain_joins, hot):
    monkeypatch.setattr(vectors, "BLOCK_IDS", 80)
    pairs = [(k % 60 if k % 11 else None, k * 7 % 45 if k % 13 else None) for k in range(400)] + [(3, 7)] * (500 if hot else 0)
    members = spark.createDataFrame(pairs, "row bigint, id bigint")
    rows = spark.createDataFrame([(k,) for k in [*range(70), 5, None]], "row int")
    sums = vector_sum(members.join(table, "id"), ["row"], "vec", 2)
    plain = rows.join(sums, "row", "left").withColumn("vec", F.coalesce("vec", zero_vector(2)))
    bags = vectors.embedding_bag(rows, members, table, 2)
    assert sorted_rows(bags) == sorted_rows(plain)
    assert hot or "hashpartitioning(row#" not in plan_of(bags)  # wide sums do not travel


def test_bags_of_a_stored_table_are_summed_inside_their_blocks(spark, table, plain_joins):
    store = VectorTable.create(table.filter("id <> 7"), 2, buckets=3)
    members = spark.createDataFrame([(k % 60, k * 7 % 45) for k in range(400)], "row bigint, id bigint")
    rows = spark.range(70).select(F.col("id").alias("row"))
    bags = store.bags(rows, members)
    assert sorted_rows(bags) == sorted_rows(vectors.embedding_bag(rows, members, table.filter("id <> 7"), 2))
    assert "hashpartitioning(row#" not in plan_of(bags)


def test_ends_of_edges_stay_out_of_the_driver(spark):
    edges = spark.createDataFrame([(0, 1, 2), (0, 1, 5), (1, 2, 5)], "batch bigint, src bigint, dst bigint")
    free = graph.unused_ids(edges, 7)
    assert "Broadcast" not in plan_of(free)
    assert sorted(r.id for r in free.collect()) == [0, 3, 4, 6]


def test_batches_are_dealt_to_tasks_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_PAIRS", 1000)
    rows = spark.range(2000).select(F.col("id").alias("pos"), (F.col("id") * 7 % 90 + 1).alias("id"))
    pairs = graph.cooccurrence_edges(rows, "id", "pos", 32)
    assert pairs.rdd.getNumPartitions() == 32  # 2000 rows with at most 16 pairs each
    assert pairs.count() == rows.groupBy((F.col("pos") / 32).cast("int").alias("b")).agg(F.countDistinct("id").alias("n")).agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    assert graph.cooccurrence_edges(rows.limit(0), "id", "pos", 32).count() == 0


def test_proposals_do_not_travel(spark, plain_joins):
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 3.0), (2, 1, 3.0)], "src bigint, dst bigint, w double")
    best = graph.best_neighbor(weights)
    assert {r.v: r.u for r in best.collect()} == {0: 1, 1: 2, 2: 1}
    physical = plan_of(best).split("Physical Plan")[-1]
    assert "partial_min" in physical and physical.split("partial_min")[0].count("Exchange") == 0


def test_only_texts_go_to_the_python_workers(spark):
    model = toxicity.ToxicModel(np.zeros(toxicity.CODES**3), -1.0, 1.0, 0.0)
    docs = spark.createDataFrame([(1, "some words", "x"), (2, None, None), (3, "", "y")], "doc_id bigint, text string, `a.b` string")
    scored = toxicity.score_texts(docs, model, "text", "score")
    assert "MapInArrow" not in plan_of(scored)
    expected = 1 / (1 + np.exp(1.0))
    rows = scored.filter("score < 0.5").collect()
    assert [tuple(r)[:3] for r in rows] == [tuple(r) for r in docs.collect()]
    assert all(abs(r["score"] - expected) < 1e-12 for r in rows)
