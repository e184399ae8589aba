"""Functions of the user over whole mini-batches and Arrow batches; regions, counts and quotas."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clickforge.operators import batching, primitives, profile


@pytest.fixture(scope="module")
def rows(spark):
    pairs = [(p, None if p % 11 == 0 else p % 5) for p in range(1003)]
    return spark.createDataFrame(pairs, "pos bigint, x int").repartition(7)  # no partition holds a whole mini-batch


def test_whole_batches_in_order(rows):
    batches = batching.assign_batches(rows, 64, drop_last=False)

    def check(table):
        places = table.column("in_batch").to_pylist()
        assert places == list(range(len(places)))  # whole and in order
        return pa.table({"extra": ["-"], "n": [len(places)], "batch": [table.column("batch")[0].as_py()], "nulls": [table.column("x").null_count]})

    got = {r.batch: (r.n, r.nulls) for r in batching.map_batches(batches, check, "batch bigint, n int, nulls bigint").collect()}
    assert got == {b: (min(64, 1003 - 64 * b), sum(p % 11 == 0 for p in range(64 * b, min(1003, 64 * b + 64)))) for b in range(16)}


def test_tables_of_any_length(rows):
    batches = batching.assign_batches(rows, 100, drop_last=False)
    odd = batching.map_batches(batches, lambda t: t.slice(0, 0 if t.column("batch")[0].as_py() % 2 else 3).select(["pos"]), "pos bigint")
    assert sorted(r.pos for r in odd.collect()) == [100 * b + i for b in range(0, 11, 2) for i in range(3)]
    lost = batches.withColumn("batch", F.when(F.col("batch") == 1, F.col("batch")))
    assert batching.map_batches(lost, lambda t: t.select(["pos"]), "pos bigint").count() == 100
    assert batching.map_batches(batches.limit(0), lambda t: t.select(["pos"]), "pos bigint").count() == 0


def test_results_must_fit_the_schema(rows):
    batches = batching.assign_batches(rows, 500)
    with pytest.raises(Exception, match="(?i)absent|exist"):
        batching.map_batches(batches, lambda t: t.select(["x"]), "pos bigint").collect()
    with pytest.raises(Exception, match="(?i)out of bounds|overflow|not in range"):
        batching.map_batches(batches, lambda t: pa.table({"x": [300]}), "x tinyint").collect()
    with pytest.raises(TypeError):
        batching.map_batches(batches, lambda t: t, "bigint")


def test_select_where(rows):
    got = primitives.select_where(rows, lambda b: np.array([v == 2 for v in b.column("x").to_pylist()]), "pos")
    kept = [p for p in range(1003) if p % 11 and p % 5 == 2]
    assert sorted((r.pos, r.x, r.out_pos) for r in got.collect()) == [(p, 2, i) for i, p in enumerate(kept)]
    assert primitives.select_where(rows, lambda b: np.zeros(b.num_rows, dtype=bool), "pos").count() == 0
    with pytest.raises(Exception, match="predicate gave"):
        primitives.select_where(rows, lambda b: np.array([True]), "pos").collect()


def test_counts_and_regions(rows):
    assert tuple(primitives.selected_count(rows, "x = 2").first()) == (1003, sum(1 for p in range(1003) if p % 11 and p % 5 == 2))
    assert tuple(primitives.selected_count(rows.limit(0), F.col("x") == 2).first()) == (0, 0)
    inside = primitives.region(rows, "pos", 40, 3, 2, 30, 20)  # columns 30 to 39 exist
    assert sorted(r.pos for r in inside.collect()) == [40 * r + c for r in (3, 4) for c in range(30, 40)]
    assert primitives.region(rows.select((F.col("pos") - 500).alias("pos")), "pos", 10, 0, 1, 0, 10).count() == 10


def test_quota_of_an_epoch(spark):
    def quota(hot, normal, batches):
        flags = spark.createDataFrame([(True,)] * hot + [(False,)] * normal, "is_hot boolean")
        return tuple(profile.hot_batch_quota(flags, batches, epoch=True).select("normal_iters", "hot_iters").first())

    assert quota(30, 70, 10) == (7, 2)
    assert quota(0, 9, 3) == (3, 0)
    assert quota(0, 0, 3) == (None, None)
