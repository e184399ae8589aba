"""Bucketed vector tables: results equal those of plain tables, and the table is never shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from clickforge.operators import update, vectors
from clickforge.operators.stores import VectorTable

DIM = 3


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, [float(i), float(i % 7), -1.0]) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows ask for one id; some ids are null or unknown."""
    rng = random.Random(2)
    ids = [9 if rng.random() < 0.5 else rng.choice([None, 1000, rng.randint(0, 299)]) for _ in range(5000)]
    return spark.createDataFrame([(i % 40, k) for i, k in enumerate(ids)], "row bigint, id bigint").repartition(5)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("buckets", [3, 8, 13])
def test_equal_to_plain_tables(spark, table, rows, buckets):
    store = VectorTable.create(table, DIM, buckets=buckets)
    assert sorted_rows(store.lookup(rows)) == sorted_rows(vectors.lookup(rows, table).select("row", "id", "vec"))
    wanted = spark.range(45).select(F.col("id").alias("row"))
    assert sorted_rows(store.bags(wanted, rows)) == sorted_rows(vectors.embedding_bag(wanted, rows, table, DIM))
    grads = rows.select(F.col("id").cast("int").alias("id"), F.array(*[F.lit(0.5)] * DIM).alias("vec"))
    stepped = store.step(grads, 0.5)
    assert sorted_rows(stepped.frame) == sorted_rows(update.apply_sgd(table, grads, ["id"], DIM, 0.5))
    fresh = spark.createDataFrame([(5, [9.0] * 3), (999, [1.0] * 3)], "id bigint, vec array<double>")
    both = stepped.overwrite(fresh)
    assert sorted_rows(both.frame) == sorted_rows(update.overwrite_rows(stepped.frame, fresh, ["id"]))
    assert both.buckets == buckets and both.lookup(rows.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [3, 13])  # fewer and more than spark.sql.shuffle.partitions
def test_the_table_has_no_exchange(spark, table, rows, buckets):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = VectorTable.create(table, DIM, buckets=buckets)
        plans = {
            "lookup": store.lookup(rows),
            "bags": store.bags(rows.select("row").distinct(), rows),
            "step": update.apply_sgd(store.frame, store._dealt(rows.select("id", F.array(*[F.lit(1.0)] * DIM).alias("vec"))), ["id"], DIM, 0.1, summed=True),
            "overwrite": update.overwrite_rows(store.frame, store._dealt(table), ["id"]),
        }
        for name, df in plans.items():
            lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "clickforge_vectors" in line]
            assert scans, name
            for i in scans:
                depth = len(lines[i]) - len(lines[i].lstrip(" :+-*()0123456789"))
                for line in reversed(lines[:i]):  # up from the scan to its join
                    own = len(line) - len(line.lstrip(" :+-*()0123456789"))
                    if own < depth:
                        depth = own
                        assert "Exchange" not in line, (name, line)
                        if "Join" in line:
                            break
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_few(table, rows):
    store = VectorTable.create(table, DIM)
    assert [r.id for r in store._hot(rows.filter("id is not null")).collect()].count(9) == 1
    assert store._hot(rows.limit(10)).count() == 0
