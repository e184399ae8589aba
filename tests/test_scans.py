"""One sorted pass with a carry row per partition: values, runs, borders, types, and the plan."""

import datetime
import decimal
import math
import random

import pytest
from pyspark.sql import functions as F

from clickforge.functions.scans import Carried, _Walk, changes
from clickforge.operators import primitives
from clickforge.operators.ordering import SortedPass, running


@pytest.fixture(scope="module")
def uncoalesced(spark):
    """Tiny partitions stay apart, so groups and runs cross their borders."""
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(setting, "false")
    yield spark
    spark.conf.unset(setting)


def by_hand(rows, how, inclusive, initial):
    """Running values of rows (g, o, v) sorted by (g, o), nulls first."""
    out, state, seen = [], None, object()
    combine = {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    for g, _, v in rows:
        if g != seen:
            state, seen = None, g
        after = state if v is None else v if state is None else combine(state, v)
        own = after if inclusive else state
        if how == "sum":
            own = (own or 0) + (initial or 0)
        elif initial is not None:
            own = initial if own is None else combine(own, initial)
        out.append(own)
        state = after
    return out


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(10,2)", "date", "string"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values_over_borders(uncoalesced, kind, inclusive):
    rng = random.Random(7)
    make = {
        "bigint": lambda: rng.randint(-50, 50), "double": lambda: rng.randint(-50, 50) / 4, "decimal(10,2)": lambda: decimal.Decimal(rng.randint(-500, 500)) / 100,
        "date": lambda: datetime.date(2020, 1, rng.randint(1, 31)), "string": lambda: rng.choice("abcdefgh"),
    }[kind]
    groups = [None, "hot", "hot", "hot", "hot", "a", "b", "zz"]
    rows = [(rng.choice(groups), i, None if rng.random() < 0.2 else make()) for i in range(500)]
    rng.shuffle(rows)
    df = uncoalesced.createDataFrame(rows, f"g string, o bigint, v {kind}").repartition(3)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for how in ("sum", "max", "min") if kind not in ("date", "string") else ("max", "min"):
        for initial in (None, 3) if kind == "bigint" else (None,):
            got = {r.o: r.run for r in running(df, ["o"], "v", "run", ["g"], how, inclusive, initial).collect()}
            expected = {o: v for (_, o, _), v in zip(rows, by_hand(rows, how, inclusive, initial))}
            assert got == expected, (how, initial)


def test_whole_order_without_groups(uncoalesced):
    df = uncoalesced.range(300).select((F.col("id") * 7 % 300).alias("o"), F.col("id").alias("v"))
    values = {r.o: r.v for r in df.collect()}
    got = {r.o: r.run for r in running(df, ["o"], "v", "run").collect()}
    total = 0
    for o in range(300):
        total += values[o]
        assert got[o] == total


@pytest.mark.parametrize("share", [0.02, 0.5, 0.98])
def test_runs_over_borders(uncoalesced, share):
    """Runs much longer and much shorter than a partition, with null keys."""
    rng, keys, key = random.Random(3), [], None
    for _ in range(400):
        if rng.random() < share:
            key = rng.choice([None, "x", "y", "z"])
        keys.append(key)
    df = uncoalesced.createDataFrame(list(enumerate(keys)), "pos bigint, k string").repartition(5)
    expected, at = [], 0
    for i in range(1, 401):
        if i == 400 or keys[i] != keys[at]:
            expected.append((len(expected), keys[at], at, i - at))
            at = i
    assert sorted(map(tuple, primitives.run_length_encode(df, "k", "pos").collect())) == expected
    assert sorted(map(tuple, primitives.nontrivial_runs(df, "k", "pos").collect())) == [r[2:] for r in expected if r[3] > 1]
    assert sorted(map(tuple, primitives.dedupe_consecutive(df, "k", "pos").collect())) == [(r[2], r[1]) for r in expected]
    sums = primitives.reduce_by_run(df, "k", "pos", {"s": F.sum("pos")}).collect()
    assert sorted(map(tuple, sums)) == [(n, k, sum(range(a, a + m))) for n, k, a, m in expected]


def test_empty_table_and_one_row(uncoalesced):
    none = uncoalesced.createDataFrame([], "pos bigint, k string")
    assert running(none, ["pos"], "pos", "run").count() == primitives.run_length_encode(none, "k", "pos").count() == 0
    one = uncoalesced.createDataFrame([(0, None)], "pos bigint, k string")
    assert list(map(tuple, primitives.run_length_encode(one, "k", "pos").collect())) == [(0, None, 0, 1)]


def test_stored_rows_are_not_shuffled_again(uncoalesced):
    """The rows' side of the final plan is a scan; exchanges carry one row per partition."""
    df = uncoalesced.range(2000).select("id", (F.col("id") % 3).alias("g"))
    scanned = SortedPass(df, ["id"], ["g"], {"run": ("id", "sum", True)})
    plan = scanned.rows()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text
    edges = scanned._edges().count()
    assert 1 < edges <= int(uncoalesced.conf.get("spark.sql.shuffle.partitions"))
    rows_side = text[: text.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in rows_side and "Exchange SinglePartition" not in rows_side


def test_changes_of_nulls_and_nans():
    import pyarrow as pa

    nan = math.nan
    column = pa.array([1.0, 1.0, nan, nan, None, None, 0.0, -0.0])
    assert changes(column, None).tolist() == [False, False, True, False, True, False, True, False]
    assert changes(column, pa.array([2.0]))[0] and not changes(column, pa.array([1.0]))[0]
    assert changes(pa.array([[1], [1], [2], None]), None).tolist() == [False, False, True, True]


def test_sums_that_overflow_end_the_job():
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import types as T

    walk = _Walk(Carried("sum", T.LongType()))
    with pytest.raises(OverflowError):
        walk(pa.array([2**62, 2**62, 5]), np.zeros(0, np.int64))
    fits = _Walk(Carried("sum", T.LongType()))
    assert fits(pa.array([2**62, -(2**62), None, 5]), np.array([3])).to_pylist() == [2**62, 0, 0, 5]
