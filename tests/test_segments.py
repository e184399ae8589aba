"""Segments by offset pairs against plain Python, over overlapping, nested, empty and outlying segments."""

import random

import pytest
from pyspark.sql import functions as F

from clickforge.operators.segments import FAN, BlockTree, arg_between, reduce_between, sort_between

N = 700


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    return [None if rng.random() < 0.1 else rng.randint(-50, 50) for _ in range(N)]


@pytest.fixture(scope="module")
def rows(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos bigint, x int").repartition(5)


@pytest.fixture(scope="module")
def cuts():
    rng = random.Random(5)
    some = [(rng.randint(-20, N), rng.randint(-20, N + 20)) for _ in range(150)]
    hot = [(1, N - k % 3) for k in range(100)]  # most of the slices ask for the same blocks
    return [*some, *hot, (0, N), (0, 0), (5, 5), (9, 2), (64, 128), (63, 65), (0, 64), (N - 1, N), (None, 4), (3, None), (-9, 10**12)]


@pytest.fixture(scope="module")
def segments(spark, cuts):
    return spark.createDataFrame([(k, b, e) for k, (b, e) in enumerate(cuts)], "segment bigint, begin bigint, end bigint").repartition(3)


def inside(values, begin, end):
    if begin is None or end is None:
        return []
    return [(p, values[p]) for p in range(max(0, begin), min(len(values), end))]


@pytest.mark.parametrize("fan", [4, 700, FAN])
def test_sums_and_extremes(rows, segments, values, cuts, fan):
    known = [[x for _, x in inside(values, *c) if x is not None] for c in cuts]
    wanted = {"sum": [sum(k) if k else -7 for k in known], "min": [min(k, default=-7) for k in known], "max": [max(k, default=-7) for k in known]}
    for op, expected in wanted.items():
        got = {r.segment: r.result for r in reduce_between(rows, "pos", "x", segments, op, -7, fan=fan).collect()}
        assert [got[k] for k in range(len(cuts))] == expected, op


def test_a_function_of_the_user(rows, segments, values, cuts):
    """Bitwise or, as an array fold and an aggregate."""
    def fold(items):
        return F.aggregate(items, F.lit(0), lambda a, x: a.bitwiseOR(F.coalesce(x, F.lit(0))))

    got = {r.segment: r.result for r in reduce_between(rows, "pos", "x", segments, (fold, F.bit_or), fan=8).collect()}
    for k, c in enumerate(cuts):
        expected = None
        for _, x in inside(values, *c):
            expected = (expected or 0) | (x or 0)
        assert got[k] == expected


@pytest.mark.parametrize("largest", [False, True])
def test_first_extreme(rows, segments, values, cuts, largest):
    got = {r.segment: (r.idx, r.value) for r in arg_between(rows, "pos", "x", segments, largest, fan=8).collect()}
    for k, c in enumerate(cuts):
        known = [(-x if largest else x, p) for p, x in inside(values, *c) if x is not None]
        best = min(known, default=None)
        assert got[k] == ((best[1] - c[0], values[best[1]]) if best else (None, None))


@pytest.mark.parametrize("fan", [4, FAN])
def test_sorted_segments(rows, segments, values, cuts, fan):
    got = {}
    for r in sort_between(rows, "pos", [F.col("x").desc_nulls_last()], segments, fan=fan).collect():
        got.setdefault(r.segment, []).append((r.out_pos, r.pos, r.x))
    for k, c in enumerate(cuts):
        ordered = sorted(inside(values, *c), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
        start = max(0, c[0]) if ordered else 0
        assert sorted(got.get(k, [])) == [(start + i, p, x) for i, (p, x) in enumerate(ordered)]


def test_floats_keep_their_own_precision(spark, segments):
    rows = spark.createDataFrame([(0, 1e300), (1, 0.25), (2, 0.5), (3, float("inf"))], "pos bigint, x double")
    pairs = spark.createDataFrame([(0, 1, 3), (1, 0, 1)], "segment int, begin int, end int")
    assert {r.segment: r.result for r in reduce_between(rows, "pos", "x", pairs, fan=2).collect()} == {0: 0.75, 1: 1e300}


def test_empty_tables(rows, segments, cuts):
    nothing = reduce_between(rows.limit(0), "pos", "x", segments, initial=0).collect()
    assert len(nothing) == len(cuts) and {r.result for r in nothing} == {0}
    assert reduce_between(rows, "pos", "x", segments.limit(0)).count() == 0
    assert sort_between(rows.limit(0), "pos", ["x"], segments).count() == 0
    assert {(r.idx, r.value) for r in arg_between(rows.limit(0), "pos", "x", segments).collect()} == {(None, None)}


def test_defined_errors(rows, segments):
    with pytest.raises(Exception, match="not dense"):
        reduce_between(rows.filter("pos <> 30"), "pos", "x", segments).collect()
    with pytest.raises(Exception, match="not dense"):
        reduce_between(rows.union(rows.filter("pos = 30")), "pos", "x", segments).collect()
    with pytest.raises(Exception, match="not unique"):
        reduce_between(rows, "pos", "x", segments.union(segments.filter("segment = 1"))).collect()
    with pytest.raises(ValueError, match="names of the result"):
        sort_between(rows.withColumn("segment", F.lit(1)), "pos", ["x"], segments)


def test_slices_are_few_and_the_ground_does_not_move(spark, rows, segments):
    tree = BlockTree(rows, "pos", F.col("x"), F.array_max, fan=8)
    assert tree.levels == 4
    cuts = tree.slices(segments, "segment", "begin", "end")
    assert cuts.groupBy("segment").count().agg(F.max("count")).first()[0] <= 2 * tree.levels
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tree.contents(cuts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*()0123456789"))

    scans = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "clickforge_blocks" in line]
    assert scans
    for i in scans:
        own = depth(lines[i])
        for line in reversed(lines[:i]):  # up from the scan to its join
            if depth(line) < own:
                own = depth(line)
                assert "Exchange" not in line
                if "Join" in line:
                    break


@pytest.mark.parametrize("longest", [50, 1 << 16])
def test_long_and_short_segments_are_sorted_alike(rows, segments, values, cuts, monkeypatch, longest):
    monkeypatch.setattr("clickforge.operators.segments.LONG_ROWS", longest)
    done = sort_between(rows, "pos", ["x"], segments.filter("segment % 5 = 0"), fan=64)
    assert ("_part" in done._jdf.queryExecution().executedPlan().toString()) == (longest == 50)  # short ones need no ranks over all rows
    got = {}
    for r in done.collect():
        got.setdefault(r.segment, []).append((r.out_pos, r.pos))
    for k, c in list(enumerate(cuts))[::5]:
        ordered = sorted(inside(values, *c), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        assert sorted(got.get(k, [])) == [(max(0, c[0]) + i, p) for i, (p, _) in enumerate(ordered)]
