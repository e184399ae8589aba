"""Running states: the most frequent ids within their bounds, and vectors kept per id over micro-batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clickforge.operators.frequent import FrequentIds
from clickforge.operators.profile import lfu_cache_set
from clickforge.session import scratch_path
from clickforge.streaming import jobs


def lookups(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(8)
    return [[min(int(rng.paretovariate(0.7)), 400) for _ in range(1500)] + [None] * 5 for _ in range(3)]


def check_bounds(state, ids):
    true = Counter(i for i in ids if i is not None)
    kept = {r.id: r.cnt for r in state.frame.collect()}
    assert len(kept) <= state.size and state.total == sum(true.values()) and state.error <= state.total // (state.size + 1)
    assert all(kept.get(i, 0) <= n <= kept.get(i, 0) + state.error for i, n in true.items())
    return true


def test_bounds_and_sure_ids(spark, parts):
    state = FrequentIds.empty(spark, 60)
    for k, part in enumerate(parts):
        state = state.update(lookups(spark, part))
        true = check_bounds(state, sum(parts[: k + 1], []))
    assert state.error > 0
    exact = {i for i, _ in sorted(true.items(), key=lambda e: (-e[1], e[0]))[:5]}
    cache = state.cache(5).collect()
    assert sorted(r.slot for r in cache) == [0, 1, 2, 3, 4] and all(r.low <= true[r.id] <= r.high for r in cache)
    assert any(r.sure for r in cache) and {r.id for r in cache if r.sure} <= exact
    flat = FrequentIds.empty(spark, 3).update(lookups(spark, range(50)))  # nobody is frequent
    check_bounds(flat, range(50))
    assert flat.cache(3).filter("sure").count() == 0


def test_without_error_it_is_the_exact_set(spark, parts):
    state = FrequentIds.empty(spark, 1000)
    for part in parts:
        state = state.update(lookups(spark, part))
    exact = lfu_cache_set(lookups(spark, sum(parts, [])).filter("id is not null"), 30)
    got = state.cache(30)
    assert state.error == 0 and got.filter("not sure or low <> high").count() == 0
    assert {(r.id, r.low, r.slot) for r in got.collect()} == {(r.id, r.cnt, r.slot) for r in exact.collect()}


def test_merged_states_keep_the_bounds(spark, parts):
    a, b = (FrequentIds.empty(spark, n).update(lookups(spark, part)) for n, part in zip((50, 80), parts))
    merged = a.merge(b)
    check_bounds(merged, parts[0] + parts[1])
    again = b.merge(a)
    assert merged.size == again.size == 50 and merged.error == again.error
    assert sorted(merged.frame.collect()) == sorted(again.frame.collect())


def test_saved_and_empty_states(spark, parts):
    state = FrequentIds.empty(spark, 60).update(lookups(spark, parts[0]))
    for some in (state, FrequentIds.empty(spark, 7), state.update(lookups(spark, [None]))):
        path = scratch_path(spark, "state")
        some.save(path)
        back = FrequentIds.load(spark, path)
        assert (back.size, back.error, back.total) == (some.size, some.error, some.total)
        assert sorted(back.frame.collect()) == sorted(some.frame.collect())
    with pytest.raises(ValueError):
        state.cache(61)
    with pytest.raises(ValueError):
        FrequentIds.empty(spark, 0)


def run_vectors(spark, source, out, checkpoint, **options):
    stream = spark.readStream.schema("pos bigint, id bigint, vec array<double>").option("maxFilesPerTrigger", 1).parquet(source)

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    job = jobs.stream_vectors(stream, "pos", **options).writeStream.outputMode("update").foreachBatch(save)
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {(r.micro_batch, r.id): (r.vec, r.key, r.n) for r in spark.read.parquet(out).collect()}


def arrive(spark, source, rows):
    spark.createDataFrame(rows, "pos bigint, id bigint, vec array<double>").coalesce(1).write.mode("append").parquet(source)


def test_vectors_outlive_skipped_micro_batches_and_restarts(spark):
    source, out, cp = (scratch_path(spark, n) for n in ("source", "out", "cp"))
    arrive(spark, source, [(1, 7, [1.0]), (3, 7, [3.0]), (2, 7, [2.0]), (0, 9, [9.0]), (5, None, [0.0]), (6, 7, None), (8, 7, [None])])
    assert run_vectors(spark, source, out, cp) == {(0, 7): ([3.0], 3, 3), (0, 9): ([9.0], 0, 1)}
    for k in (11, 12):  # two micro-batches without id 7
        arrive(spark, source, [(k, 9, [float(k)])])
        run_vectors(spark, source, out, cp)  # a restart each
    arrive(spark, source, [(2, 7, [2.5])])  # late: the vector of key 3 stays
    done = run_vectors(spark, source, out, cp)
    assert done[(3, 7)] == ([3.0], 3, 4) and done[(2, 9)] == ([12.0], 12, 3)


def test_sums_of_vectors(spark):
    source, out, cp = (scratch_path(spark, n) for n in ("source", "out", "cp"))
    arrive(spark, source, [(1, 7, [1.0, 0.0]), (2, 7, [2.0, 1.0])])
    run_vectors(spark, source, out, cp, merge="sum")
    arrive(spark, source, [(3, 7, [4.0, 1.0])])
    assert run_vectors(spark, source, out, cp, merge="sum")[(1, 7)] == ([7.0, 2.0], 3, 3)
    with pytest.raises(ValueError):
        jobs.stream_vectors(spark.range(1), "id", merge="mean")


def test_vectors_expire(spark):
    import time

    source, out, cp = (scratch_path(spark, n) for n in ("source", "out", "cp"))
    arrive(spark, source, [(1, 7, [1.0])])
    run_vectors(spark, source, out, cp, merge="sum", expire_ms=1)
    time.sleep(0.1)
    arrive(spark, source, [(2, 9, [2.0])])  # another id; 7 times out
    run_vectors(spark, source, out, cp, merge="sum", expire_ms=1)
    arrive(spark, source, [(3, 7, [5.0])])
    done = run_vectors(spark, source, out, cp, merge="sum", expire_ms=1)
    assert done[(max(m for m, i in done if i == 7), 7)] == ([5.0], 3, 1)


@pytest.mark.parametrize("held", [5, 40, 10_000])
def test_only_the_newest_rows_of_a_task_reach_the_state(monkeypatch, held):
    import random

    import pyarrow as pa

    monkeypatch.setattr(jobs, "HELD_ROWS", held)
    rng = random.Random(2)
    rows = [{"id": rng.randint(0, 9), "_key": rng.randint(0, 30), "vec": [float(k)], "_n": 1} for k in range(300)]
    schema = pa.schema({"id": pa.int64(), "_key": pa.int64(), "vec": pa.list_(pa.float64()), "_n": pa.int64()})
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=7)
    left = [r for b in jobs._newest_in_task(iter(batches)) for r in b.to_pylist()]
    assert len(left) < 300 and (held < 10_000 or len(left) < 30)
    for i in range(10):
        mine = [r for r in rows if r["id"] == i]
        newest = max(r["_key"] for r in mine)
        assert sum(r["_n"] for r in left if r["id"] == i) == len(mine)
        assert sorted(r["vec"] for r in left if r["id"] == i and r["_key"] == newest) == sorted(r["vec"] for r in mine if r["_key"] == newest)
