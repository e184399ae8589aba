"""Dictionary lookups with broadcast heads and shuffled tails: equal results for any budget, nulls, hot values, and the plan."""

import random

import pytest
from pyspark.sql import functions as F

from clickforge.operators import encode, profile


@pytest.fixture(scope="module")
def table(spark):
    """Half nulls, one hot value, a long tail, a hot value that no dictionary has, and text of very different lengths."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        a = None if rng.random() < 0.5 else 7 if rng.random() < 0.5 else rng.randint(0, 900)
        b = None if rng.random() < 0.1 else "never seen" if rng.random() < 0.3 else f"t{rng.randint(0, 400)}" + "x" * rng.choice([0, 0, 300])
        rows.append((i, a, b, rng.randint(0, 3), "kept"))
    return spark.createDataFrame(rows, "k bigint, a bigint, b string, c bigint, extra string").repartition(4)


@pytest.fixture(scope="module")
def vocabulary(table):
    return encode.categorify_fit(table.filter("b <> 'never seen' or b is null"), ["a", "b", "c"])


def by_hand(table, vocabulary):
    ids = {(r.field, r.value): r.id for r in vocabulary.collect()}
    text = lambda v: None if v is None else str(v)
    return sorted((r.k, *[ids.get((f, text(r[f])), 0) for f in "abc"], r.extra) for r in table.collect())


@pytest.mark.parametrize("budget", [0, 500, 5_000, 60_000, 64 << 20])
def test_any_budget_gives_the_same_rows(table, vocabulary, budget):
    out = encode.apply_mapping(table, vocabulary, ["a", "b", "c"], default=0, head_bytes=budget)
    assert out.columns == table.columns
    assert sorted(map(tuple, out.collect())) == by_hand(table, vocabulary)


def test_heads_stay_within_the_budget(vocabulary):
    sizes = {r.field: r.n for r in vocabulary.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}
    everything = encode.head_sizes(vocabulary, ["a", "b", "c"], "value", "id", 64 << 20)
    assert everything["a"] is None and everything["c"] is None  # b has texts that are too long for a head
    heads = encode.head_sizes(vocabulary, ["a", "b", "c"], "value", "id", 10_000)
    assert heads["c"] is None and 0 < heads["a"] < sizes["a"] and 0 < heads["b"] < sizes["b"]
    entries = sum(encode._head(vocabulary, f, h, "value", "id").count() * (encode.ENTRY_BYTES + 3) for f, h in heads.items() if f != "b")
    assert entries + encode._head(vocabulary, "b", heads["b"], "value", "id").count() * (encode.ENTRY_BYTES + encode.LONG_VALUE) <= 10_000
    assert encode.head_sizes(vocabulary, ["a", "none"], "value", "id", 0) == {"a": 0, "none": 0}


def test_numbers_that_repeat_give_no_head(spark):
    mapping = spark.range(500).select(F.lit("f").alias("field"), "id", (F.col("id") % 3).alias("to"))
    assert encode.head_sizes(mapping, ["f"], "id", "to", 1000) == {"f": 0}
    rows = spark.range(700).select(F.col("id").alias("f"))
    got = encode.apply_mapping(rows, mapping, ["f"], old="id", new="to", default=-1, head_bytes=1000)
    assert sorted(r.f for r in got.collect()) == sorted(i % 3 if i < 500 else -1 for i in range(700))


def test_small_dictionaries_need_no_shuffle(table, vocabulary):
    plan = encode.apply_mapping(table, vocabulary.filter("length(value) < 200"), ["a", "b", "c"], default=0)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString() and text.count("Join LeftOuter") == 3


def test_tails_move_narrow_rows_only(spark, table, vocabulary):
    """The stored rows meet the answers without an exchange; what is shuffled has no other column of the row."""
    out = encode.apply_mapping(table, vocabulary, ["a", "b", "c"], default=0, head_bytes=500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = encode.apply_mapping(table, vocabulary, ["a", "b", "c"], default=0, head_bytes=500)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.count() == 3000 and "SortMergeJoin" in text
    exchanges = [block for block in text.split("\n") if "Exchange hashpartitioning" in block]
    assert len(exchanges) == 3 and all("_task" in e or "_old" in e for e in exchanges)  # requests, tails, answers
    last = text[: text.index("Exchange")]  # the rows' side of the last join comes first
    assert "_task" in last and "Bucketed: true" in text


def test_hot_rows_and_cache_hits_for_any_budget(spark):
    rng = random.Random(1)
    ids = [rng.choice([1, 1, 1, rng.randint(0, 200)]) for _ in range(800)]
    lookups = spark.createDataFrame(list(enumerate(ids)), "pos bigint, id bigint")
    cache = profile.lfu_cache_set(lookups, 40)
    results = [sorted(map(tuple, profile.cache_split(lookups, cache, "pos", head_bytes=b).collect())) for b in (0, 300, 1 << 20)]
    assert results[0] == results[1] == results[2]
    hits = {r.id for r in cache.collect()}
    misses = [p for p, i in enumerate(ids) if i not in hits]
    several = profile.cache_split(lookups, cache, "pos", tables=3).collect()
    assert not any(r.is_hit for r in several) and sorted(r.out_pos for r in several) == list(range(800))
    found = profile.cache_split(lookups, cache, "pos").collect()
    assert {r.pos for r in found if not r.is_hit} == set(misses)
