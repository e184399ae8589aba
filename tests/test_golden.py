"""Small documented examples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickforge.functions.scalars import hex_to_long, mixed_radix
from clickforge.operators import batching, encode, evaluate, graph, interaction, primitives, profile, update, vectors
from clickforge.operators.ordering import index_rows
from clickforge.session import materialize


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def positioned(spark, values, kind="bigint"):
    return spark.createDataFrame(list(enumerate(values)), f"pos bigint, x {kind}")


def test_hex_to_long(spark):
    df = spark.createDataFrame([("1fbe01fe",), ("ffffffff",), ("zz",), ("12zz",), ("",), (None,)], "h string")
    assert [r[0] for r in df.select(hex_to_long("h")).collect()] == [532546046, 4294967295, None, None, None, None]


def test_mixed_radix_is_exact_above_float_range(spark):
    digits = spark.createDataFrame([(16777217,)], "id bigint").select(*mixed_radix("id", (2**25, 1, 1))).first()
    assert tuple(digits) == (16777217, 0, 0)


def test_split_prefix(spark):
    df = positioned(spark, range(10))
    first, rest = batching.split_prefix(df, 0.9)
    assert (first.count(), rest.count()) == (9, 1)
    first, rest = batching.split_prefix(df, 0.9, inclusive=True)
    assert (first.count(), rest.count()) == (10, 0)


def test_split_every_nth(spark):
    _, held = batching.split_every_nth(positioned(spark, range(20)))
    assert rows(held, "pos") == [(9,), (19,)]


def test_incomplete_last_batch_is_dropped(spark):
    out = batching.assign_batches(positioned(spark, range(11)), 4)
    assert rows(out, "pos", "batch", "in_batch") == [(i, i // 4, i % 4) for i in range(8)]
    full = batching.assign_batches(positioned(spark, range(8)), 4)
    assert full.select("batch").distinct().count() == 2


def test_downsample_negatives(spark):
    df = positioned(spark, [0, 0, 0, 0, 0, 1, 0]).withColumn("batch", F.lit(0))
    assert rows(batching.downsample_negatives_batch(df, "x", in_batch="pos"), "pos") == [(i,) for i in (0, 1, 2, 3, 5)]
    none = positioned(spark, [0, 0]).withColumn("batch", F.lit(0))
    assert batching.downsample_negatives_batch(none, "x", in_batch="pos").count() == 0


def test_accuracy_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5, 0), (1.5, 2), (0.6, 0)], "score double, label bigint")
    assert evaluate.accuracy(df, "score", "label").first()["n_hit"] == 2


def test_best_epoch_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "epoch bigint, accuracy double")
    assert tuple(evaluate.best_epoch(df).first()) == (1, 0.7)


def test_cross_entropy_is_finite_at_the_ends(spark):
    df = spark.createDataFrame([(0, 0.0, 1), (0, 1.0, 1)], "batch bigint, score double, label bigint")
    assert evaluate.bce_per_batch(df, "score", "label").first()["loss"] == 50.0


def test_histogram(spark):
    samples = [2.2, 6.0, 7.1, 2.9, 3.5, 0.3, 2.9, 2.0, 6.1, 999.5]
    df = positioned(spark, samples, "double")
    expected = list(enumerate([1, 5, 0, 3, 0, 0]))
    assert rows(primitives.histogram_even(df, "x", 0.0, 12.0, 7), "bin", "cnt") == expected
    assert rows(primitives.histogram_range(df, "x", [0.0, 2.0, 4.0, 6.0, 8.0, 10.0, 12.0]), "bin", "cnt") == expected


def test_runs(spark):
    df = positioned(spark, [0, 2, 2, 9, 5, 5, 5, 8])
    assert rows(primitives.run_length_encode(df, "x", "pos"), "run", "x", "len") == [(0, 0, 1), (1, 2, 2), (2, 9, 1), (3, 5, 3), (4, 8, 1)]
    assert rows(primitives.nontrivial_runs(df, "x", "pos"), "offset", "len") == [(1, 2), (4, 3)]
    assert [r["x"] for r in primitives.dedupe_consecutive(df, "x", "pos").orderBy("pos").collect()] == [0, 2, 9, 5, 8]


def test_partition_keeps_selected_order_and_reverses_the_rest(spark):
    flags = [1, 0, 0, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([(i, i + 1, bool(f)) for i, f in enumerate(flags)], "pos bigint, x bigint, flag boolean")
    out = primitives.partition_flagged(df, "flag", "pos").orderBy("out_pos")
    assert [r["x"] for r in out.collect()] == [1, 4, 6, 7, 8, 5, 3, 2]
    df = positioned(spark, [0, 2, 3, 9, 5, 2, 81, 8]).withColumn("flag", F.col("x") < 7)
    out = primitives.partition_flagged(df, "flag", "pos").orderBy("out_pos")
    assert [r["x"] for r in out.collect()] == [0, 2, 3, 5, 2, 8, 81, 9]


def test_arg_min(spark):
    assert tuple(primitives.arg_extreme(positioned(spark, [8, 6, 7, 5, 3, 0, 9]), "x", "pos").first()) == (5, 0)


def test_reduce_and_segments(spark):
    df = spark.createDataFrame([(0, 3.0), (0, 4.0), (2, 5.0)], "seg bigint, x double")
    segments = spark.range(3).withColumnRenamed("id", "seg")
    for op in ("sum", np.add):
        assert rows(primitives.segmented_reduce(df, "seg", "x", op, 0.0, segments), "seg", "result") == [(0, 7.0), (1, 0.0), (2, 5.0)]
    assert primitives.reduce_values(df, "x", np.multiply, initial=2.0).first()[0] == 120.0
    assert primitives.reduce_values(df, "x", "min", initial=1.0).first()[0] == 1.0


def test_spmv_of_a_lattice(spark):
    cells = [(r, c) for r in range(3) for c in range(3)]
    entries = [(a[0] * 3 + a[1], b[0] * 3 + b[1], 1.0) for a in cells for b in cells if abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1]
    matrix = spark.createDataFrame(entries, "row bigint, col bigint, value double")
    x = spark.range(9).select(F.col("id").alias("col"), F.lit(1.0).alias("x"))
    y = primitives.spmv(matrix, x, spark.range(10).withColumnRenamed("id", "row"))
    assert [r["y"] for r in y.orderBy("row").collect()] == [2, 3, 2, 3, 4, 3, 2, 3, 2, 0]


def test_edge_weights_and_pairs(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 2)], "src bigint, dst bigint")
    assert rows(graph.edge_weights(edges), "src", "dst", "w") == [(0, 1, 2.0), (1, 0, 2.0)]
    ids = positioned(spark, [3, 0, 1, 4, 3])
    assert rows(graph.cooccurrence_edges(ids, "x", "pos", 512), "src", "dst") == [(1, 3), (1, 4), (3, 4)]


def test_interaction_width():
    assert [interaction.interaction_width(f, d) for f, d in ((20, 16), (26, 16), (26, 64))] == [226, 367, 415]


def test_interaction_without_fields_is_the_dense_part(spark):
    df = spark.createDataFrame([([1.0, 2.0], [])], "d array<double>, v array<array<double>>")
    assert interaction.pairwise_dot_upper(df, "d", "v", 2).first()["features"] == [1.0, 2.0]


def test_bags_of_a_jagged_batch(spark):
    bags = spark.createDataFrame([(0, [0, 1]), (1, []), (2, [2]), (3, None)], "row bigint, ids array<bigint>")
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "id bigint, vec array<double>")
    out = vectors.embedding_bag_lists(bags, "ids", table, 2)
    assert rows(out, "row", "vec") == [(0, [1.0, 2.0]), (1, [0.0, 0.0]), (2, [2.0, 1.0]), (3, [0.0, 0.0])]


def test_offsets(spark):
    lists = spark.createDataFrame([(0, [0, 1]), (1, []), (2, [2]), (3, [3]), (4, [4]), (5, [5, 6, 7])], "k bigint, ids array<bigint>")
    offsets = vectors.lengths_to_offsets(lists, ["k"], "ids")
    assert [(r["lo"], r["hi"]) for r in offsets.orderBy("k").collect()] == [(0, 2), (2, 2), (2, 3), (3, 4), (4, 5), (5, 8)]
    values = spark.range(8).select(F.col("id").alias("pos"), F.col("id").alias("v"))
    owned = vectors.offsets_to_rows(values, offsets.select("k", "lo"), 3)
    assert rows(owned, "v", "row", "table") == [(0, 0, 0), (1, 0, 0), (2, 2, 0), (3, 0, 1), (4, 1, 1), (5, 2, 1), (6, 2, 1), (7, 2, 1)]


def test_unknown_and_capped_values_get_id_zero(spark):
    df = spark.createDataFrame([(v,) for v in [5, 5, 7, 7, 7, 9, None]], "c bigint")
    vocabulary = encode.categorify_fit(df, ["c"], max_size=3)
    assert rows(vocabulary, "value", "id", "cnt") == [(5, 2, 2), (7, 1, 3)]
    out = encode.categorify_apply(df, vocabulary, ["c"])
    assert sorted(r["c"] for r in out.collect()) == [0, 0, 1, 1, 1, 2, 2]


def test_rank_encoding_equals_counting_the_encoded_rows(spark):
    values = [5, 5, 5, 7, 7, 9, 11, 13, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "pos bigint, c bigint")
    vocabulary = encode.categorify_fit(df, ["c"], max_size=3)
    mapping, unknown = profile.rank_encoding(vocabulary, df.count())
    fast = encode.apply_mapping(df, mapping, ["c"], new="new_id", default=unknown)
    encoded = encode.categorify_apply(df, vocabulary, ["c"])
    slow = profile.apply_bijection(encoded, profile.frequency_rank(profile.access_counts(encoded, ["c"])), ["c"])
    assert rows(fast, "pos", "c") == rows(slow, "pos", "c")


def test_zero_std_only_centres(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double").fillna(3.0)
    moments = encode.normalize_fit(df, ["x"])
    assert {r["x"] for r in encode.normalize_apply(df, moments, ["x"]).collect()} == {0.0}


def test_warm_up_makes_every_lookup_a_miss(spark):
    df = positioned(spark, [1, 2, 1]).withColumnRenamed("x", "id")
    cache = profile.lfu_cache_set(df, 1)
    cold = profile.cache_split(df, cache, "pos", warm_up=True)
    assert rows(cold, "out_pos", "id", "is_hit") == [(0, 1, False), (1, 2, False), (2, 1, False)]


def test_empty_input_has_no_positions(spark):
    empty = spark.createDataFrame([], "pos bigint, x bigint")
    assert index_rows(empty.drop("pos"), ["x"]).count() == 0
    assert encode.categorify_fit(empty, ["x"]).count() == 0


SHAPE = vectors.FactoredShape(p=(3, 2, 4), q=(2, 2, 3), r=(2, 3))


@pytest.fixture(scope="module")
def cores(spark):
    rng = np.random.default_rng(1)
    return spark.createDataFrame(
        [(k, i, [float(x) for x in rng.integers(-3, 4, SHAPE.width(k))]) for k in range(3) for i in range(SHAPE.p[k])],
        "core bigint, i bigint, vec array<double>")


def _dense_table(cores):
    parts = vectors.load_cores(cores, SHAPE)
    a, b, c = (parts[k].reshape(SHAPE.p[k], *SHAPE.edge(k)) for k in range(3))
    return np.einsum("iaxr,jrys,kszb->ijkxyz", a, b, c).reshape(SHAPE.rows, SHAPE.dim)


def test_factored_lookup_equals_the_dense_table(spark, cores):
    dense = _dense_table(cores)
    whole = vectors.tt_materialize(spark, cores, SHAPE).orderBy("id").collect()
    assert np.array_equal(np.array([r["vec"] for r in whole]), dense)
    ids = spark.createDataFrame([(i,) for i in [5, 5, 23, 0]], "id bigint")
    joined = vectors.tt_lookup_join(ids, "id", cores, SHAPE).collect()
    assert len(joined) == 4 and all(np.array_equal(r["vec"], dense[r["id"]]) for r in joined)


def test_core_gradients_equal_numeric_ones(spark, cores):
    rng = np.random.default_rng(2)
    ids = [1, 1, 7, 22, 7]
    grads = rng.integers(-2, 3, (len(ids), SHAPE.dim)).astype(float)
    frame = spark.createDataFrame([(i, [float(x) for x in g]) for i, g in zip(ids, grads)], "id bigint, vec array<double>")
    parts = vectors.load_cores(cores, SHAPE)

    def loss(arrays):
        return float((vectors.factored_vectors(np.array(ids), arrays, SHAPE) * grads).sum())

    found = {(r["core"], r["i"]): r["vec"] for r in update.tt_core_gradients(frame, cores, SHAPE).collect()}
    joined = {(r["core"], r["i"]): r["vec"] for r in update.tt_core_gradients(frame, cores, SHAPE, limit=0).collect()}
    assert joined == found
    for k in range(3):
        for i in range(SHAPE.p[k]):
            numeric = []
            for at in range(SHAPE.width(k)):
                moved = [p.copy() for p in parts]
                moved[k][i, at] += 1.0
                numeric.append(loss(moved) - loss(parts))  # the table is linear in each core
            assert np.allclose(found.get((k, i), np.zeros(SHAPE.width(k))), numeric)
    stepped = update.apply_core_sgd(cores, frame, SHAPE, lr=0.5)
    before = {(r["core"], r["i"]): r["vec"] for r in cores.collect()}
    for r in stepped.collect():
        key = (r["core"], r["i"])
        step = np.array(found.get(key, np.zeros(len(before[key]))))
        assert np.allclose(r["vec"], np.array(before[key]) - 0.5 * step)


def test_wide_vectors_sum_like_narrow_ones(spark):
    from clickforge.functions.vectors import vector_sum

    df = spark.createDataFrame([(k % 2, [float(k + i) for i in range(300)]) for k in range(4)], "id bigint, vec array<double>")
    out = {r["id"]: r["vec"] for r in vector_sum(df, ["id"], "vec", 300).collect()}
    assert out == {0: [2.0 + 2 * i for i in range(300)], 1: [4.0 + 2 * i for i in range(300)]}


def test_circle_of_parents_is_an_error(spark):
    for ring in (2, 3, 4, 5):
        pointers = spark.createDataFrame([(v, (v + 1) % ring) for v in range(ring)] + [(9, 9), (10, 9)], "v bigint, parent bigint")
        with pytest.raises(ValueError, match="circle"):
            graph.trace_community(pointers)


def test_large_keys_and_malformed_values(spark):
    keys = spark.createDataFrame([(2**60, 0), (-(2**62), 1), (None, 0)], "k bigint, label bigint")
    assert {r["k"] for r in batching.undersample_negatives(keys, "label", "k", 1.0).collect()} == {2**60, -(2**62)}
    mapping = spark.createDataFrame([("f", 1, 7)], "field string, value bigint, id bigint")
    texts = spark.createDataFrame([("1",), ("x",), (None,)], "f string")
    assert sorted(r["f"] for r in encode.categorify_apply(texts, mapping, ["f"]).collect()) == [0, 0, 7]


def test_vector_sums_do_not_depend_on_the_form(spark):
    from clickforge.functions.vectors import vector_sum

    rows = [(1, [1.0, 2.0, 3.0]), (1, None), (1, [1.0, None, 3.0]), (2, None), (3, [None, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id bigint, vec array<double>")
    for mean in (False, True):
        narrow, wide = ({r["id"]: r["vec"] for r in vector_sum(df, ["id"], "vec", 3, mean=mean, wide=w).collect()} for w in (8, 0))
        assert narrow == wide and narrow[2] is None and narrow[3] == [None, 1.0, 1.0]
    for bad in ([1.0, 2.0], [1.0] * 4):
        more = df.union(spark.createDataFrame([(1, bad)], df.schema))
        for w in (8, 0):
            with pytest.raises(Exception, match="has not 3 elements"):
                vector_sum(more, ["id"], "vec", 3, wide=w).collect()


def test_factored_forms_agree_on_odd_ids_and_missing_cores(spark, cores):
    kept = cores.filter("not (core = 1 and i = 1)").union(spark.createDataFrame([(0, 99, [1.0])], cores.schema))
    ids = [None, -1, -30, SHAPE.rows, 0, 5, SHAPE.rows - 1, 5]
    frame = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "k int, id bigint")
    near, far = ({r["k"]: r["vec"] for r in vectors.tt_lookup(frame, "id", kept, SHAPE, limit=n).collect()} for n in (1 << 20, 0))
    assert near == far and sorted(near) == list(range(len(ids)))
    assert all(near[k] is None for k in range(4)) and all(near[k] is not None for k in range(4, len(ids)))
    grads = spark.createDataFrame(
        [(i, None if k == 4 else [float(k + j) for j in range(SHAPE.dim)]) for k, i in enumerate(ids)], "id bigint, vec array<double>")
    for dedup in (True, False):
        near, far = ({(r["core"], r["i"]): r["vec"] for r in update.tt_core_gradients(grads, kept, SHAPE, dedup, limit=n).collect()}
                     for n in (1 << 20, 0))
        assert near == far and near


def test_core_gradients_by_block(spark, cores):
    ids = list(range(SHAPE.rows)) * 3 + [5] * 200  # one id has most of the rows
    grads = spark.createDataFrame([(i, [float((i + k + j) % 5 - 2) for j in range(SHAPE.dim)]) for k, i in enumerate(ids)],
                                  "id bigint, vec array<double>").repartition(6)

    def summed(**how):
        return {(r["core"], r["i"]): r["vec"] for r in update.tt_core_gradients(grads, cores, SHAPE, **how).collect()}

    whole = summed()
    assert len(whole) == sum(SHAPE.p)
    for how in ({"flush_bytes": 0}, {"flush_bytes": 0, "limit": 0}, {"dedup": False}, {"dedup": False, "flush_bytes": 100}):
        assert summed(**how) == whole
    # id ranges share at most one row of the first core between neighbours
    partials = materialize(update.core_partials(grads, cores, SHAPE).withColumn("task", F.spark_partition_id()), "partials")
    tasks = partials.select("task").distinct().count()
    assert partials.filter("core = 0").count() <= SHAPE.p[0] + tasks - 1
    assert partials.groupBy("task", "core", "i").count().filter("count > 1").count() == 0


def test_lookup_keeps_rows_with_unknown_ids(spark):
    table = spark.createDataFrame([(1, [1.0])], "id bigint, vec array<double>")
    rows = spark.createDataFrame([(0, 1), (1, 7), (2, None)], "row int, id bigint")
    assert {r["row"]: r["vec"] for r in vectors.lookup(rows, table).collect()} == {0: [1.0], 1: None, 2: None}
    assert {r["row"]: r["vec"] for r in vectors.embedding_bag(rows, rows, table, 1).collect()} == {0: [1.0], 1: [0.0], 2: [0.0]}
