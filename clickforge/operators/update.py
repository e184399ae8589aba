"""Keyed updates of vector tables: gradient aggregation, steps, upserts, factored cores."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.functions.arrow import from_matrix, to_matrix
from clickforge.functions.scalars import mixed_radix
from clickforge.functions.vectors import add_scaled, vector_sum, zero_vector
from clickforge.operators.vectors import CORE_LIMIT_BYTES, FactoredShape, _digits, known_ids, load_cores
from clickforge.session import materialize


def aggregate_gradients(grads: DataFrame, keys: Sequence[str], dim: int, vec: str = "vec") -> DataFrame:
    """One summed gradient per key."""
    return vector_sum(grads, keys, vec, dim)


def apply_sgd(table: DataFrame, grads: DataFrame, keys: Sequence[str], dim: int, lr: float, summed: bool = False) -> DataFrame:
    """New version of the table: old - lr * summed gradient; rows without gradient stay.

    ``summed`` says that ``grads`` is unique on the keys already.
    """
    own = grads.select(*keys, F.col("vec").alias("_g")) if summed else vector_sum(grads, keys, "vec", dim, out="_g")
    joined = table.join(own, list(keys), "left")
    stepped = F.coalesce(add_scaled("vec", "_g", -lr), F.col("vec").cast("array<double>"))
    return joined.withColumn("vec", stepped).drop("_g")


def overwrite_rows(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Upsert by key: new vectors replace old ones, new keys are added. ``rows`` is unique on the keys."""
    fresh = rows.select(*keys, F.col("vec").alias("_new"))
    return table.join(fresh, list(keys), "full").withColumn("vec", F.coalesce("_new", "vec")).drop("_new")


def replica_average(replicas: DataFrame, keys: Sequence[str], dim: int, vec: str = "vec", how: str = "avg") -> DataFrame:
    """Mean or sum of the values that several workers hold for the same key."""
    return vector_sum(replicas, keys, vec, dim, mean=how == "avg")


def _row_gradients(picked: Sequence[np.ndarray], grads: np.ndarray, shape: FactoredShape) -> list[np.ndarray]:
    """Chain rule for many rows: one gradient per row and core from the rows' three core vectors."""
    n = len(grads)
    a, b, c = (vec.reshape(n, *shape.edge(k)) for k, vec in enumerate(picked))
    g = grads.reshape(n, *shape.q)
    a, c = a[:, 0], c[..., 0]  # outer ranks are 1
    by_row = (
        np.einsum("nxyz,nrys,nsz->nxr", g, b, c, optimize=True),
        np.einsum("nxyz,nxr,nsz->nrys", g, a, c, optimize=True),
        np.einsum("nxyz,nxr,nrys->nsz", g, a, b, optimize=True),
    )
    return [rows.reshape(n, -1) for rows in by_row]


def _sum_by_index(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    touched, starts = np.unique(index[order], return_index=True)
    return touched, np.add.reduceat(rows[order], starts)


def _core_batch(core: int, index: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(index), core)), pa.array(index), from_matrix(rows)], names=["core", "i", "vec"]
    )


def _ids_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


CORE_ROWS = "core bigint, i bigint, vec array<double>"
FLUSH_BYTES = 32 << 20  # of sums that a task holds for one core


def _core_sums(batches: Iterator[pa.RecordBatch], pick: Callable[[pa.RecordBatch, Sequence[np.ndarray]], list[np.ndarray]],
               shape: FactoredShape, flush_bytes: int) -> Iterator[pa.RecordBatch]:
    """Sums by core index over the batches of a task, only of the core rows it touches.

    A core whose sums take more than ``flush_bytes`` is handed on and begun anew, so memory is bounded by that and a batch.
    """
    nothing = [(np.zeros(0, dtype=np.int64), np.zeros((0, shape.width(k)))) for k in range(3)]
    held = list(nothing)
    for batch in batches:
        if batch.num_rows == 0:
            continue
        digits = _digits(_ids_of(batch), shape)[1:]
        by_row = _row_gradients(pick(batch, digits), to_matrix(batch.column(1), shape.dim), shape)
        for k, rows in enumerate(by_row):
            index, sums = held[k]
            held[k] = _sum_by_index(np.concatenate([index, digits[k]]), np.concatenate([sums, rows]))
            if held[k][1].nbytes > flush_bytes:
                yield _core_batch(k, *held[k])
                held[k] = nothing[k]
    for k, (index, sums) in enumerate(held):
        if len(index):
            yield _core_batch(k, index, sums)


def _gradients_from_broadcast(grads: DataFrame, cores: DataFrame, shape: FactoredShape, flush_bytes: int) -> DataFrame:
    shared = grads.sparkSession.sparkContext.broadcast(load_cores(cores, shape))

    def pick(batch, digits):
        return [shared.value[k][digits[k]] for k in range(3)]

    return grads.mapInArrow(lambda batches: _core_sums(batches, pick, shape, flush_bytes), CORE_ROWS)


def _gradients_from_join(grads: DataFrame, cores: DataFrame, shape: FactoredShape, flush_bytes: int) -> DataFrame:
    """For cores beyond the broadcast limit: they are joined on their indices, the first core's last."""
    rows = grads.withColumns({f"_i{k}": digit for k, digit in enumerate(mixed_radix("id", shape.p))})
    for k in (2, 1, 0):
        core = cores.filter(F.col("core") == k).select(F.col("i").cast("bigint").alias(f"_i{k}"), F.col("vec").alias(f"_c{k}"))
        rows = rows.join(core, f"_i{k}", "left").withColumn(f"_c{k}", F.coalesce(f"_c{k}", zero_vector(shape.width(k))))

    def pick(batch, digits):
        return [to_matrix(batch.column(2 + k), shape.width(k)) for k in range(3)]

    picked = rows.select("id", "vec", "_c0", "_c1", "_c2")
    return picked.mapInArrow(lambda batches: _core_sums(batches, pick, shape, flush_bytes), CORE_ROWS)


def core_partials(grads: DataFrame, cores: DataFrame, shape: FactoredShape, dedup: bool = True, limit: int = CORE_LIMIT_BYTES,
                  flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """(core, i, vec): what each task adds up for the core rows it touches, before the sums over tasks.

    With ``dedup``, gradients of equal ids are added first and the sums are dealt by ranges of ids. A range is a block of
    prefixes, so neighbouring tasks share at most one row of the first core, and a task touches as many rows of the second
    as it has prefixes; only the last core is touched by all. Without ``dedup`` rows stay in their tasks.
    """
    grads = grads.filter(known_ids("id", shape) & F.col("vec").isNotNull())
    if dedup:
        grads = vector_sum(grads, ["id"], "vec", shape.dim)
    grads = grads.select(F.col("id").cast("bigint").alias("id"), "vec")
    if shape.core_bytes > limit:
        return _gradients_from_join(grads, cores, shape, flush_bytes)
    if dedup:
        grads = grads.repartitionByRange("id").sortWithinPartitions("id")
    return _gradients_from_broadcast(grads, cores, shape, flush_bytes)


def tt_core_gradients(grads: DataFrame, cores: DataFrame, shape: FactoredShape, dedup: bool = True,
                      limit: int = CORE_LIMIT_BYTES, flush_bytes: int = FLUSH_BYTES) -> DataFrame:
    """(core, i, vec): gradients of the cores from row gradients (id, vec).

    Sums form inside the tasks before the shuffle (``core_partials``); the cores
    are broadcast when their size, known from the shape, is within the limit, else joined. Both forms
    leave out null vectors and ids that are null or outside the shape; missing core rows count as zeros.
    """
    partial = materialize(core_partials(grads, cores, shape, dedup, limit, flush_bytes), "core-gradients")
    # every core has its own width, so each is summed at that width
    summed = [
        vector_sum(partial.filter(F.col("core") == k), ["core", "i"], "vec", shape.width(k)) for k in range(3)
    ]
    return summed[0].union(summed[1]).union(summed[2])


def apply_core_sgd(cores: DataFrame, grads: DataFrame, shape: FactoredShape, lr: float, dedup: bool = True) -> DataFrame:
    """New version of the cores: old - lr * gradient."""
    step = tt_core_gradients(grads, cores, shape, dedup).withColumnRenamed("vec", "_g")
    joined = cores.join(step, ["core", "i"], "left")
    stepped = F.coalesce(add_scaled("vec", "_g", -lr), F.col("vec").cast("array<double>"))
    return joined.withColumn("vec", stepped).drop("_g")
