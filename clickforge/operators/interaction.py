"""Feature interaction and batch scoring, as Arrow-batched matrix work."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.functions.arrow import from_matrix, to_cube, to_matrix
from clickforge.operators.batching import downsample_negatives_batch

Layer = tuple[np.ndarray, np.ndarray]
WEIGHT_LIMIT_BYTES = 256 << 20


def interaction_width(fields: int, dim: int) -> int:
    return dim + (fields + 1) * fields // 2


def _pair_products(dense: np.ndarray, cube: np.ndarray, upper: bool) -> np.ndarray:
    stacked = np.concatenate([dense[:, None, :], cube], axis=1)
    gram = np.matmul(stacked, stacked.transpose(0, 2, 1))
    k = stacked.shape[1]
    rows, cols = np.triu_indices(k, 1) if upper else np.tril_indices(k, -1)
    return np.concatenate([dense, gram[:, rows, cols]], axis=1)


def pairwise_dot(df: DataFrame, dense: str, vectors: str, dim: int, out: str = "features", upper: bool = False) -> DataFrame:
    """Dense vector followed by the dot products of all pairs of (dense, field vectors...).

    Pairs i > j in row order, or i < j with ``upper``. Without field vectors only the dense part remains. A null field
    vector counts as zeros; a null dense vector or list, or another length, ends the job.
    """

    @F.arrow_udf("array<double>")
    def interact(d: pa.Array, v: pa.Array) -> pa.Array:
        return from_matrix(_pair_products(to_matrix(d, dim), to_cube(v, dim), upper))

    return df.withColumn(out, interact(F.col(dense), F.col(vectors)))


def pairwise_dot_upper(df: DataFrame, dense: str, vectors: str, dim: int, out: str = "features") -> DataFrame:
    return pairwise_dot(df, dense, vectors, dim, out, upper=True)


def concat_features(df: DataFrame, dense: str, vectors: str, out: str = "features") -> DataFrame:
    """Dense vector and field vectors side by side."""
    return df.withColumn(out, F.concat(F.col(dense), F.flatten(F.col(vectors))))


def _relu_stack(x: np.ndarray, layers: Sequence[Layer], last_linear: bool) -> np.ndarray:
    for k, (weight, bias) in enumerate(layers):
        x = x @ weight.T + bias
        if not (last_linear and k == len(layers) - 1):
            x = np.maximum(x, 0.0)
    return x


def score_batch(df: DataFrame, dense: str, vectors: str, n_dense: int, dim: int, bottom: Sequence[Layer],
                top: Sequence[Layer], out: str = "score") -> DataFrame:
    """Bottom layers on the dense columns, pairwise interaction, top layers, sigmoid.

    The weights are given (out, in) matrices of at most ``WEIGHT_LIMIT_BYTES``, which is checked before they travel to the
    tasks; the field vectors come from a lookup before, and null ones count as zeros.
    """
    size = sum(a.nbytes for layer in (*bottom, *top) for a in layer)
    if size > WEIGHT_LIMIT_BYTES:
        raise ValueError(f"weights take {size} bytes, more than {WEIGHT_LIMIT_BYTES}")
    shared = df.sparkSession.sparkContext.broadcast((list(bottom), list(top)))

    @F.arrow_udf("double")
    def score(d: pa.Array, v: pa.Array) -> pa.Array:
        bottom_layers, top_layers = shared.value
        hidden = _relu_stack(to_matrix(d, n_dense), bottom_layers, last_linear=False)
        logits = _relu_stack(_pair_products(hidden, to_cube(v, dim), upper=False), top_layers, last_linear=True)
        return pa.array(1.0 / (1.0 + np.exp(-logits[:, 0])))

    return df.withColumn(out, score(F.col(dense), F.col(vectors)))


def score_with_pick(df: DataFrame, label: str, batch: str, in_batch: str,
                    prepare: Callable[[DataFrame], DataFrame] | None = None, **scoring) -> DataFrame:
    """Score only the rows that per-batch downsampling keeps; ``prepare`` may add their vectors after the pick."""
    picked = downsample_negatives_batch(df, label, batch, in_batch)
    return score_batch(picked if prepare is None else prepare(picked), **scoring)
