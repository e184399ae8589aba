"""Splits, mini-batches, row selection and feature packing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clickforge.functions.scalars import int_div
from clickforge.operators.ordering import index_rows


def _positioned(df: DataFrame, order_by: Sequence[Column | str] | None, pos: str) -> DataFrame:
    """Rows with a dense position: computed from ``order_by``, or taken as given."""
    return df if order_by is None else index_rows(df, order_by, pos)


def flag_prefix(
    df: DataFrame, frac: float, order_by=None, pos: str = "pos", out: str = "train", inclusive: bool = False
) -> DataFrame:
    """Add a boolean that is true for the first ``frac`` of the rows; ``inclusive`` makes it one row more."""
    rows = _positioned(df, order_by, pos)
    edge = F.floor(rows.agg(F.count(F.lit(1))).scalar() * F.lit(frac)).cast("bigint")
    return rows.withColumn(out, F.col(pos) <= edge if inclusive else F.col(pos) < edge)


def split_prefix(
    df: DataFrame, frac: float, order_by=None, pos: str = "pos", inclusive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """First ``frac`` of the rows, and the rest."""
    flagged = flag_prefix(df, frac, order_by, pos, "_first", inclusive)
    return flagged.filter("_first").drop("_first"), flagged.filter("not _first").drop("_first")


def split_every_nth(
    df: DataFrame, n: int = 10, order_by=None, pos: str = "pos"
) -> tuple[DataFrame, DataFrame]:
    """``n - 1`` rows to the first part, the n-th to the second, repeating."""
    rows = _positioned(df, order_by, pos)
    last = F.pmod(F.col(pos), F.lit(n)) == n - 1
    return rows.filter(~last), rows.filter(last)


def split_by_file(df: DataFrame, valid_files: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the named files form the second part, all other files the first."""
    held_out = F.col("_metadata.file_name").isin(list(valid_files))
    return df.filter(~held_out), df.filter(held_out)


def assign_batches(
    df: DataFrame,
    batch_size: int,
    order_by=None,
    pos: str = "pos",
    batch: str = "batch",
    in_batch: str = "in_batch",
    drop_last: bool = True,
    n_rows: int | None = None,
) -> DataFrame:
    """Number the mini-batches and the rows inside them; an incomplete last batch is dropped.

    ``n_rows`` saves counting the rows where their number is known.
    """
    rows = _positioned(df, order_by, pos)
    out = rows.withColumn(batch, int_div(pos, batch_size)).withColumn(
        in_batch, F.pmod(F.col(pos), F.lit(batch_size)).cast("bigint")
    )
    if not drop_last:
        return out
    full = rows.agg(int_div(F.count(F.lit(1)), batch_size)).scalar() if n_rows is None else F.lit(n_rows // batch_size)
    return out.filter(F.col(batch) < full)


def map_batches(
    df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: T.StructType | str, batch: str = "batch", order_by: str = "in_batch"
) -> DataFrame:
    """Hand every mini-batch, whole and in order, to a function of the user; its tables make up the result.

    The function gets an Arrow table with all columns of ``df`` for the rows of one batch, wherever these were read, and returns
    a table with the columns of ``schema``, in any number of rows; they are cast to its types, and a missing column or a
    value that does not fit raises an error. A call sees one batch, so memory follows the batch size, not the input. The
    function runs again for a lost task: it should give the same table for the same rows. Rows without a batch number
    belong to no batch and are left out, as they could be any number.
    """
    declared = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if not isinstance(declared, T.StructType):
        raise TypeError("the schema must name columns")
    target = to_arrow_schema(declared)

    def call(rows: pa.Table) -> pa.Table:
        out = fn(rows.sort_by(order_by))
        return out.select(target.names).cast(target)

    return df.filter(F.col(batch).isNotNull()).groupBy(batch).applyInArrow(call, declared)


def limit_batches(df: DataFrame, n: int, batch: str = "batch") -> DataFrame:
    return df.filter(F.col(batch) < n)


def rank_slice(df: DataFrame, worker: int, per_worker: int, in_batch: str = "in_batch") -> DataFrame:
    """The rows of each global batch that one worker handles."""
    return df.filter(int_div(in_batch, per_worker) == worker)


def assign_workers(df: DataFrame, per_worker: int, in_batch: str = "in_batch", out: str = "worker") -> DataFrame:
    return df.withColumn(out, int_div(in_batch, per_worker))


def select_roles(df: DataFrame, cats: Sequence[str], conts: Sequence[str], label: str) -> DataFrame:
    return df.select(label, *conts, *cats)


def pack_features(
    df: DataFrame,
    cats: Sequence[str],
    conts: Sequence[str],
    cats_out: str = "cats",
    conts_out: str = "conts",
) -> DataFrame:
    """One id vector and one dense vector per row in place of the single columns."""
    rest = [c for c in df.columns if c not in {*cats, *conts}]
    return df.select(
        *rest,
        F.array(*[F.col(c).cast("bigint") for c in cats]).alias(cats_out),
        F.array(*[F.col(c).cast("float") for c in conts]).alias(conts_out),
    )


def downsample_negatives_batch(
    df: DataFrame, label: str, batch: str = "batch", in_batch: str = "in_batch", per_positive: int = 4
) -> DataFrame:
    """Per batch: every positive row and the first ``per_positive`` negatives for each positive.

    Batches have a fixed number of rows, so the windows are bounded.
    """
    whole = Window.partitionBy(batch)
    seen = whole.orderBy(in_batch).rowsBetween(Window.unboundedPreceding, 0)
    negative = (F.col(label) == 0).cast("bigint")
    return (
        df.withColumn("_quota", F.sum(F.col(label).cast("bigint")).over(whole) * per_positive)
        .withColumn("_nth", F.sum(negative).over(seen))
        .filter((F.col(label) == 1) | ((F.col(label) == 0) & (F.col("_nth") <= F.col("_quota"))))
        .drop("_quota", "_nth")
    )


HASH_BUCKETS = 1_000_003


def undersample_negatives(df: DataFrame, label: str, key: str, keep: float) -> DataFrame:
    """All positive rows and a fixed share of the negatives, chosen by a multiplicative hash of an integer key.

    The choice depends on the key alone, so a retried task keeps the same rows.
    """
    # reduced first, so that no key overflows
    bucket = F.pmod(F.pmod(F.col(key), F.lit(HASH_BUCKETS)) * F.lit(48271), F.lit(HASH_BUCKETS))
    return df.filter((F.col(label) == 1) | (bucket < int(keep * HASH_BUCKETS)))
