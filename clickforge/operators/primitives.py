"""Histograms, runs, scans, reductions and sorts over rows with an explicit position."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.functions.scalars import even_bin, int_div, level_bin
from clickforge.operators.ordering import CHUNK_ROWS, SortedPass, index_rows, rank_in_group, running
from clickforge.session import materialize

FOLD_ROWS = 100_000  # partial results a task holds before it passes them on


# ---- histograms ---------------------------------------------------------------------------------


def _filled(counts: DataFrame, n_bins: int) -> DataFrame:
    """Add the empty bins."""
    return (
        counts.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
        .join(counts, "bin", "left")
        .select("bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    )


def histogram_even(df: DataFrame, value: str, lower: float, upper: float, n_levels: int) -> DataFrame:
    """(bin, cnt) over ``n_levels - 1`` equal bins, lower inclusive, upper exclusive."""
    binned = df.select(even_bin(value, lower, upper, n_levels).alias("bin")).filter("bin is not null")
    return _filled(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")), n_levels - 1)


def histogram_range(df: DataFrame, value: str, levels: Sequence[float]) -> DataFrame:
    """(bin, cnt) over bins bounded by sorted levels."""
    binned = df.select(level_bin(value, levels).alias("bin")).filter("bin is not null")
    return _filled(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("cnt")), len(levels) - 1)


def histogram_multi(df: DataFrame, levels: dict[str, Sequence[float]]) -> DataFrame:
    """(channel, bin, cnt): one histogram per column, all in one pass."""
    tagged = F.array(*[
        F.struct(F.lit(c).alias("channel"), level_bin(c, cuts).alias("bin")) for c, cuts in levels.items()
    ])
    counts = (
        df.select(F.explode(tagged).alias("e"))
        .filter("e.bin is not null")
        .groupBy("e.channel", "e.bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    spark = df.sparkSession
    bins = spark.createDataFrame(
        [(c, b) for c, cuts in levels.items() for b in range(len(cuts) - 1)], "channel string, bin bigint"
    )
    return bins.join(counts, ["channel", "bin"], "left").select("channel", "bin", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def region(df: DataFrame, pos: str, row_stride: int, first_row: int, n_rows: int, first_col: int, n_cols: int) -> DataFrame:
    """Rows inside a rectangle, where positions fill a picture ``row_stride`` wide row by row.

    Columns beyond the width and positions before 0 do not exist; the filter needs no shuffle. Histograms of the result are
    those of the region.
    """
    row, col = int_div(pos, row_stride), F.pmod(F.col(pos), F.lit(row_stride))
    return df.filter(
        (F.col(pos) >= 0) & (row >= first_row) & (row < first_row + n_rows) & (col >= first_col) & (col < first_col + n_cols)
    )


# ---- runs of equal neighbours -------------------------------------------------------------------


def _runs(df: DataFrame, key: str, pos: str) -> SortedPass:
    """Rows sorted by position, with the runs of equal keys found on the way; null keys are equal."""
    return SortedPass(df, [pos], run_keys=[key], label="runs")


def run_length_encode(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(run, key, offset, len) of maximal runs of equal neighbours; ``pos`` is a dense position.

    The rows of a run lie together, so a task sends one row for each of its runs.
    """
    numbered = _runs(df.select(pos, key), key, pos).rows(run="run")
    return numbered.groupBy("run", key).agg(F.min(pos).alias("offset"), F.count(F.lit(1)).alias("len"))


def nontrivial_runs(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(offset, len) of runs longer than one row."""
    return run_length_encode(df, key, pos).filter("len > 1").select("offset", "len")


def dedupe_consecutive(df: DataFrame, key: str, pos: str) -> DataFrame:
    """First row of each run."""
    return _runs(df, key, pos).rows(head="_head").filter("_head").drop("_head")


def reduce_by_run(df: DataFrame, key: str, pos: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregate values over runs of *neighbouring* equal keys: (run, key, aggregates...)."""
    numbered = _runs(df, key, pos).rows(run="run")
    return numbered.groupBy("run", key).agg(*[c.alias(n) for n, c in aggregates.items()])


# ---- selection ----------------------------------------------------------------------------------


def select_if(df: DataFrame, condition: Column | str, pos: str) -> DataFrame:
    """Matching rows with their new position ``out_pos``."""
    return index_rows(df.filter(condition), [pos], "out_pos", "selected")


def select_where(df: DataFrame, predicate: Callable[[pa.RecordBatch], np.ndarray], pos: str) -> DataFrame:
    """``select_if`` with a function of the user: it gets Arrow batches of rows and returns one boolean per row.

    Where the rows are cut into batches is up to the session, so the function must judge each row by itself.
    """

    def keep(batches):
        for batch in batches:
            chosen = np.asarray(predicate(batch), dtype=bool)
            if chosen.shape != (batch.num_rows,):
                raise ValueError(f"the predicate gave {chosen.shape} values for {batch.num_rows} rows")
            yield batch.filter(pa.array(chosen))

    return index_rows(df.mapInArrow(keep, df.schema), [pos], "out_pos", "selected")


def selected_count(df: DataFrame, condition: Column | str) -> DataFrame:
    """One row (n_rows, n_selected): how many rows there are and how many match; a null condition does not match."""
    matches = F.expr(condition) if isinstance(condition, str) else condition
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(matches).alias("n_selected"))


def partition_flagged(df: DataFrame, flag: str, pos: str, out: str = "out_pos") -> DataFrame:
    """Two-way split by a boolean column: flagged rows keep their order, the rest follow reversed."""
    counted = running(
        df.withColumn("_flag", F.col(flag).cast("bigint")), [pos], "_flag", "_before", inclusive=False
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    rest = total - 1 - (F.col(pos) - F.col("_before"))
    return counted.withColumn(out, F.when(F.col("_flag") == 1, F.col("_before")).otherwise(rest)).drop("_flag", "_before")


# ---- scans --------------------------------------------------------------------------------------


def prefix_sum(df: DataFrame, value: str, pos: str, inclusive: bool = True, out: str = "prefix") -> DataFrame:
    return running(df, [pos], value, out, inclusive=inclusive)


def prefix_scan(
    df: DataFrame, value: str, order_by: Sequence[Column | str], op: str | np.ufunc, out: str = "scan",
    inclusive: bool = True, initial: float | None = None,
) -> DataFrame:
    """Scan with ``"sum"``, ``"max"``, ``"min"``, or any associative binary numpy ufunc (in DOUBLE).

    A ufunc scan folds chunks of a fixed number of rows to one value each, scans these totals by
    the same rule, and then scans every chunk from the value carried in.
    """
    if isinstance(op, str):
        return running(df, order_by, value, out, how=op, inclusive=inclusive, initial=initial)
    if initial is None:
        initial = op.identity
    if initial is None:
        raise ValueError("an initial value is needed for an operator without identity")
    rows = index_rows(df.withColumn("_x", F.col(value).cast("double")), order_by, "_pos", "scan")
    return _scan_chunks(rows, op, float(initial), out, inclusive).select(*df.columns, out)


def _scan_chunks(rows: DataFrame, op: np.ufunc, initial: float, out: str, inclusive: bool) -> DataFrame:
    """Scan column ``_x`` over dense ``_pos``; chunk totals are scanned by the same function."""
    chunked = rows.withColumn("_chunk", int_div("_pos", CHUNK_ROWS))
    kept = [*rows.columns, out]

    def fold(piece: pd.DataFrame) -> pd.DataFrame:
        ordered = piece.sort_values("_pos")
        return pd.DataFrame({"_pos": ordered["_chunk"].iloc[:1], "_x": [op.reduce(ordered["_x"].to_numpy())]})

    def scan(piece: pd.DataFrame) -> pd.DataFrame:
        ordered = piece.sort_values("_pos").reset_index(drop=True)
        start = ordered["_carry"].iloc[0] if "_carry" in ordered else initial
        full = op.accumulate(np.concatenate([[start], ordered["_x"].to_numpy()]))
        return ordered.assign(**{out: full[1:] if inclusive else full[:-1]})[kept]

    last = rows.agg(F.max("_pos")).first()[0]
    if last is not None and last >= CHUNK_ROWS:
        totals = chunked.select("_chunk", "_pos", "_x").groupBy("_chunk").applyInPandas(fold, "_pos bigint, _x double")
        carry = _scan_chunks(materialize(totals, "scan"), op, initial, "_carry", inclusive=False)
        chunked = chunked.join(carry.select(F.col("_pos").alias("_chunk"), "_carry"), "_chunk")
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    return chunked.groupBy("_chunk").applyInPandas(scan, schema)


# ---- reductions ---------------------------------------------------------------------------------


def reduce_values(df: DataFrame, value: str, op: str | np.ufunc = "sum", initial=None) -> DataFrame:
    """One row (result): sum, min, max, or an associative and commutative numpy ufunc (in DOUBLE).

    A ufunc is folded once per task; the partial results, one per task, are folded again.
    """
    if isinstance(op, str):
        built_in = {"sum": F.sum, "min": F.min, "max": F.max}[op](value)
        if initial is None:
            return df.agg(built_in.alias("result"))
        start = F.lit(initial)
        total = {
            "sum": F.coalesce(built_in, F.lit(0)) + start,
            "min": F.least(built_in, start),
            "max": F.greatest(built_in, start),
        }[op]
        return df.agg(total.alias("result"))
    partial = df.select(F.col(value).cast("double").alias("x")).mapInPandas(_folder(op, None), "x double")
    # repartition, not coalesce: the first pass must keep its parallelism
    return partial.repartition(1).mapInPandas(_folder(op, initial), "x double").withColumnRenamed("x", "result")


def _folder(op: np.ufunc, initial) -> Callable:
    def fold(frames):
        total = initial
        for frame in frames:
            x = frame["x"].dropna().to_numpy()
            if len(x):
                part = op.reduce(x)
                total = part if total is None else op(total, part)
        if total is not None:
            yield pd.DataFrame({"x": [float(total)]})

    return fold


def arg_extreme(df: DataFrame, value: str, pos: str, largest: bool = False) -> DataFrame:
    """(pos, value) of the first smallest or largest value."""
    sign = F.lit(-1) if largest else F.lit(1)
    order = F.struct((F.col(value) * sign).alias("v"), F.col(pos).alias("p"))
    first = F.min(order)
    return df.agg(first.alias("m")).select(F.col("m.p").alias("pos"), (F.col("m.v") * sign).alias("value"))


def segmented_reduce(df: DataFrame, segment: str, value: str, op: str | np.ufunc = "sum", initial=0,
                     segments: DataFrame | None = None) -> DataFrame:
    """(segment, result); segments without rows give ``initial``.

    A ufunc is folded per segment inside each task first, so a hot segment reaches the final
    fold as one row per task.
    """
    if isinstance(op, str):
        built_in = {"sum": F.sum, "min": F.min, "max": F.max}[op](value)
        reduced = df.groupBy(segment).agg(built_in.alias("result"))
    else:
        kind = df.schema[segment].dataType.simpleString()
        narrow = df.select(F.col(segment).alias("seg"), F.col(value).cast("double").alias("x")).filter("x is not null")
        partial = narrow.mapInPandas(_presum(op), f"seg {kind}, x double")
        reduced = (
            partial.repartition("seg").sortWithinPartitions("seg")
            .mapInPandas(_fold_sorted(op), f"seg {kind}, x double")
            .select(F.col("seg").alias(segment), F.col("x").alias("result"))
        )
    if segments is None:
        return reduced
    return segments.select(segment).join(reduced, segment, "left").withColumn("result", F.coalesce("result", F.lit(initial)))


def _squeeze(op: np.ufunc, frame: pd.DataFrame) -> pd.DataFrame:
    """One row per segment of (seg, x), in segment order."""
    ordered = frame.sort_values("seg", kind="stable")
    starts = np.flatnonzero(~ordered["seg"].duplicated().to_numpy())
    folded = op.reduceat(ordered["x"].to_numpy(dtype=float), starts)
    return pd.DataFrame({"seg": ordered["seg"].to_numpy()[starts], "x": folded})


def _presum(op: np.ufunc) -> Callable:
    """Fold per segment inside a task, holding a bounded number of segments."""

    def fold(frames):
        held = None
        for frame in frames:
            if len(frame):
                held = _squeeze(op, frame if held is None else pd.concat([held, frame]))
                if len(held) > FOLD_ROWS:
                    yield held
                    held = None
        if held is not None:
            yield held

    return fold


def _fold_sorted(op: np.ufunc) -> Callable:
    """Fold rows that arrive sorted by segment; only the open segment is held back."""

    def fold(frames):
        open_row = None
        for frame in frames:
            if len(frame):
                folded = _squeeze(op, frame if open_row is None else pd.concat([open_row, frame]))
                open_row = folded.iloc[-1:]
                yield folded.iloc[:-1]
        if open_row is not None:
            yield open_row

    return fold


def segmented_arg(df: DataFrame, segment: str, value: str, pos: str, largest: bool = False) -> DataFrame:
    """(segment, idx, value): first extreme of each segment with its index inside the segment.

    Plain aggregation: segments are ranges of positions, so the index is a difference.
    """
    sign = F.lit(-1) if largest else F.lit(1)
    order = F.struct((F.col(value) * sign).alias("v"), F.col(pos).alias("p"))
    return (
        df.groupBy(segment)
        .agg(F.min(order).alias("m"), F.min(pos).alias("_first"))
        .select(segment, (F.col("m.p") - F.col("_first")).alias("idx"), (F.col("m.v") * sign).alias("value"))
    )


# ---- sorts --------------------------------------------------------------------------------------


def sort_rows(df: DataFrame, order_by: Sequence[Column | str], out: str = "out_pos") -> DataFrame:
    """Rows with their position in the sorted order."""
    return index_rows(df, order_by, out, "sorted")


def segmented_sort(df: DataFrame, segment: Sequence[str], order_by: Sequence[Column | str], out: str = "out_pos") -> DataFrame:
    """Rows with their position in the sorted order of their segment."""
    return rank_in_group(df, segment, order_by, out)


# ---- sparse matrix ------------------------------------------------------------------------------


def spmv(matrix: DataFrame, x: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, y): product of the sparse matrix (row, col, value) and the vector (col, x); empty rows give 0."""
    products = matrix.join(x, "col").groupBy("row").agg(F.sum(F.col("value") * F.col("x")).alias("y"))
    return rows.select("row").join(products, "row", "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
