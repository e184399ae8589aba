"""Values carried from row to row of a sorted partition, as Arrow UDFs over the iterator of its batches.

Catalyst has no expression whose value depends on the row before, other than windows, which shuffle. These functions
run inside the task that has just sorted its partition and hold one value per column between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


@dataclass(frozen=True)
class Carried:
    """One running value: ``how`` is sum, max or min; ``kind`` the type of the column."""

    how: str
    kind: T.DataType
    inclusive: bool = True

    @property
    def result(self) -> T.DataType:
        if self.how != "sum":
            return self.kind
        if isinstance(self.kind, INTEGRAL):
            return T.LongType()
        if isinstance(self.kind, T.DecimalType):
            return T.DecimalType(38, self.kind.scale)
        return T.DoubleType()


def changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """For each row, whether it differs from the row before (nulls and NaNs equal themselves); the first row of all does not."""
    n = len(column)
    if pa.types.is_nested(column.type):
        values = ([None] if before is None else before.to_pylist()) + column.to_pylist()
        differs = np.array([a != b for a, b in zip(values, values[1:])], bool)
    else:
        both = column if before is None else pa.concat_arrays([before, column])
        new, old = both.slice(1), both.slice(0, len(both) - 1)
        unlike = pc.fill_null(pc.not_equal(new, old), False)
        if pa.types.is_floating(column.type):
            unlike = pc.and_(unlike, pc.invert(pc.fill_null(pc.and_(pc.is_nan(new), pc.is_nan(old)), False)))
        unlike = pc.or_(unlike, pc.xor(new.is_null(), old.is_null()))
        differs = unlike.to_numpy(zero_copy_only=False)
        if before is None:
            differs = np.r_[False, differs] if n else differs
    if before is None and n:
        differs[0] = False
    return differs


def _whole_sums(x: np.ndarray, starts: np.ndarray, state) -> np.ndarray:
    """Running sums of 64-bit integers that begin anew at ``starts``; ends the job on overflow."""
    total = np.cumsum(x)
    if np.abs(np.cumsum(x.astype(np.float64))).max(initial=0) + abs(float(state or 0)) > 2.0**62:
        exact = 0
        for v in x.tolist():
            exact += v
            if not -(1 << 63) <= exact + (state or 0) < 1 << 63:
                raise OverflowError("a running sum leaves the range of BIGINT")
    # what had been added up before each row's own group began
    at = np.zeros(len(x), np.int64)
    at[starts] = starts
    first = np.maximum.accumulate(at)
    base = total[first] - x[first]
    base[: starts[0] if len(starts) else len(x)] = 0
    own = total - base
    own[: starts[0] if len(starts) else len(x)] += state or 0
    return own


class _Walk:
    """Running values of one column over the batches of a partition."""

    def __init__(self, carried: Carried):
        self.carried, self.state = carried, None

    def __call__(self, column: pa.Array, starts: np.ndarray) -> pa.Array:
        """Values for the rows of a batch; groups begin at ``starts``."""
        kind = self.carried.kind
        if isinstance(kind, INTEGRAL) and self.carried.how == "sum":
            x = column.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False)
            own = _whole_sums(x, starts, self.state)
            self.state = int(own[-1])
            return pa.array(own if self.carried.inclusive else own - x)
        fresh = set(starts.tolist())
        pieces, edges = [], [0, *starts.tolist(), len(column)]
        for a, b in zip(edges, edges[1:]):
            if a in fresh:
                self.state = None
            if b > a:
                pieces += self._piece(column.slice(a, b - a))
        return pa.array(pieces, pa_type(self.carried.result))

    def _piece(self, column: pa.Array) -> list:
        """A stretch of one group, from ``state`` on."""
        how, kind, values = self.carried.how, self.carried.kind, column.to_pylist()
        if isinstance(kind, FLOATING) and how == "sum" and not column.null_count:
            sums = np.cumsum(np.r_[self.state or 0.0, column.to_numpy(zero_copy_only=False).astype(np.float64)]).tolist()
            before, self.state = self.state, sums[-1]
            return sums[1:] if self.carried.inclusive else [before, *sums[1:-1]]
        combine = _COMBINE[how]
        out, state = [], self.state
        for v in values:
            after = state if v is None else v if state is None else combine(state, v)
            out.append(after if self.carried.inclusive else state)
            state = after
        self.state = state
        return out


def _largest(a, b):
    return b if b != b or b > a else a  # a NaN is larger than any number


def _smallest(a, b):
    return b if a != a or b < a else a


_COMBINE: dict[str, Callable] = {"sum": lambda a, b: a + b, "max": _largest, "min": _smallest}


def pa_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def sorted_pass(groups: int, carried: Sequence[Carried], run_keys: int = 0):
    """A UDF of (group columns, run keys, values, any filler) of sorted rows; returns a struct (v0, v1, ..., run, turn, last).

    ``v_k`` is the running value inside the row's group and partition, ``run`` how often the run keys have changed since
    the partition's first row, ``turn`` whether they changed here, ``last`` marks the partition's last row. The values start anew in every partition.
    """
    fields = [T.StructField(f"v{k}", c.result) for k, c in enumerate(carried)]
    result = T.StructType([*fields, T.StructField("run", T.LongType()), T.StructField("turn", T.BooleanType()), T.StructField("last", T.BooleanType())])

    def scan(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        walks, run, before, held = [_Walk(c) for c in carried], 0, None, None

        def packed(columns: list[pa.Array], end: bool) -> pa.Array:
            last = np.zeros(len(columns[0]), bool)
            last[-1] = end
            return pa.StructArray.from_arrays([*columns, pa.array(last)], names=[f.name for f in result.fields])

        for columns in batches:
            n = len(columns[0])
            if not n:
                yield pa.StructArray.from_arrays([pa.array([], pa_type(f.dataType)) for f in result.fields], names=[f.name for f in result.fields])
                continue
            keys, values = columns[: groups + run_keys], columns[groups + run_keys : -1]
            unlike = [changes(k, None if before is None else before[i]) for i, k in enumerate(keys)]
            starts = np.flatnonzero(np.any(unlike[:groups], axis=0)) if groups else np.zeros(0, np.int64)
            turns = np.any(unlike[groups:], axis=0) if run_keys else np.zeros(n, bool)
            runs = run + np.cumsum(turns)
            run = int(runs[-1])
            before = [k.slice(n - 1) for k in keys]
            if held is not None:
                yield packed(held, False)
            held = [*[walk(v, starts) for walk, v in zip(walks, values)], pa.array(runs.astype(np.int64)), pa.array(turns)]
        if held is not None:
            yield packed(held, True)

    return F.arrow_udf(scan, result).asNondeterministic()
