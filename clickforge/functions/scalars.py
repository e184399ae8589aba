"""Scalar column expressions: parsing, id arithmetic, losses, binning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hex_to_long(c: Column | str) -> Column:
    """Hex text to BIGINT; empty, malformed or too long text becomes null."""
    c = _col(c)
    digits = F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), c)
    return F.conv(digits, 16, 10).try_cast("bigint")


def clip(c: Column | str, low=None, high=None) -> Column:
    """Limit a column to [low, high]; nulls stay null."""
    c = _col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def fill_missing(c: Column | str, value=0) -> Column:
    return F.coalesce(_col(c), F.lit(value))


def to_cold_range(c: Column | str, hot: Column | int) -> Column:
    """Ids after the hot prefix start at 1; every hot id becomes 0."""
    hot = hot if isinstance(hot, Column) else F.lit(hot)
    return F.greatest(_col(c), hot) - hot


def int_div(a: Column | str, b: int) -> Column:
    """Exact integer division; the `/` operator goes through DOUBLE and loses bits above 2^53."""
    return F.call_function("div", _col(a), F.lit(b).cast("bigint"))


def mixed_radix(c: Column | str, radices: Sequence[int]) -> list[Column]:
    """Digits of an id, most significant first, in exact integer arithmetic."""
    rest = _col(c).cast("bigint")
    digits: list[Column] = []
    for radix in reversed(radices[1:]):
        digits.append(F.pmod(rest, F.lit(radix)).cast("bigint"))
        rest = int_div(rest, radix)
    digits.append(rest)
    return digits[::-1]


def binary_cross_entropy(score: Column | str, label: Column | str) -> Column:
    """Loss of one row; each log is limited to -100 from below."""
    p, y = _col(score).cast("double"), _col(label).cast("double")

    def bounded_log(x: Column) -> Column:
        return F.when(x > 0, F.greatest(F.log(x), F.lit(-100.0))).otherwise(F.lit(-100.0))

    return -(y * bounded_log(p) + (1 - y) * bounded_log(1 - p))


def squared_error(score: Column | str, label: Column | str) -> Column:
    diff = _col(score).cast("double") - _col(label).cast("double")
    return diff * diff


def rounded_hit(score: Column | str, label: Column | str) -> Column:
    """1 when the score, rounded half to even, equals the label."""
    return (F.bround(_col(score).cast("double"), 0) == _col(label).cast("double")).cast("bigint")


def level_bin(c: Column | str, levels: Sequence[float]) -> Column:
    """0-based bin of a value among sorted levels, lower bound inclusive, upper exclusive.

    A balanced tree of comparisons: log2(levels) tests per row inside generated code.
    Values outside [first, last) and nulls give null.
    """
    c = _col(c)

    def search(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return F.lit(lo).cast("bigint")
        mid = (lo + hi) // 2
        return F.when(c < F.lit(levels[mid]), search(lo, mid)).otherwise(search(mid, hi))

    return F.when((c >= F.lit(levels[0])) & (c < F.lit(levels[-1])), search(0, len(levels) - 1))


def even_bin(c: Column | str, lower: float, upper: float, n_levels: int) -> Column:
    """0-based bin among ``n_levels - 1`` equal bins of [lower, upper); outside gives null."""
    c = _col(c).cast("double")
    bins = n_levels - 1
    inside = (c >= F.lit(float(lower))) & (c < F.lit(float(upper)))
    return F.when(inside, F.width_bucket(c, F.lit(float(lower)), F.lit(float(upper)), F.lit(bins)) - 1).cast("bigint")
