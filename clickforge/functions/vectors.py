"""Vector columns: elementwise sums by key, combination, quantisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


WIDE = 256  # beyond this many elements one aggregate per element no longer compiles well


def vector_sum(df: DataFrame, keys: Sequence[str], vec: str, dim: int, out: str = "vec", mean: bool = False,
               wide: int = WIDE) -> DataFrame:
    """Elementwise sum (or mean) of vectors per key, in DOUBLE.

    One ordinary aggregate per element: a group is a fixed-size buffer of doubles that combines
    before the shuffle, so neither the rows multiply by ``dim`` nor does a hot key collect.
    Vectors wider than ``wide`` go through one row per element instead; their final list has ``dim``
    entries. Both forms give the same result: a null vector or element adds nothing, a key with null
    vectors only has a null vector, and a vector of another length than ``dim`` ends the job.
    """
    keys = list(keys)
    total = F.avg if mean else F.sum
    rows = df.select(*keys, checked(vec, dim).alias("_v"))
    if dim > wide:
        long = rows.select(*keys, F.posexplode_outer("_v").alias("_at", "_x"))
        cells = long.groupBy(*keys, "_at").agg(total(F.col("_x").cast("double")).alias("_x"))
        entry = F.when(F.col("_at").isNotNull(), F.struct("_at", "_x"))
        lists = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_l"), F.count("_at").alias("_n"))
        return lists.select(*keys, F.when(F.col("_n") > 0, F.col("_l._x")).alias(out))
    sums = [total(F.get(F.col("_v"), F.lit(i)).cast("double")).alias(f"_d{i}") for i in range(dim)]
    grouped = rows.groupBy(*keys).agg(*sums, F.count("_v").alias("_n"))
    return grouped.select(*keys, F.when(F.col("_n") > 0, F.array(*[f"_d{i}" for i in range(dim)])).alias(out))


def checked(vec: str, dim: int) -> Column:
    """The vector, or null; a vector of another length than ``dim`` ends the job."""
    found = F.size(vec)
    message = F.concat(F.lit(f"a vector has not {dim} elements but "), found.cast("string"))
    return F.when(F.col(vec).isNull() | (found == dim), F.col(vec)).otherwise(F.raise_error(message))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two vector columns in DOUBLE."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def add_scaled(a: Column | str, b: Column | str, factor: float) -> Column:
    """a + factor * b, elementwise in DOUBLE."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y * F.lit(float(factor)))


def fixed_point(vec: Column | str, digits: int = 6) -> Column:
    """Vector as text of integers in units of 10^-digits, for exact comparison."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    scaled = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(10**digits)) + F.lit(0.5)).cast("bigint").cast("string"))
    return F.array_join(scaled, ",")


QUANT_STEPS = 255


def quantize(vec: Column | str) -> Column:
    """Struct (lo, scale, q): per-row affine map of [min, max] to 0..255."""
    vec = F.col(vec) if isinstance(vec, str) else vec
    lo, hi = F.array_min(vec).cast("double"), F.array_max(vec).cast("double")
    scale = (hi - lo) / F.lit(float(QUANT_STEPS))
    codes = F.transform(vec, lambda x: F.when(scale == 0, F.lit(0)).otherwise(
        F.floor((x.cast("double") - lo) / F.nullif(scale, F.lit(0.0)) + F.lit(0.5)).cast("int")))
    return F.struct(lo.alias("lo"), scale.alias("scale"), codes.alias("q"))


def dequantize(packed: Column | str) -> Column:
    packed = F.col(packed) if isinstance(packed, str) else packed
    return F.transform(packed["q"], lambda c: packed["lo"] + c * packed["scale"])
