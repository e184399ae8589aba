"""Generated click batches, power-law ids and fresh embedding tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UNIT = float(1 << 53)


def uniform(key: Sequence[Column | str], seed: int) -> Column:
    """Number in [0, 1) from a seeded hash of the key: the same on every run and retry."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11)
    return bits.cast("double") / F.lit(_UNIT)


def synthetic_uniform(spark: SparkSession, n: int, table_sizes: Sequence[int], n_dense: int, seed: int = 0) -> DataFrame:
    """(pos, label, conts, cats): label 0 or 1, dense in [0, 1), ids uniform in each table."""
    rows = spark.range(n).withColumnRenamed("id", "pos")
    label = (uniform(["pos"], seed) < 0.5).cast("int")
    conts = F.array(*[uniform(["pos"], seed + 1 + i).cast("float") for i in range(n_dense)])
    cats = F.array(*[
        F.floor(uniform(["pos"], seed + 1 + n_dense + j) * size).cast("bigint") for j, size in enumerate(table_sizes)
    ])
    return rows.select("pos", label.alias("label"), conts.alias("conts"), cats.alias("cats"))


def power_law_id(u: Column, size: int, exponent: float) -> Column:
    """Inverse distribution function of a truncated power law on [1, size + 1), as ids from 0."""
    if exponent == 1.0:
        x = F.exp(u * F.log(F.lit(float(size + 1))))
    else:
        a = 1.0 - exponent
        x = F.pow(F.lit(1.0) + u * F.lit((size + 1) ** a - 1.0), F.lit(1.0 / a))
    return F.least(F.floor(x).cast("bigint") - 1, F.lit(size - 1).cast("bigint"))


def synthetic_power_law(spark: SparkSession, n: int, size: int, exponent: float = 1.2, seed: int = 0) -> DataFrame:
    """(pos, label, I1, C1) with power-law ids in one table."""
    rows = spark.range(n).withColumnRenamed("id", "pos")
    return rows.select(
        "pos",
        (uniform(["pos"], seed) < 0.5).cast("float").alias("label"),
        uniform(["pos"], seed + 1).cast("float").alias("I1"),
        power_law_id(uniform(["pos"], seed + 2), size, exponent).alias("C1"),
    )


def write_power_law(spark: SparkSession, path: str, n_train: int, n_eval: int, size: int,
                    exponent: float = 1.2, files: int = 4, seed: int = 0) -> None:
    """Train and eval folders with ``files`` Parquet files each."""
    for name, n, s in (("train", n_train, seed), ("eval", n_eval, seed + 100)):
        rows = synthetic_power_law(spark, n, size, exponent, s)
        rows.repartition(files, "pos").write.mode("overwrite").parquet(f"{path}/{name}")


def embedding_init(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """(id, vec): a fresh table, uniform in +-sqrt(1 / n)."""
    bound = (1.0 / n) ** 0.5
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: ((uniform([F.col("id"), i], seed) * 2 - 1) * F.lit(bound)).cast("float"),
    )
    return spark.range(n).select("id", cells.alias("vec"))
