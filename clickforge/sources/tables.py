"""Parquet datasets, training matrices, hot/cold sets, per-batch unique lists, metrics and loss series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.operators.batching import pack_features
from clickforge.operators.ordering import index_file_rows
from clickforge.operators.profile import batch_inverse, batch_sizes, batch_unique, max_unique, unique_offsets

# fixed values: the names of the saved training matrices
DATASETS = ("kaggle", "avazu", "terabyte")
VARIANTS = tuple(f"{d}{kind}" for d in DATASETS for kind in ("", "_reordered"))


def read_parquet_glob(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All ``*.parquet`` of one split."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/*.parquet")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", by_source: bool = False) -> None:
    """Write a dataset; ``by_source`` keeps one output folder per input file of the scan."""
    if by_source:
        df.select("*", F.col("_metadata.file_name").alias("source_file")).write.mode(mode).partitionBy("source_file").parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Leave an existing output alone."""
    df.write.mode("ignore").parquet(path)


def write_shuffled(df: DataFrame, path: str, key: Sequence[str], seed: int = 0, shuffle: bool = True) -> None:
    """Training output: rows shuffled inside each partition; validation output keeps their order.

    The shuffle sorts by a seeded hash of the key columns, so a retried task writes the same file.
    """
    if shuffle:
        df = df.sortWithinPartitions(F.xxhash64(*key, F.lit(seed)), *key)
    df.write.mode("overwrite").parquet(path)


def write_training_matrix(df: DataFrame, root: str, variant: str, cats: Sequence[str], conts: Sequence[str],
                          label: str, keep: Sequence[str] = ()) -> None:
    """Label, id vector and dense vector under ``root/variant``."""
    _check_variant(variant)
    packed = pack_features(df.select(*keep, F.col(label).cast("float").alias("label"), *conts, *cats), cats, conts)
    packed.write.mode("overwrite").parquet(f"{root}/{variant}")


def read_training_matrix(spark: SparkSession, root: str, variant: str) -> DataFrame:
    _check_variant(variant)
    return spark.read.parquet(f"{root}/{variant}")


def _check_variant(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"unknown training matrix {variant!r}; one of {', '.join(VARIANTS)}")


def write_hot_cold(rows: DataFrame, hot: DataFrame, path: str, is_hot: str = "is_hot") -> None:
    """Hot and normal rows in separate folders, with the hot dictionary beside them."""
    rows.write.mode("overwrite").partitionBy(is_hot).parquet(f"{path}/rows")
    hot.write.mode("overwrite").parquet(f"{path}/hot_ids")


def read_hot_cold(spark: SparkSession, path: str, is_hot: str = "is_hot") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hot rows, normal rows, hot dictionary."""
    rows = spark.read.parquet(f"{path}/rows").withColumn(is_hot, F.col(is_hot).cast("boolean"))
    return rows.filter(F.col(is_hot)), rows.filter(~F.col(is_hot)), spark.read.parquet(f"{path}/hot_ids")


def write_unique_csr(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Per batch and field: distinct ids, their offsets, each row's inverse, and the longest list per field.

    ``df`` has ``batch`` and ``in_batch``.
    """
    sizes = batch_sizes(df, fields)
    batch_unique(df, fields).write.mode("overwrite").partitionBy("field").parquet(f"{path}/unique")
    unique_offsets(sizes).write.mode("overwrite").parquet(f"{path}/offsets")
    batch_inverse(df, fields).write.mode("overwrite").partitionBy("field").parquet(f"{path}/inverse")
    max_unique(sizes).write.mode("overwrite").parquet(f"{path}/max_unique")


def read_unique_csr(spark: SparkSession, path: str, batch: int | None = None) -> dict[str, DataFrame]:
    """The four tables; with ``batch`` only that batch's slice."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("unique", "offsets", "inverse", "max_unique")}
    if batch is not None:
        for name in ("unique", "offsets", "inverse"):
            tables[name] = tables[name].filter(F.col("batch") == batch)
    return tables


METRICS = "setting string, dataset string, batch bigint, workers bigint, iterations bigint, seconds double"


def append_metrics(spark: SparkSession, path: str, rows: Sequence[tuple] | DataFrame) -> None:
    """Append the result lines of a run, or those of many runs as a table."""
    lines = rows if isinstance(rows, DataFrame) else spark.createDataFrame(list(rows), METRICS)
    lines.select(*[f.split()[0] for f in METRICS.split(", ")]).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def read_loss_series(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(model, iter, loss) from a text file with one number per line, in file order."""
    numbered = index_file_rows(spark.read.text(path), "iter")
    return numbered.select(F.lit(model).alias("model"), "iter", F.trim("value").cast("double").alias("loss"))
