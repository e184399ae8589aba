"""Losses, accuracy and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.functions.scalars import binary_cross_entropy, rounded_hit, squared_error


def bce_per_batch(df: DataFrame, score: str, label: str, batch: str = "batch", digits: int = 5) -> DataFrame:
    """(batch, loss): mean binary cross-entropy of each batch."""
    return df.groupBy(batch).agg(F.round(F.avg(binary_cross_entropy(score, label)), digits).alias("loss"))


def mse_per_batch(df: DataFrame, score: str, label: str, batch: str = "batch", digits: int = 6) -> DataFrame:
    """(batch, mse)."""
    return df.groupBy(batch).agg(F.round(F.avg(squared_error(score, label)), digits).alias("mse"))


def accuracy(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), batch: str | None = None) -> DataFrame:
    """(keys..., n_hit, n_rows, accuracy); with ``batch`` the last batch is left out."""
    if batch is not None:
        df = df.filter(F.col(batch) < df.agg(F.max(batch)).scalar())
    counts = df.groupBy(*keys).agg(F.sum(rounded_hit(score, label)).alias("n_hit"), F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("accuracy", F.col("n_hit") / F.col("n_rows"))


def best_epoch(scores: DataFrame, epoch: str = "epoch", value: str = "accuracy") -> DataFrame:
    """(epoch, accuracy): the best epoch, the earliest among equals."""
    return scores.agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))).alias("m")).select(
        (-F.col("m.e")).alias(epoch), F.col("m.v").alias(value)
    )


def align_curves(losses: DataFrame, models: Sequence[str], digits: int = 5) -> DataFrame:
    """One row per iteration with a column per model; iterations of the last model decide the length."""
    wide = losses.groupBy("iter").pivot("model", list(models)).agg(F.round(F.first("loss"), digits))
    return wide.filter(F.col(models[-1]).isNotNull())


def throughput_report(runs: DataFrame) -> DataFrame:
    """(setting, dataset, batch, throughput): workers * iterations / seconds over the logged runs."""
    return runs.groupBy("setting", "dataset", "batch").agg(
        (F.sum(F.col("workers") * F.col("iterations")) / F.sum("seconds")).alias("throughput")
    )
