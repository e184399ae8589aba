"""Raw click and ad logs as typed DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickforge.functions.scalars import hex_to_long
from clickforge.operators.ordering import index_file_rows

CLICK_INTS, CLICK_CATS = 13, 26
AD_CATS = 20
AD_HEX = range(2, 11)  # C2..C10 hold hex text, the other C columns integers


def click_schema(n_ints: int = CLICK_INTS, n_cats: int = CLICK_CATS) -> T.StructType:
    return T.StructType(
        [T.StructField("label", T.IntegerType())]
        + [T.StructField(f"I{i}", T.IntegerType()) for i in range(1, n_ints + 1)]
        + [T.StructField(f"C{i}", T.StringType()) for i in range(1, n_cats + 1)]
    )


def read_clicks(spark: SparkSession, paths: str | Sequence[str], n_ints: int = CLICK_INTS, n_cats: int = CLICK_CATS,
                keep_order: bool = False) -> DataFrame:
    """Headerless tab-separated click files: label, I1.., C1.. with hex ids as BIGINT; empty fields are null.

    ``keep_order`` adds ``pos``, the position of each row in file order.
    """
    raw = spark.read.schema(click_schema(n_ints, n_cats)).csv(paths if isinstance(paths, str) else list(paths), sep="\t")
    order: list[str] = []
    if keep_order:
        raw, order = index_file_rows(raw), ["pos"]
    return raw.select(
        "label", *[f"I{i}" for i in range(1, n_ints + 1)],
        *[hex_to_long(f"C{i}").alias(f"C{i}") for i in range(1, n_cats + 1)], *order,
    )


def read_ad_log(spark: SparkSession, paths: str | Sequence[str], keep_order: bool = False) -> DataFrame:
    """Ad log with a header line: the row id is dropped and YYMMDDHH becomes day (I1) and hour (I2).

    Result: label, I1, I2, I3, C1..C20. Text after a blank is cut off in every field.
    """
    names = ["row_id", "label", "stamp", "I3", *[f"C{i}" for i in range(1, AD_CATS + 1)]]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).csv(paths if isinstance(paths, str) else list(paths), header=True, enforceSchema=True)
    order: list[str] = []
    if keep_order:
        raw, order = index_file_rows(raw), ["pos"]

    def text(c: str):
        return F.substring_index(F.col(c), " ", 1)

    def whole(c):
        return c.try_cast("int")

    def category(i: int):
        c = text(f"C{i}")
        return (hex_to_long(c) if i in AD_HEX else c.try_cast("bigint")).alias(f"C{i}")

    return raw.select(
        whole(text("label")).alias("label"),
        whole(F.substring(text("stamp"), 5, 2)).alias("I1"),
        whole(F.substring(text("stamp"), 7, 2)).alias("I2"),
        whole(text("I3")).alias("I3"),
        *[category(i) for i in range(1, AD_CATS + 1)], *order,
    )
