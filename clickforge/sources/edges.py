"""Text edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_LINE = r"^\s*(\d{1,10})[\t, ]+(\d{1,10})\s*$"  # fixed format: two ids split by tab, comma or blank
ID_END = 1 << 32


def parse_edges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good edges (src, dst, w) and rejected lines (value). Comments and blank lines are neither."""
    useful = lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))
    ids = useful.select(
        "value",
        F.regexp_extract("value", EDGE_LINE, 1).try_cast("bigint").alias("src"),
        F.regexp_extract("value", EDGE_LINE, 2).try_cast("bigint").alias("dst"),
    )
    good = F.coalesce((F.col("src") < ID_END) & (F.col("dst") < ID_END), F.lit(False))
    return ids.filter(good).select("src", "dst", F.lit(1.0).alias("w")), ids.filter(~good).select("value")


def read_edge_list(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(src, dst, w) with weight 1; ``strict`` fails on a bad line and shows it, otherwise it is skipped."""
    lines = spark.read.text(path)
    edges, _ = parse_edges(lines)
    if not strict:
        return edges
    useful = lines.filter(~F.col("value").rlike(r"^\s*(#|$)"))

    def end(group: int):
        number = F.regexp_extract("value", EDGE_LINE, group).try_cast("bigint")
        bad = F.raise_error(F.concat(F.lit("bad edge line: "), F.col("value"))).cast("bigint")
        return F.when(number < ID_END, number).otherwise(bad)

    return useful.select(end(1).alias("src"), end(2).alias("dst"), F.lit(1.0).alias("w"))
