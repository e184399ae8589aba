"""Query registry: a name, a DataFrame plan, and where possible the same result as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.functions.scalars import int_div

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The driver tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        return self.scan(name)

    @property
    def clicks(self) -> DataFrame:
        """Events as a click log; event_id is the dense row position."""
        return self.events.select(
            F.col("event_id").alias("pos"),
            "user_id",
            "event_type",
            F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
            "value",
            (F.col("event_type") == "purchase").cast("bigint").alias("label"),
        )

    def batches(self, size: int = 512, *columns: str) -> DataFrame:
        """Click rows with the mini-batch they belong to; the last one may be short."""
        rows = self.clicks
        return rows.select(
            int_div("pos", size).alias("batch"), F.pmod("pos", F.lit(size)).cast("bigint").alias("in_batch"),
            *(columns or rows.columns),
        )

    @property
    def vectors(self) -> DataFrame:
        """The embedding table as (id, vec)."""
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))

    @property
    def n_vectors(self) -> int:
        return self.embeddings.count()


def query(name: str, sql: str | None = None):
    """Register a plan ``Tables -> DataFrame`` under ``name``."""

    def register(plan: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: plan(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


# SQL fragments shared by the statements of several queries
CLICKS = """clicks as (select event_id as pos, user_id, event_type,
  cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k, value,
  cast(event_type = 'purchase' as bigint) as label from events)"""


def fixed_point_sql(vec: str) -> str:
    """Counterpart of ``fixed_point``: integers in millionths as text."""
    return (
        f"array_to_string(list_transform({vec}, "
        "lambda x: cast(cast(floor(cast(x as double) * 1000000.0::double + 0.5::double) as bigint) as varchar)), ',')"
    )
