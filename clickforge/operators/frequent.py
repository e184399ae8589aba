"""The most frequent ids as a running state of bounded size, updated batch by batch and merged between jobs.

The state keeps at most ``size`` ids. When there are more, the count of the largest one too many is taken off all counts, and
ids that reach 0 go. So a true count is never below the kept one, and above it by at most ``error``; an id that is not
kept has been seen at most ``error`` times; and ``error`` is at most the number of lookups divided by ``size + 1``. States of
parts of the data merge to a state with the same bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.operators.ordering import index_rows, running
from clickforge.session import materialize


@dataclass(frozen=True)
class FrequentIds:
    """(id, cnt) of at most ``size`` ids; no step changes an older state, so a lost task or job can be repeated."""

    frame: DataFrame
    size: int
    error: int = 0
    total: int = 0

    @classmethod
    def empty(cls, spark: SparkSession, size: int) -> FrequentIds:
        if size < 1:
            raise ValueError("a state needs at least one place")
        return cls(spark.createDataFrame([], "id bigint, cnt bigint"), size)

    def update(self, lookups: DataFrame, id_col: str = "id") -> FrequentIds:
        """The state after one more batch of lookups; null ids are no lookups."""
        ids = lookups.select(F.col(id_col).cast("bigint").alias("id")).filter(F.col("id").isNotNull())
        fresh = materialize(ids.groupBy("id").agg(F.count(F.lit(1)).alias("cnt")), "batch-counts")
        total = fresh.agg(F.sum("cnt")).first()[0] or 0
        return self._joined(fresh, 0, total)

    def merge(self, other: FrequentIds) -> FrequentIds:
        """The state of both parts together; the smaller number of places holds."""
        smaller, larger = sorted((self, other), key=lambda s: s.size)
        return smaller._joined(larger.frame, larger.error, larger.total)

    def _joined(self, counts: DataFrame, error: int, total: int) -> FrequentIds:
        summed = materialize(self.frame.unionByName(counts).groupBy("id").agg(F.sum("cnt").alias("cnt")), "frequent")
        # place `size` of the counts in falling order, found over the distinct counts, of which there are far fewer
        steps = summed.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
        reached = running(steps, [F.col("cnt").desc()], "n", "_upto").filter(F.col("_upto") > self.size)
        cut = reached.agg(F.max("cnt")).first()[0] or 0
        kept = summed if cut == 0 else summed.select("id", (F.col("cnt") - cut).alias("cnt")).filter("cnt > 0")
        return FrequentIds(kept, self.size, self.error + error + cut, self.total + total)

    def cache(self, cache_size: int) -> DataFrame:
        """(id, low, high, slot, sure): ids to hold in a cache with bounds of their counts; ties go to the smaller id.

        ``sure`` ids are in the exact set of the ``cache_size`` most frequent ids. If as many ids are sure as the cache has
        slots, the set is exact; without error the slots are, too.
        """
        if cache_size > self.size:
            raise ValueError("the cache cannot be larger than the state")
        ranked = index_rows(self.frame, [F.col("cnt").desc(), "id"], "slot", "cache")
        ranked = materialize(ranked.filter(F.col("slot") <= cache_size), "cache")
        beyond = ranked.filter(F.col("slot") == cache_size).agg(F.max("cnt")).first()[0] or 0  # the largest outside
        sure = F.lit(True) if self.error == 0 else F.col("cnt") > beyond + self.error
        return ranked.filter(F.col("slot") < cache_size).select(
            "id", F.col("cnt").alias("low"), (F.col("cnt") + self.error).alias("high"), "slot", sure.alias("sure")
        )

    def save(self, path: str) -> None:
        """One table; every row carries the figures of the state, and a row without id stands for an empty one."""
        figures = [F.lit(v).cast("bigint").alias(n) for n, v in (("size", self.size), ("error", self.error), ("total", self.total))]
        nobody = self.frame.sparkSession.range(1).select(F.lit(None).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("cnt"))
        self.frame.unionByName(nobody).select("*", *figures).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FrequentIds:
        stored = spark.read.parquet(path)
        size, error, total = stored.filter("id is null").select("size", "error", "total").first()
        return cls(stored.filter("id is not null").select("id", "cnt"), size, error, total)
