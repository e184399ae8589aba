"""Vector tables stored in buckets of their key, which lookups, bags and updates read without moving them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.functions.vectors import vector_sum
from clickforge.operators.update import apply_sgd, overwrite_rows
from clickforge.operators.vectors import bag_sums
from clickforge.session import materialize, materialize_bucketed

HOT_SHARE = 1024  # a key with more than this part of all rows is hot; fewer than HOT_SHARE keys can be


@dataclass(frozen=True)
class VectorTable:
    """(keys..., vec) in ``buckets`` buckets; ``frame`` is the bucketed scan.

    What meets the table, (row, id) pairs or summed gradients, is dealt into its buckets; the table has no exchange in any
    plan, whatever ``spark.sql.shuffle.partitions`` says. Every update writes a new version, in the same buckets and again
    without an exchange of the table; the old version stays as it is, so a lost task can be repeated.
    """

    frame: DataFrame
    keys: tuple[str, ...]
    dim: int
    buckets: int

    @classmethod
    def create(cls, table: DataFrame, dim: int, keys: Sequence[str] = ("id",), buckets: int | None = None) -> VectorTable:
        """Store a table that is unique on its keys; one shuffle of the table, the only one it ever gets."""
        buckets = buckets or int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = table.select(*keys, "vec").repartition(buckets, *keys)
        return cls(materialize_bucketed(dealt, "vectors", keys, buckets), tuple(keys), dim, buckets)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the table's buckets; keys have the table's types, as buckets follow the hash of a type."""
        typed = rows.withColumns({k: F.col(k).cast(self.frame.schema[k].dataType) for k in self.keys})
        return typed.repartition(self.buckets, *self.keys)

    def _hot(self, rows: DataFrame) -> DataFrame:
        """The hot keys of ``rows`` with their vectors: fewer than ``HOT_SHARE`` rows."""
        counts = materialize(rows.groupBy(*self.keys).agg(F.count(F.lit(1)).alias("n")), "key-counts")
        limit = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_SHARE
        hot = counts.filter((F.col("n") > limit) & (F.lit(limit) > 0)).select(*self.keys)
        return materialize(self.frame.join(F.broadcast(hot), list(self.keys)), "hot-vectors")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """Add the vector of each key; a key that is null or unknown gets a null vector.

        Null and hot keys, which would fill one bucket's task, do not travel: hot vectors are broadcast.
        """
        keys, hot = list(self.keys), self._hot(rows)
        marked = rows.join(F.broadcast(hot.withColumnRenamed("vec", "_hot_vec")), keys, "left")
        known = F.col("_hot_vec").isNotNull()
        for k in keys:
            known = known | F.col(k).isNull()
        here = marked.filter(known).withColumnRenamed("_hot_vec", "vec")
        away = self._dealt(marked.filter(~known).drop("_hot_vec")).join(self.frame, keys, "left")
        return here.select(*rows.columns, "vec").union(away.select(*rows.columns, "vec"))

    def bags(self, rows: DataFrame, members: DataFrame, row: str = "row") -> DataFrame:
        """(row, vec): sum of the vectors of each row's keys, zero without known ones.

        Distinct keys of each block of rows go to the table, and their vectors to the block, where they are added up.
        """

        def found(asked: DataFrame) -> DataFrame:
            return self.lookup(materialize(asked, "asked")).filter(F.col("vec").isNotNull())

        return bag_sums(rows, members, self.keys, found, self.dim, row)

    def _version(self, frame: DataFrame) -> VectorTable:
        return replace(self, frame=materialize_bucketed(frame.select(*self.keys, "vec"), "vectors", self.keys, self.buckets))

    def step(self, grads: DataFrame, lr: float) -> VectorTable:
        """The next version: old - lr * summed gradient. Gradients of a key are summed before they go to its bucket."""
        summed = self._dealt(vector_sum(grads, list(self.keys), "vec", self.dim))
        return self._version(apply_sgd(self.frame, summed, self.keys, self.dim, lr, summed=True))

    def overwrite(self, rows: DataFrame) -> VectorTable:
        """The next version with the vectors of ``rows``, unique on the keys; new keys are added."""
        return self._version(overwrite_rows(self.frame, self._dealt(rows.select(*self.keys, "vec")), self.keys))
