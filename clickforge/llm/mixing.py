"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and n documents repeats each of its documents w * total / n times on
average. Each document's count is the inverse of the Poisson distribution with that mean at a uniform number
hashed from (seed, document), so it does not depend on partitions or retries. Documents are exploded by their
counts and shuffled over all partitions by a hash of (seed, document, copy).

Scale: sources are counted with partial aggregation; each source's distribution is a small array (its length
grows with the mean plus a few deviations, not with the data) joined to the documents by source, where the
optimizer picks broadcast by size and adaptive execution splits a hot source; the final shuffle is by a
hash, so partitions are even.

Cases: null sources are one source of their own; null keys and texts are hashed as null; repeated rows get the
same count; a source without weight gets none; weights are normalised over the sources given; extra columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickforge.llm.common import free_name

SEED, TEMPERATURE = 42, 0.5


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) hashed from the parts; 52 bits of an md5, which other engines can repeat."""
    digest = F.substring(F.md5(F.encode(F.concat_ws(":", *parts), "UTF-8")), 1, 13)
    return (F.conv(digest, 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, 2, ... up to a tail that no 52-bit number reaches.

    Terms are built from logarithms, so large means do not underflow.
    """
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), last), F.array(-mean),
        lambda a, k: F.concat(a, F.array(F.element_at(a, -1) + F.log(mean) - F.log(k.cast("double")))),
    )
    sums = F.aggregate(
        logs, F.array().cast("array<double>"),
        lambda a, x: F.concat(a, F.array(F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)) + F.exp(x))),
    )
    return F.when(mean > 0, sums).otherwise(F.array(F.lit(1.0)))


def target_means(docs: DataFrame, source: str, weights: dict[str | None, float] | None, temperature: float, total: int | None) -> DataFrame:
    """(source, mean): copies per document. Without weights a source's share is its count to the power
    ``temperature``; ``total`` is the wanted number of documents (default: as many as there are)."""
    sizes = docs.groupBy(F.col(f"`{source}`").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    if weights is None:
        weight = F.pow(F.col("_n").cast("double"), temperature)
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("_w", weight)
    sums = sizes.agg(F.sum("_w").alias("_all"), F.sum("_n").alias("_docs"))  # one row
    wanted = F.col("_docs").cast("double") if total is None else F.lit(float(total))
    return sizes.join(F.broadcast(sums)).select(
        "_source", F.coalesce(F.try_divide(F.col("_w"), F.col("_all")) * wanted / F.col("_n"), F.lit(0.0)).alias("_mean"))


def mix(
    docs: DataFrame, source: str = "source", key: str = "doc_id", weights: dict[str | None, float] | None = None,
    temperature: float = TEMPERATURE, total: int | None = None, seed: int = SEED, copy: str | None = None,
) -> DataFrame:
    """The documents, each as often as its count says, in a global random order over the partitions.

    ``copy`` names a column for the number of the copy (from 0); the columns are else those of ``docs``.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    own, at, from_, u, table = (free_name(docs, n) for n in ("_ident", "_copy", "_source", "_u", "_table"))
    means = target_means(docs, source, weights, temperature, total)
    means = means.select(F.col("_source").alias(from_), poisson_table(F.col("_mean")).alias(table))
    ident = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")))
    drawn = docs.withColumn(own, ident).join(means, F.col(f"`{source}`").eqNullSafe(F.col(from_)), "inner")
    drawn = drawn.withColumn(u, uniform(F.col(own), F.lit("count")))
    count = F.size(F.filter(table, lambda c: c < F.col(u)))
    copies = F.sequence(F.lit(0), count - 1)
    dealt = drawn.select(*names, own, F.explode(F.when(count > 0, copies)).alias(at))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.xxhash64(own, at)
    shuffled = dealt.repartition(parts, order).sortWithinPartitions(order)
    return shuffled.select(*names, *([F.col(at).alias(copy)] if copy else []))
