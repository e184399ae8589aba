"""Connected components of a list of links, in rounds of joins (large star, then small star).

Each round makes every vertex point to the smallest vertex it knows of, so the number of rounds is about the
logarithm of the longest chain. Every step is an aggregation or a join on hashed keys; the smallest
neighbour is found by a partial minimum, so a hub's neighbours are never gathered. Rounds are written to
the shared folder. It loops until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickforge.session import materialize


def _both(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")


def components(links: DataFrame) -> DataFrame:
    """(vertex, root) for every end of a link (a, b); root is the smallest vertex of its component."""
    links = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    while True:
        # large star: larger neighbours move to the smallest of the neighbourhood
        ways = _both(links)
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = ways.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # small star: smaller neighbours (and the vertex) move to the smallest of them; here a > b
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        small = materialize(small.distinct(), "small-star")
        # done when the links are stars: each vertex has one root, and no root has a root
        state = small.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("k")).first()
        if state["n"] == state["k"] and small.join(small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            roots = small.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("vertex"), "root").distinct())
        links = small
