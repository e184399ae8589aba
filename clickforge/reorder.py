"""Command line: communities or new numbering of a text edge list.

    clickforge-reorder EDGES OUT        writes "old new" lines        (or python -m clickforge.reorder ...)
    clickforge-reorder -c EDGES OUT     writes "vertex community" lines
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from clickforge.operators.graph import order_graph
from clickforge.sources.edges import read_edge_list


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Order a graph by communities.")
    parser.add_argument("-c", "--communities", action="store_true", help="write communities instead of the numbering")
    parser.add_argument("edges")
    parser.add_argument("out")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("reorder").getOrCreate()
    members, numbering = order_graph(read_edge_list(spark, options.edges))
    table = members if options.communities else numbering
    table.select(F.concat_ws(" ", *table.columns).alias("line")).write.mode("overwrite").text(options.out)


if __name__ == "__main__":
    main()
