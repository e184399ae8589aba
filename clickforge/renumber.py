"""Re-numbering of a whole training set: by frequency, and by communities for chosen fields; command line and library.

    clickforge-renumber ROWS OUT --variant kaggle_reordered --cats C1 C2 --reorder C1 --conts I1    (or python -m clickforge.renumber ...)
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.operators.batching import assign_batches
from clickforge.operators.graph import reorder_cold_ids
from clickforge.operators.ordering import index_file_rows
from clickforge.operators.profile import access_counts, apply_bijection, choose_bijection, frequency_rank, store_bijection
from clickforge.session import materialize
from clickforge.sources.tables import write_training_matrix, write_unique_csr


@dataclass(frozen=True)
class Renumbered:
    """Rows with new ids, and (field, old_id, new_id), a bijection of each field onto [0, n)."""

    rows: DataFrame
    bijection: DataFrame


def renumber(df: DataFrame, fields: Sequence[str], reorder_fields: Sequence[str] = (), pos: str = "pos",
             batch_size: int = 512, hot_share: float = 0.05) -> Renumbered:
    """Frequency ranks for all fields; ids of ``reorder_fields`` behind the hottest ``hot_share`` are then numbered by
    the communities of ids that meet in mini-batches of ``pos``. Null ids stay null and are not numbered.
    """
    ranks = frequency_rank(access_counts(df, fields))
    if not reorder_fields:
        bijection = store_bijection(ranks)
        return Renumbered(apply_bijection(df, bijection, fields), bijection)
    sizes = {r["field"]: r["n"] for r in ranks.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per field
    ranked = materialize(apply_bijection(df.select(pos, *reorder_fields), ranks, reorder_fields), "ranked")
    maps = []
    for f in reorder_fields:
        own = ranks.filter(F.col("field") == f)
        moved = reorder_cold_ids(ranked, own, f, pos, int(sizes.get(f, 0) * hot_share), batch_size)
        maps.append(moved.select(F.lit(f).alias("field"), "old_id", "new_id"))
    bijection = store_bijection(choose_bijection(ranks, reduce(DataFrame.union, maps), reorder_fields))
    return Renumbered(apply_bijection(df, bijection, fields), bijection)


def write_renumbered(df: DataFrame, out: str, variant: str, cats: Sequence[str], conts: Sequence[str], label: str,
                     reorder_fields: Sequence[str] = (), pos: str = "pos", batch_size: int = 512, hot_share: float = 0.05) -> None:
    """``out/bijection``, the re-numbered matrix ``out/<variant>`` and the distinct ids of its mini-batches, ``out/unique``."""
    done = renumber(df, cats, reorder_fields, pos, batch_size, hot_share)
    done.bijection.write.mode("overwrite").partitionBy("field").parquet(f"{out}/bijection")
    rows = materialize(done.rows, "renumbered")
    write_training_matrix(rows, out, variant, cats, conts, label, keep=[pos])
    write_unique_csr(assign_batches(rows, batch_size, pos=pos, drop_last=False), f"{out}/unique", cats)


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Re-number the ids of a training set.")
    parser.add_argument("rows", help="Parquet folder")
    parser.add_argument("out")
    parser.add_argument("--variant", required=True, help="name of the matrix")
    parser.add_argument("--cats", nargs="+", required=True)
    parser.add_argument("--reorder", nargs="*", default=[], help="fields to order by communities")
    parser.add_argument("--conts", nargs="*", default=[])
    parser.add_argument("--label", default="label")
    parser.add_argument("--pos", default="pos", help="position column; file order if there is none of this name")
    parser.add_argument("--batch-size", type=int, default=512)
    parser.add_argument("--hot-share", type=float, default=0.05)
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("renumber").getOrCreate()
    rows = spark.read.parquet(options.rows)
    if options.pos not in rows.columns:
        rows = index_file_rows(rows, options.pos)
    write_renumbered(rows, options.out, options.variant, options.cats, options.conts, options.label, options.reorder,
                     options.pos, options.batch_size, options.hot_share)


if __name__ == "__main__":
    main()
