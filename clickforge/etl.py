"""Command line: a workflow fitted on the training days, both splits encoded, the workflow saved.

    clickforge-etl --train 'day_*' --valid day_23 OUT        (or python -m clickforge.etl ...)
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from clickforge.operators.encode import Workflow
from clickforge.sources.clicks import CLICK_CATS, CLICK_INTS, read_clicks
from clickforge.sources.tables import write_parquet, write_shuffled


def run_etl(train: DataFrame, valid: DataFrame, out: str, cats: Sequence[str], conts: Sequence[str], label: str,
            pos: str = "pos", seed: int = 0, max_size: int | None = None) -> Workflow:
    """Fit on ``train`` only; write ``out/workflow``, ``out/train`` and ``out/valid``.

    Training rows are dealt over the tasks and shuffled inside them by a seeded hash of their position, so a repeated task
    writes the same file. Validation rows keep the order of ``pos``, over the files and in each. Values that the training days
    do not have become 0.
    """
    workflow = Workflow.fit(train, cats, conts, label, max_size)
    workflow.save(f"{out}/workflow")
    write_shuffled(workflow.transform(train).repartition(pos), f"{out}/train", [pos], seed)
    ordered = workflow.transform(valid).repartitionByRange(pos).sortWithinPartitions(pos)
    write_parquet(ordered, f"{out}/valid")
    return workflow


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Encode click logs for training.")
    parser.add_argument("--train", nargs="+", required=True, help="tab-separated files or patterns of the training days")
    parser.add_argument("--valid", nargs="+", required=True, help="those of the validation days")
    parser.add_argument("--ints", type=int, default=CLICK_INTS)
    parser.add_argument("--cats", type=int, default=CLICK_CATS)
    parser.add_argument("--max-size", type=int, help="largest number of entries of a dictionary; all without")
    parser.add_argument("--seed", type=int, default=0)
    parser.add_argument("out")
    options = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("etl").getOrCreate()
    train, valid = (read_clicks(spark, paths, options.ints, options.cats, keep_order=True) for paths in (options.train, options.valid))
    cats, conts = [f"C{i}" for i in range(1, options.cats + 1)], [f"I{i}" for i in range(1, options.ints + 1)]
    run_etl(train, valid, options.out, cats, conts, "label", seed=options.seed, max_size=options.max_size)


if __name__ == "__main__":
    main()
