"""Whole runs and their command lines."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clickforge import etl, renumber
from clickforge.operators.encode import Workflow


def _logs(folder):
    """Two training days and a validation day with a value that training has not."""
    for day, ids in (("day_0", [5, 5, 9, 5]), ("day_1", [9, 7, 5, 9]), ("day_2", [7, 11, 5, None, 9, 9, 7])):
        lines = [f"{k % 2}\t{k}\t{'' if i is None else format(i, 'x')}\t{k % 3:x}" for k, i in enumerate(ids)]
        (folder / day).write_text("\n".join(lines) + "\n")


def test_etl_fits_on_training_days_only(spark, tmp_path):
    _logs(tmp_path)
    out = str(tmp_path / "out")
    etl.main(["--train", f"{tmp_path}/day_0", f"{tmp_path}/day_1", "--valid", f"{tmp_path}/day_2", "--ints", "1", "--cats", "2", out])
    assert spark.read.parquet(f"{out}/train").count() == 8
    files = sorted(Path(out, "valid").glob("part-*.parquet"))
    ordered = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [r["pos"] for r in ordered] == list(range(7))
    # 5 is the most frequent training value, then 9, then 7; 11 and null are unknown
    assert [r["C1"] for r in ordered] == [3, 0, 1, 0, 2, 2, 3]
    again = Workflow.load(spark, f"{out}/workflow").transform(spark.createDataFrame([(0, 9, 0, 1)], "I1 int, C1 long, C2 long, label int"))
    assert again.first()["C1"] == 2
    first = [tuple(r) for r in spark.read.parquet(f"{out}/train").orderBy("pos").collect()]
    etl.main(["--train", f"{tmp_path}/day_0", f"{tmp_path}/day_1", "--valid", f"{tmp_path}/day_2", "--ints", "1", "--cats", "2", out])
    assert first == [tuple(r) for r in spark.read.parquet(f"{out}/train").orderBy("pos").collect()]


def test_renumbering_is_a_bijection_of_every_field(spark, tmp_path):
    rows = spark.createDataFrame([(p, [1, 2, 3, 8, 8, 9, None][p % 7], p % 5, p % 2, float(p)) for p in range(400)],
                                 "pos long, C1 long, C2 long, label int, I1 double").repartition(3)
    done = renumber.renumber(rows, ["C1", "C2"], ["C1"], batch_size=4, hot_share=0.2)
    for field, n in (("C1", 5), ("C2", 5)):
        own = done.bijection.filter(F.col("field") == field).collect()
        assert sorted(r["new_id"] for r in own) == list(range(n)) and len({r["old_id"] for r in own}) == n
    hottest = done.bijection.filter("field = 'C1' and new_id = 0").first()["old_id"]
    assert hottest == 8
    back = {(r["field"], r["old_id"]): r["new_id"] for r in done.bijection.collect()}
    old = {r["pos"]: r for r in rows.collect()}
    for r in done.rows.collect():
        assert r["C1"] == back.get(("C1", old[r["pos"]]["C1"])) and r["C2"] == back["C2", old[r["pos"]]["C2"]]
    by_rank = renumber.renumber(rows, ["C1", "C2"])
    assert by_rank.bijection.count() == 10
    # a table without positions takes those of its files
    rows.drop("pos").coalesce(1).write.parquet(str(tmp_path / "rows"))
    out = str(tmp_path / "out")
    renumber.main([str(tmp_path / "rows"), out, "--variant", "avazu_reordered", "--cats", "C1", "C2", "--reorder", "C1", "--conts", "I1", "--batch-size", "4"])
    assert spark.read.parquet(f"{out}/avazu_reordered").count() == 400
    assert spark.read.parquet(f"{out}/unique/unique").select("batch").distinct().count() == 100


def test_renumbering_of_nothing(spark):
    empty = spark.createDataFrame([], "pos long, C1 long, C2 long")
    done = renumber.renumber(empty, ["C1", "C2"], ["C2"])
    assert done.rows.count() == done.bijection.count() == 0


@pytest.mark.parametrize("name", ["etl", "renumber", "reorder"])
def test_commands_run_from_anywhere_with_the_package_on_the_path(name, tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-m", f"clickforge.{name}", "-h"], cwd=tmp_path, env={"PYTHONPATH": root, "PATH": "/usr/bin:/bin"},
                          capture_output=True, text=True, timeout=60)
    assert done.returncode == 0 and "usage" in done.stdout
