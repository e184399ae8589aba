"""Files in and out, workflows, streaming helpers."""

import pytest
from pyspark.sql import functions as F

from clickforge.operators.encode import Workflow
from clickforge.session import checkpoint_root, materialize, release_scratch
from clickforge.sources import clicks, edges, synthetic, tables


def test_click_files(spark, tmp_path):
    line = ["1"] + [str(i) for i in range(1, 13)] + [""] + ["68fd1e64"] * 25 + [""]
    (tmp_path / "a.tsv").write_text("\t".join(line) + "\n")
    row = clicks.read_clicks(spark, str(tmp_path)).first()
    assert (row["label"], row["I1"], row["I13"], row["C1"], row["C26"]) == (1, 1, None, 0x68FD1E64, None)


def test_ad_log(spark, tmp_path):
    header = ",".join(["id", "click", "hour", "C1", "banner"] + [f"x{i}" for i in range(19)])
    body = "1000009418151094273,0,14102100,1005,0,1fbe01fe,f3845767,28905ebd,ecad2386,7801e8d9,07d7df22,a99f214a,ddd2926e,44956a24,1,2,15706,320,50,1722,0,35,100084 x,79"
    (tmp_path / "ads.csv").write_text(f"{header}\n{body}\n")
    row = clicks.read_ad_log(spark, str(tmp_path / "ads.csv")).first()
    assert (row["label"], row["I1"], row["I2"], row["I3"], row["C1"], row["C2"]) == (0, 21, 0, 1005, 0, 532546046)
    assert row["C19"] == 100084


def test_edge_files(spark, tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("# comment\n\n1 2\n3\t4\n5,6\n")
    assert sorted(map(tuple, edges.read_edge_list(spark, str(path)).collect())) == [(1, 2, 1.0), (3, 4, 1.0), (5, 6, 1.0)]
    path.write_text("1 2\nbad line\n1 4294967296\n")
    good, rejected = edges.parse_edges(spark.read.text(str(path)))
    assert good.count() == 1 and sorted(r[0] for r in rejected.collect()) == ["1 4294967296", "bad line"]
    with pytest.raises(Exception, match="bad edge line"):
        edges.read_edge_list(spark, str(path)).collect()


def test_variant_names(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_training_matrix(spark, str(tmp_path), "other")


def test_existing_output_is_left_alone(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.write_if_absent(spark.range(3), path)
    tables.write_if_absent(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    tables.write_parquet(spark.range(9), path)
    assert spark.read.parquet(path).count() == 9


def test_shuffled_output_is_stable(spark, tmp_path):
    rows = spark.range(100).coalesce(1)
    for name in ("a", "b"):
        tables.write_shuffled(rows, str(tmp_path / name), ["id"], seed=3)
    first = [r[0] for r in spark.read.parquet(str(tmp_path / "a")).collect()]
    assert first == [r[0] for r in spark.read.parquet(str(tmp_path / "b")).collect()]
    assert first != list(range(100)) and sorted(first) == list(range(100))


def test_metrics_and_losses(spark, tmp_path):
    path = str(tmp_path / "metrics")
    tables.append_metrics(spark, path, [("s", "d", 1024, 4, 10, 2.0)])
    tables.append_metrics(spark, path, [("s", "d", 1024, 4, 10, 3.0)])
    assert tables.read_metrics(spark, path).count() == 2
    (tmp_path / "loss.txt").write_text("0.5\n0.25\n0.125\n")
    series = tables.read_loss_series(spark, str(tmp_path / "loss.txt"), "m").orderBy("iter").collect()
    assert [(r["iter"], r["loss"]) for r in series] == [(0, 0.5), (1, 0.25), (2, 0.125)]


def test_unique_csr_slice(spark, tmp_path):
    df = spark.createDataFrame([(i // 4, i % 4, v) for i, v in enumerate([3, 3, 1, 2, 9, 9, 9, 8])], "batch bigint, in_batch bigint, u bigint")
    tables.write_unique_csr(df, str(tmp_path / "csr"), ["u"])
    part = tables.read_unique_csr(spark, str(tmp_path / "csr"), batch=1)
    assert part["unique"].first()["ids"] == [8, 9] and tuple(part["offsets"].select("lo", "hi").first()) == (3, 5)
    assert part["max_unique"].first()["max_unique"] == 3


def test_workflow_round_trip_with_unseen_values(spark, tmp_path):
    train = spark.createDataFrame([("a", 1.0, 1), ("a", -5.0, 0), ("b", None, 0)], "c string, x double, y int")
    Workflow.fit(train, ["c"], ["x"], "y").save(str(tmp_path / "wf"))
    loaded = Workflow.load(spark, str(tmp_path / "wf"))
    fresh = spark.createDataFrame([("b", 1.0, 1), ("zzz", 0.0, 0), (None, 0.0, 0)], "c string, x double, y int")
    assert [r["c"] for r in loaded.transform(fresh).collect()] == [2, 0, 0]
    assert [f.dataType.simpleString() for f in loaded.transform(fresh).select("c", "x", "y").schema] == ["bigint", "float", "float"]


def test_generators_repeat(spark, tmp_path):
    a = synthetic.synthetic_uniform(spark, 50, [10, 3], 2, seed=1).collect()
    assert a == synthetic.synthetic_uniform(spark, 50, [10, 3], 2, seed=1).collect()
    assert a != synthetic.synthetic_uniform(spark, 50, [10, 3], 2, seed=2).collect()
    synthetic.write_power_law(spark, str(tmp_path / "pl"), 200, 100, 1000)
    assert spark.read.parquet(str(tmp_path / "pl/train")).count() == 200
    assert len([f for f in (tmp_path / "pl/eval").iterdir() if f.suffix == ".parquet"]) <= 4
    ids = synthetic.synthetic_power_law(spark, 500, 1000, 1.0).agg(F.min("C1"), F.max("C1")).first()
    assert ids[0] >= 0 and ids[1] < 1000


def test_scratch_tables_can_be_released(spark):
    stored = materialize(spark.range(5), "probe")
    assert stored.count() == 5 and checkpoint_root(spark)
    assert release_scratch(spark) >= 1
    assert release_scratch(spark) == 0


def test_command_line_numbering(spark, tmp_path):
    from clickforge import reorder

    (tmp_path / "edges.txt").write_text("0 1\n1 2\n0 2\n")
    reorder.main([str(tmp_path / "edges.txt"), str(tmp_path / "order")])
    lines = [r[0].split() for r in spark.read.text(str(tmp_path / "order")).collect()]
    assert sorted(int(old) for old, _ in lines) == sorted(int(new) for _, new in lines) == [0, 1, 2]
    reorder.main(["-c", str(tmp_path / "edges.txt"), str(tmp_path / "members")])
    assert len({r[0].split()[1] for r in spark.read.text(str(tmp_path / "members")).collect()}) == 1
