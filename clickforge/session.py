"""Session settings and fault-tolerant intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def local_session(cpus: int | str = 8, app: str = "clickforge", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        # generated methods above 8000 bytes (sums of wide vectors) are never compiled by the JVM
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # rows bucketed by their partition meet results keyed by (partition, slot) without a shuffle of the rows
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a one-process session (``local[...]``, as in tests) without that setting gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="clickforge-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``release_scratch`` deletes what is written there."""
    path = f"{checkpoint_root(spark)}/clickforge-{label}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, freezes sampled range partitions, survives executor loss and gives
    the optimizer true file sizes, so later joins choose broadcast or shuffle from real numbers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def materialize_bucketed(df: DataFrame, label: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` once to the shared folder, bucketed by ``keys``, as an external table of the session's catalog.

    Joins and aggregations on the keys read it without a shuffle. Each task writes a file for every bucket it has rows
    of, so ``df`` should be partitioned by the keys already, or its tasks should hold few of them.
    """
    spark = df.sparkSession
    name = f"clickforge_{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", scratch_path(spark, label)).saveAsTable(name)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    return spark.table(name)


def release_scratch(spark: SparkSession, keep: str | None = None) -> int:
    """Delete the intermediate tables this application has written, but for the path ``keep``; returns how many."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"drop table if exists {name}")
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    if keep in paths:
        paths.remove(keep)
        _SCRATCH[spark.sparkContext.applicationId] = [keep]
    hadoop = spark._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    return len(paths)
