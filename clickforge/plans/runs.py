"""Whole runs: the encoding of two splits and the re-numbering of a training set, read back from what they write."""

from __future__ import annotations

import pyspark.sql.functions as F

from clickforge.etl import run_etl
from clickforge.plans.etl import scratch
from clickforge.plans.registry import CLICKS, query
from clickforge.renumber import write_renumbered
from clickforge.sources import tables

BATCH = 512


@query("etl_run", f"""with {CLICKS}, n as (select count(*) as n from clicks),
rows as (select clicks.*, case when pos * 10 < n * 9 then 'train' else 'valid' end as split from clicks, n),
vocabulary as (select user_id, row_number() over (order by count(*) desc, user_id) as id from rows where split = 'train' group by user_id),
m as (select avg(greatest(value, 0)) as m, stddev_samp(greatest(value, 0)) as s from rows where split = 'train')
select split, pos, coalesce(id, 0) as user_id,
  cast(round(cast(cast((greatest(value, 0) - m) / s as float) as double), 4) as double) as value, cast(label as float) as label
from rows left join vocabulary using (user_id), m""")
def etl_run(t):
    """The first nine tenths of the events train the workflow; both splits as written."""
    rows = t.clicks.select("pos", "user_id", "value", "label")
    n = rows.count()
    early = F.col("pos") * 10 < n * 9
    out = scratch(t, "etl")
    run_etl(rows.filter(early), rows.filter(~early), out, ["user_id"], ["value"], "label")
    splits = [t.spark.read.parquet(f"{out}/{s}").select(F.lit(s).alias("split"), "pos", "user_id", "value", "label") for s in ("train", "valid")]
    return splits[0].union(splits[1]).withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("renumber_run", f"""with {CLICKS}
select pos, pos // {BATCH} as batch, 'user_id' as field, user_id as id, user_id as unique_id from clicks
union all select pos, pos // {BATCH}, 'k', k, k from clicks where k is not null""")
def renumber_run(t):
    """Users by communities, k by frequency. Both the matrix and the unique lists, taken back to the old ids, are the event log."""
    out = scratch(t, "renumbered")
    write_renumbered(t.clicks, out, "kaggle_reordered", ["user_id", "k"], ["value"], "label", ["user_id"], batch_size=BATCH)
    back = t.spark.read.parquet(f"{out}/bijection")
    matrix = tables.read_training_matrix(t.spark, out, "kaggle_reordered")
    ids = matrix.select("pos", F.posexplode("cats").alias("at", "new_id")).withColumn("field", F.when(F.col("at") == 0, "user_id").otherwise("k"))
    csr = tables.read_unique_csr(t.spark, f"{out}/unique")
    lists = csr["unique"].select("batch", "field", F.posexplode("ids").alias("inv", "unique_new"))
    unique = csr["inverse"].join(lists, ["batch", "field", "inv"]).withColumn("pos", F.col("batch") * BATCH + F.col("in_batch"))
    old = back.select("field", "new_id", F.col("old_id").alias("id"))
    by_matrix = ids.join(old, ["field", "new_id"]).select("pos", "field", "id")
    by_list = unique.join(old.toDF("field", "unique_new", "unique_id"), ["field", "unique_new"]).select("pos", "batch", "field", "unique_id")
    return by_matrix.join(by_list, ["pos", "field"], "full").select("pos", "batch", "field", "id", "unique_id")


@query("write_if_absent", """
select o_orderkey, o_custkey as first_kept, o_orderkey as cleaned from orders""")
def write_if_absent(t):
    """A second output is left out where one exists; a cleaned one is replaced."""
    kept, cleaned = scratch(t, "kept"), scratch(t, "cleaned")
    for column in ("o_custkey", "o_orderkey"):
        rows = t.orders.select("o_orderkey", F.col(column).alias("x"))
        tables.write_if_absent(rows, kept)
        tables.write_parquet(rows, cleaned)
    both = t.spark.read.parquet(kept).withColumnRenamed("x", "first_kept")
    return both.join(t.spark.read.parquet(cleaned).withColumnRenamed("x", "cleaned"), "o_orderkey")
