"""The streaming jobs run to completion over the event log."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from clickforge.functions.vectors import fixed_point
from clickforge.operators.encode import Workflow
from clickforge.plans.etl import scratch
from clickforge.plans.registry import CLICKS, Tables, fixed_point_sql, query
from clickforge.streaming import jobs

SLICES = 4  # the log arrives in this many parts, one per micro-batch
FILES = 4  # files of a part at least, each written by its own task
FILE_ROWS = 100_000  # rows of a file, about
MINI = 64  # rows of a mini-batch
PLACES = 40  # ids that the running state of frequent ids keeps


def _arrivals(t: Tables, rows: DataFrame) -> DataFrame:
    """The rows as a stream of files, written one after the other so that they arrive in order."""
    path = scratch(t, "arrivals")
    n = rows.agg(F.max("pos")).first()[0] + 1
    width = -(-n // SLICES)
    files = max(FILES, width // FILE_ROWS)
    for k in range(SLICES):
        piece = rows.filter((F.col("pos") >= k * width) & (F.col("pos") < (k + 1) * width))
        piece.repartition(files).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


_SLICE = f"{CLICKS}, w as (select (max(pos) + {SLICES}) // {SLICES} as width from clicks)"


@query("stream_transform", """
with ev as (select event_id as pos, user_id, value, event_type from events),
v as (select user_id, row_number() over (order by count(*) desc, user_id) as id from ev group by user_id),
m as (select avg(greatest(value, 0)) as m, stddev_samp(greatest(value, 0)) as s from ev)
select pos, id as user_id, cast(round(cast(cast((greatest(value, 0) - m) / s as float) as double), 4) as double) as value,
  cast(event_type = 'purchase' as float) as label from ev join v using (user_id), m""")
def stream_transform(t):
    rows = t.clicks.select("pos", "user_id", "value", "label")
    workflow = Workflow.fit(rows, ["user_id"], ["value"], "label")
    out = scratch(t, "transformed")
    stream = jobs.stream_transform(_arrivals(t, rows), workflow)
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(t, "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    done = t.spark.read.parquet(out)
    return done.withColumn("value", F.round(F.col("value").cast("double"), 4))


@query("stream_access_counts", f"""with {CLICKS}
select 'user_id' as field, user_id as id, count(*) as cnt from clicks group by all
union all select 'k', k, count(*) from clicks group by all""")
def stream_access_counts(t):
    out = scratch(t, "counts")
    stream = jobs.stream_access_counts(_arrivals(t, t.clicks.select("pos", "user_id", "k")), ["user_id", "k"])

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    job = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", scratch(t, "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.parquet(out).groupBy("field", "id").agg(F.max("cnt").alias("cnt"))


@query("stream_batch_unique", f"""with {_SLICE}
select pos // width as micro_batch, 'user_id' as field, pos // {MINI} as batch, pos, user_id as id,
  dense_rank() over (partition by pos // width, pos // {MINI} order by user_id) - 1 as inv from clicks, w""")
def stream_batch_unique(t):
    out = scratch(t, "unique")
    stream = _arrivals(t, t.clicks.select("pos", "user_id"))
    jobs.start_batch_unique(stream, ["user_id"], "pos", out, scratch(t, "cp"), MINI, availableNow=True).awaitTermination()
    lists = t.spark.read.parquet(f"{out}/unique").select("micro_batch", "batch", "field", F.posexplode("ids").alias("inv", "id"))
    rows = t.spark.read.parquet(f"{out}/inverse").join(lists, ["micro_batch", "batch", "field", "inv"])
    return rows.select(F.col("micro_batch").cast("bigint").alias("micro_batch"), "field", "batch", "pos", "id", "inv")


def _frequent_sql() -> str:
    """One step per micro-batch: counts added up, then the largest one too many taken off."""
    steps = ["s0 as (select 0::bigint as id, 0::bigint as cnt, 0::bigint as error limit 0), e0 as (select 0::bigint as error)"]
    for k in range(SLICES):
        steps.append(
            f"m{k} as (select id, cast(sum(cnt) as bigint) as cnt from (select id, cnt from s{k} union all select user_id, count(*) "
            f"from clicks, w where pos // width = {k} group by user_id) group by id), "
            f"t{k} as (select coalesce((select cnt from m{k} order by cnt desc limit 1 offset {PLACES}), 0) as cut), "
            f"e{k + 1} as (select error + cut as error from e{k}, t{k}), "
            f"s{k + 1} as (select id, cnt - cut as cnt, error from m{k}, t{k}, e{k + 1} where cnt > cut)")
    union = " union all ".join(f"select {k}::bigint as micro_batch, id, cnt, error from s{k + 1}" for k in range(SLICES))
    return f"with {_SLICE}, {', '.join(steps)} {union}"


@query("stream_frequent_ids", _frequent_sql())
def stream_frequent_ids(t):
    """More users than places, so counts are cut on the way; the state after each micro-batch."""
    out = scratch(t, "frequent")
    stream = _arrivals(t, t.clicks.select("pos", "user_id"))
    jobs.start_frequent_ids(stream, "user_id", PLACES, out, scratch(t, "cp"), availableNow=True).awaitTermination()
    done = t.spark.read.parquet(out).filter("id is not null")
    return done.select(F.col("micro_batch").cast("bigint").alias("micro_batch"), "id", "cnt", "error")


@query("stream_vectors", f"""with {_SLICE}, n as (select count(*) as n from embeddings),
cur as (select pos // width as mb, pos, user_id as id, embedding as vec from (select * from clicks, w, n) c join embeddings on vec_id = pos % n),
ends as (select id, mb, max(pos) as key, count(*) as rows from cur group by id, mb)
select ends.id, key, cast(sum(rows) over (partition by ends.id order by ends.mb) as bigint) as n, {fixed_point_sql("cur.vec")} as vec
from ends join cur on cur.pos = key""")
def stream_vectors(t):
    """The last vector of every user after each micro-batch that names the user."""
    rows = t.clicks.select("pos", F.col("user_id").alias("id"), F.pmod("pos", F.lit(t.n_vectors)).alias("_v"))
    updates = rows.join(t.vectors.withColumnRenamed("id", "_v"), "_v").select("pos", "id", "vec")
    out = scratch(t, "vectors")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/micro_batch={number}")

    stream = jobs.stream_vectors(_arrivals(t, updates), "pos")
    job = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", scratch(t, "cp")).trigger(availableNow=True).start()
    job.awaitTermination()
    return t.spark.read.parquet(out).select("id", "key", "n", fixed_point("vec").alias("vec"))


def _sync_sql() -> str:
    """One step per micro-batch: kept vectors of the batch before, else the row's own vector."""
    steps = ["s0 as (select * from cur where mb = 0)"]
    for k in range(1, SLICES):
        steps.append(
            f"p{k} as (select id, arg_min(vec, pos) as vec from s{k - 1} group by id), s{k} as (select mb, pos, cur.id, "
            f"coalesce(p{k}.vec, cur.vec) as vec from cur left join p{k} on p{k}.id = cur.id where mb = {k})"
        )
    union = " union all ".join(f"select * from s{k}" for k in range(SLICES))
    return f"""with {_SLICE}, n as (select count(*) as n from embeddings),
cur as (select pos // width as mb, pos, user_id as id, embedding as vec from (select * from clicks, w, n) c join embeddings on vec_id = pos % n),
{", ".join(steps)}
select mb as micro_batch, pos, id, {fixed_point_sql("vec")} as vec from ({union})"""


@query("stream_cache_sync", _sync_sql())
def stream_cache_sync(t):
    """Every event brings a vector for its user; a micro-batch takes over what the one before left."""
    rows = t.clicks.select("pos", F.col("user_id").alias("id"), F.pmod("pos", F.lit(t.n_vectors)).alias("_v"))
    updates = rows.join(t.vectors.withColumnRenamed("id", "_v"), "_v").select("pos", "id", "vec")
    out = scratch(t, "sync")
    jobs.start_cache_sync(_arrivals(t, updates), "pos", out, scratch(t, "cp"), availableNow=True).awaitTermination()
    done = t.spark.read.parquet(out)
    return done.select(F.col("micro_batch").cast("bigint").alias("micro_batch"), "pos", "id", fixed_point("vec").alias("vec"))
