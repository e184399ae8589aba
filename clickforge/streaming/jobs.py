"""Structured Streaming jobs: encode arriving rows, count accesses, per-batch distinct ids, vector sync, keyed vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clickforge.functions.scalars import int_div
from clickforge.operators.encode import Workflow, long_form
from clickforge.operators.frequent import FrequentIds
from clickforge.operators.profile import batch_inverse, batch_unique


def stream_transform(rows: DataFrame, workflow: Workflow) -> DataFrame:
    """Apply a saved workflow to a stream: stream-static joins, append mode."""
    return workflow.transform(rows)


def stream_access_counts(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Running (field, id, cnt), for update or complete mode. State grows with the id space."""
    return (
        long_form(rows, fields)
        .filter(F.col("value").isNotNull())
        .groupBy("field", F.col("value").alias("id"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def start_batch_unique(rows: DataFrame, fields: Sequence[str], key: str, path: str, checkpoint: str,
                       batch_size: int = 4096, **trigger) -> StreamingQuery:
    """Distinct ids and inverse positions of the mini-batches in each micro-batch, under ``path``.

    ``key`` is the position of a row in the stream; ``batch_size`` positions make a mini-batch, so no list or
    window is longer, whatever a micro-batch holds. A mini-batch that two micro-batches share has a part in
    each. Every micro-batch overwrites its own folder, so a replayed one leaves the same result.
    """

    def save(batch: DataFrame, batch_no: int) -> None:
        tagged = batch.withColumn("batch", int_div(key, batch_size))
        batch_unique(tagged, fields).write.mode("overwrite").parquet(f"{path}/unique/micro_batch={batch_no}")
        inverse = batch_inverse(tagged, fields, in_batch=key)
        inverse.write.mode("overwrite").parquet(f"{path}/inverse/micro_batch={batch_no}")

    return rows.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_cache_sync(rows: DataFrame, key: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Replace vectors of a micro-batch (key, id, vec) by those the previous micro-batch left.

    Result k lies in ``path/micro_batch=k``, is built from result k - 1 only, and is overwritten on
    replay. The work per micro-batch follows its own size, not the size of the vector table. A missing
    previous result ends the job with an error.
    """

    def sync(batch: DataFrame, batch_no: int) -> None:
        before = f"{path}/micro_batch={batch_no - 1}"
        out = batch
        if batch_no > 0:
            previous = batch.sparkSession.read.parquet(before)
            latest = previous.groupBy("id").agg(F.min_by("vec", key).alias("_prev"))
            out = batch.join(latest, "id", "left").withColumn("vec", F.coalesce("_prev", "vec")).drop("_prev")
        out.write.mode("overwrite").parquet(f"{path}/micro_batch={batch_no}")

    return rows.writeStream.foreachBatch(sync).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_frequent_ids(rows: DataFrame, id_col: str, size: int, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The most frequent ids so far after every micro-batch, ``FrequentIds.load(spark, f"{path}/micro_batch={k}")``.

    State k is built from state k - 1 and overwritten on replay; it holds at most ``size`` ids however long the stream runs.
    """

    def absorb(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        before = FrequentIds.load(spark, f"{path}/micro_batch={batch_no - 1}") if batch_no else FrequentIds.empty(spark, size)
        before.update(batch, id_col).save(f"{path}/micro_batch={batch_no}")

    return rows.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint).trigger(**trigger).start()


HELD_ROWS = 1 << 16  # rows that a task holds back while it looks for the newest one of each id


def _newest(rows: pa.Table) -> pa.Table:
    """Of (id, _key, vec, _n) the rows with the largest key of each id; the first of them carries the count of all."""
    ids, keys = rows["id"].to_numpy(), rows["_key"].to_numpy()
    order = np.lexsort((keys, ids))
    ids, keys, counts = ids[order], keys[order], rows["_n"].to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    sizes = np.diff(np.r_[starts, len(ids)])
    kept = np.flatnonzero(keys == np.repeat(keys[starts + sizes - 1], sizes))
    n = np.zeros(len(kept), np.int64)
    n[np.r_[True, ids[kept][1:] != ids[kept][:-1]]] = np.add.reduceat(counts, starts)
    return rows.take(pa.array(order[kept])).set_column(rows.schema.get_field_index("_n"), "_n", pa.array(n))


def _newest_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that cannot be the newest of their id do not go on to the state; their number does."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held, size = [*held, batch], size + batch.num_rows
        if size > HELD_ROWS:
            found = _newest(pa.Table.from_batches(held)).combine_chunks()
            held, size = found.to_batches(), found.num_rows
            if size > HELD_ROWS // 2:  # mostly different ids
                yield from held
                held, size = [], 0
    if held:
        yield from _newest(pa.Table.from_batches(held)).to_batches()


def stream_vectors(rows: DataFrame, key: str, merge: str = "last", expire_ms: int | None = None) -> DataFrame:
    """A stream of (id, vec, key, n): the vector that each id of a micro-batch has after it, for update mode.

    The state store keeps one vector per id over all micro-batches, so ids that some of them skip are not forgotten, and a restart
    from the checkpoint goes on with the same vectors. ``merge`` is ``"last"``, the vector with the largest ``key``, also when it
    arrives late (equal keys: the first in order of values), or ``"sum"``, all vectors added up, in order of ``key`` inside a micro-batch.
    ``n`` counts the merged rows. Ids that no row has named for ``expire_ms`` milliseconds are dropped from the state. Rows with a
    null id, key, vector or component are left out. A sum of vectors of different lengths raises an error. For ``"last"``, each task
    first leaves out the rows that are older than another one of their id.
    """
    if merge not in ("last", "sum"):
        raise ValueError(f"unknown merge {merge}")
    whole = F.col("id").isNotNull() & F.col("_key").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda x: x.isNull())
    typed = rows.select(F.col("id").cast("bigint").alias("id"), F.col(key).cast("bigint").alias("_key"),
                        F.col("vec").cast("array<double>").alias("vec")).filter(whole).withColumn("_n", F.lit(1).cast("bigint"))
    if merge == "last":
        typed = typed.mapInArrow(_newest_in_task, typed.schema)

    def absorb(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        vec, newest, n = state.get if state.exists else (None, None, 0)
        for frame in frames:  # an id may have more rows than fit into one frame
            arrived = sorted(zip(frame["_key"].tolist(), [v.tolist() for v in frame["vec"]]))  # state takes plain values
            for at, new in arrived:
                if merge == "sum" and vec is not None:
                    vec = [a + b for a, b in zip(vec, new, strict=True)]
                elif vec is None or at > newest:
                    vec = new
                newest = at if newest is None else max(newest, at)
            n += int(frame["_n"].sum())
        state.update((vec, newest, n))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        yield pd.DataFrame({"id": [group[0]], "vec": [vec], "key": [newest], "n": [n]})

    timeout = GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return typed.groupBy("id").applyInPandasWithState(
        absorb, "id bigint, vec array<double>, key bigint, n bigint", "vec array<double>, key bigint, n bigint", "update", timeout
    )
