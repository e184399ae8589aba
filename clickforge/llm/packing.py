"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Documents are encoded and cut into pieces of at most ``size`` tokens. Best-fit decreasing then runs over the
*counts* per length (at most ``size`` of them) instead of over documents: equal open sequences are kept as one
group, so the plan has a few rows per length whatever the corpus. Each piece finds its place by its rank
among the pieces of its length.

Scale: one narrow row per piece is written; the histogram is partially aggregated and is all that reaches
the driver; ranks within a length are counted in hashed buckets (a length that holds most pieces is spread
over all of them) with one small row per (length, bucket) carrying counts forward; the plan is broadcast, its
size is bounded by ``size``.

Cases: a null text is empty and has the end id only; repeated rows and null ids are packed like any others;
extra columns are ignored; an empty table gives an empty result. Which of two pieces of equal length comes
first follows a hash of the piece.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickforge.llm.common import whole
from clickforge.llm.tokens import encoder
from clickforge.session import materialize

SIZE = 2048


def cut_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (of 32-bit ids) and, if asked, ids of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.append(np.frombuffer(encode.encode(text), encode.dtype), end_id).astype("<u4")
                for i, a in enumerate(range(0, len(own), size)):
                    part = own[a : a + size]
                    doc.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.astype(np.int32))
            columns = {
                "doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(key).cast("bigint").alias("k"), whole(text).alias("t")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Rows (length, first rank, end rank, per, sequence, offset): the pieces of that length with a rank in
    the range fill the sequences from ``sequence`` on, ``per`` of them one after another in each, the
    first at ``offset``.
    """
    open_by_room: dict[int, list[list]] = defaultdict(list)  # room: groups of [number of sequences, [(length, per)]]
    done: list[list] = []

    def put(group: list, room: int) -> None:
        (open_by_room[room] if room else done).append(group)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, groups in open_by_room.items() if r >= length and groups), default=None)
            number, inside = open_by_room[room].pop() if room else (left, [])
            new = not room
            room = room or size
            per = room // length
            full = min(number, left // per)
            if full:
                put([full, [*inside, (length, per)]], room - per * length)
                left -= full * per
            rest = number - full
            if left and left < per and (rest or new):
                put([1, [*inside, (length, left)]], room - left * length)
                rest -= 1
                left = 0
            if rest > 0 and not new:
                open_by_room[room].append([rest, inside])
    rows, ranks, sequence = [], Counter(), 0
    for number, inside in done + [g for _, groups in sorted(open_by_room.items()) for g in groups]:
        offset = 0
        for length, per in inside:
            first = ranks[length]
            ranks[length] += number * per
            rows.append((length, first, ranks[length], per, sequence, offset))
            offset += length * per
        sequence += number
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """Add each piece's rank (from 0) among those of its length."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "_bucket").count().select(
        "length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")
    )
    return (
        dealt.withColumn("_at", F.row_number().over(inside) - 1)
        .join(bases, ["length", "_bucket"])
        .select(*pieces.columns, (F.col("_base") + F.col("_at")).alias("_rank"))
    )


def pack(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = SIZE, key: str = "doc_id", text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    pieces = materialize(cut_pieces(docs, vocabulary, end_id, size, key, text, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # size rows at most
    slots = spark.createDataFrame(
        plan(counts, size), "length long, _first long, _end long, _per long, _sequence long, _offset long"
    )
    at = F.col("_rank") - F.col("_first")
    return (
        ranked(pieces)
        .join(F.broadcast(slots), "length")
        .filter((F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("_sequence") + F.floor(at / F.col("_per"))).cast("bigint").alias("sequence_id"),
            (F.col("_offset") + F.pmod(at, F.col("_per")) * F.col("length")).cast("bigint").alias("offset"),
            *(["ids"] if with_ids else []),
        )
    )
