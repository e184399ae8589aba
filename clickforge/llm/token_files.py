"""Token ids of whole documents as flat unsigned files with 64-bit offsets, and the memory-mapped reader.

A folder holds, for each range of documents in ascending id order,
``tokens/part-K.bin`` (flat ids, 16 bits each where the vocabulary has at most 65,536 entries, else 32),
``offsets/part-K.bin`` (n + 1 unsigned 64-bit numbers: where each document starts among the ids of *all*
documents, then the end) and ``docs/part-K.bin`` (n signed 64-bit document ids).

Scale: documents are range partitioned by (id, text hash), so each task streams one sorted range into its own
files and returns one row of sizes. Bases of the parts are prefix sums over those rows (as many as parts).
A second pass adds the base to each part's offsets. No row of a document reaches the driver. Files are
written under a name of the attempt and renamed, so a retried or doubled task leaves the same whole file.
The folder must be shared (a mounted path, or a store that pyarrow.fs knows); on a mounted path the reader maps
the files into memory, elsewhere it reads them.

Cases: a null text is empty and has the end id only; null document ids come first and are kept as null (stored
as the smallest 64-bit number, which is therefore no valid id); repeated ids follow each other in the order
of their texts' hashes; extra columns are ignored; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.llm.common import whole
from clickforge.llm.tokens import encoder

NO_ID = -(1 << 63)
READ_ROWS = 8192


@dataclass
class TokenFiles:
    """A written folder: the ids' type and, for each part, (number, first token, documents)."""

    folder: str
    dtype: str
    parts: list[tuple[int, int, int]]


def _store(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _part(root: str, kind: str, k: int) -> str:
    return f"{root}/{kind}/part-{k:06d}.bin"


class _Renamed:
    """A file that gets its name when it is complete."""

    def __init__(self, store, path: str):
        self.store, self.path, self.draft = store, path, f"{path}.{uuid.uuid4().hex}"

    def __enter__(self):
        self.out = self.store.open_output_stream(self.draft)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.store.move(self.draft, self.path)
        else:
            self.store.delete_file(self.draft)


def write_token_files(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text",
    parts: int | None = None,
) -> TokenFiles:
    """Encode every text, append ``end_id``, and write the ids in ascending order of ``key``."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(key).cast("bigint").alias("doc"), whole(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc").asc_nulls_first(), F.col("tie")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc", "text")
    store, root = _store(folder)
    for kind in ("tokens", "lengths", "offsets", "docs"):
        store.create_dir(f"{root}/{kind}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        k, encode, lengths, ids = TaskContext.get().partitionId(), encoder(vocabulary), [], []
        end = np.array([end_id], encode.dtype).tobytes()
        with _Renamed(store, _part(root, "tokens", k)) as out:
            for batch in batches:
                for text in batch.column(1).to_pylist():
                    data = encode.encode(text) + end
                    lengths.append(len(data) // encode.dtype.itemsize)
                    out.write(data)
                ids.append(np.array(batch.column(0).fill_null(NO_ID), "<i8"))
        with _Renamed(store, _part(root, "docs", k)) as out:
            out.write(np.concatenate([np.empty(0, "<i8"), *ids]).tobytes())
        with _Renamed(store, _part(root, "lengths", k)) as out:
            out.write(np.array(lengths, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([k], pa.int32()), "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_tokens": pa.array([sum(lengths)], pa.int64()), "dtype": [encode.dtype.str],
        })

    sizes = sorted(rows.mapInArrow(write, "part int, n_docs long, n_tokens long, dtype string").collect())
    bases = dict(zip((s.part for s in sizes), accumulate((s.n_tokens for s in sizes), initial=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                with store.open_input_stream(_part(root, "lengths", k)) as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                with _Renamed(store, _part(root, "offsets", k)) as out:
                    out.write(np.cumsum(np.r_[np.uint64(bases[k]), lengths], dtype="<u8").tobytes())
                yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64())})

    if sizes:
        spark.range(0, len(sizes), 1, len(sizes)).mapInArrow(place, "part long").count()
    return TokenFiles(folder, sizes[0].dtype if sizes else "<u2", [(s.part, bases[s.part], s.n_docs) for s in sizes])


def read_token_files(spark: SparkSession, files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (of 32-bit ids), and ids if asked."""
    folder, dtype, known = files.folder, files.dtype, {part: n for part, _, n in files.parts}

    def load(store, path: str, kind: str) -> np.ndarray:
        from pyarrow.fs import LocalFileSystem

        if store.get_file_info(path).size == 0:
            return np.empty(0, kind)
        if isinstance(store, LocalFileSystem):
            return np.memmap(path, kind, "r")
        with store.open_input_stream(path) as f:
            return np.frombuffer(f.read(), kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if not known[k]:
                    continue
                tokens = load(store, _part(root, "tokens", k), dtype)
                offsets, ids = load(store, _part(root, "offsets", k), "<u8"), load(store, _part(root, "docs", k), "<i8")
                base = offsets[0]
                for a in range(0, len(ids), READ_ROWS):
                    starts, ends = offsets[a : a + READ_ROWS], offsets[a + 1 : a + 1 + READ_ROWS]
                    own = [tokens[int(i - base) : int(j - base)].astype("<u4") for i, j in zip(starts, ends)]
                    keys = np.asarray(ids[a : a + READ_ROWS])
                    columns = {
                        "doc_id": pa.array(keys, pa.int64(), mask=keys == NO_ID),
                        "start": pa.array(np.asarray(starts[: len(keys)], np.int64)),
                        "n_tokens": pa.array([len(x) for x in own], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spark.range(0, len(known), 1, max(1, len(known))).mapInArrow(read, schema)
