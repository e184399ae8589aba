"""Deterministic WARC archives of pages, and their reader.

A record is one gzip member with WARC/1.1 headers: ``response`` holds an HTTP head and the payload, ``revisit`` the head
only and a reference to the response with the same payload, that of the largest key. Record ids are hashes of what a record
is, the date is a parameter, and gzip carries no time, so equal pages give equal files on any cluster.

Shards: rows are range-sorted by (key, payload digest, url). Bounds come from exact prefix sums over the payloads'
bytes, not from a sample, and depend on the rows alone: at most ``MOST_SHARDS`` of at least ``LEAST_SHARD`` bytes each. One
task writes a shard and starts a new file whenever the next member would pass ``roll_bytes``. Files are written under
temporary names and renamed; the manifest (file, size, records, sha256) is a Parquet table, committed last by Spark.
A folder without a manifest is not an archive; files that it does not name are leftovers of lost tasks.

Scale: digests, sizes and urls are stored once; which rows are revisits is decided on them. Payload digests with more than a
1024th of all rows are at most 1023 and are broadcast, all others are joined by shuffle. Pages move once, to their
shard, together with one small row for each revisit. The driver holds one bound a shard. Writer and reader hold one record.

Cases: a null payload is empty, and empty payloads are equal like any other; a null key comes first, is the smallest, and
has no header; a null url has no target; of repeated rows (same key, payload and url) one is the response or all
revisit it, and they stay in one shard; extra columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.functions.scalars import int_div
from clickforge.llm.common import whole
from clickforge.llm.token_files import _Renamed, _store
from clickforge.operators.ordering import running
from clickforge.session import materialize

LEAST_SHARD = 8 << 20
MOST_SHARDS = 1 << 16
ROLL = 1 << 30
HOT_SHARE = 1024
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, number int, file string, bytes long, records long, sha256 string"
_URI_SIGNS = "!#$%&'()*+,-./:;=?@[]_~"
_CHUNK = 1 << 20


# ---- which record revisits which ------------------------------------------------------------------


def _marks(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = whole(f"`{payload}`")
    return pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page"), F.sha1(body.cast("binary")).alias("digest"), F.col(f"`{url}`").alias("url"),
        F.octet_length(body).cast("bigint").alias("bytes"),
    )


def revisits(marks: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """(page, digest, url, to_page, to_url) of the distinct rows that revisit another row's payload."""
    groups = marks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page", "url")).alias("last")).filter("n > 1")
    groups = materialize(groups, "payload-groups")
    limit = marks.count() // hot_share
    hot = groups.filter(F.col("n") > limit).select("digest", "last")  # fewer than hot_share rows
    rest = groups.filter(F.col("n") <= limit).select("digest", "last")
    rows = marks.select("page", "digest", "url").join(F.broadcast(hot), "digest", "left")
    cold = rows.filter(F.col("last").isNull()).drop("last").join(rest, "digest")
    both = rows.filter(F.col("last").isNotNull()).select(cold.columns).union(cold)
    chosen = F.col("page").eqNullSafe(F.col("last.page")) & F.col("url").eqNullSafe(F.col("last.url"))
    return both.filter(~chosen).select("page", "digest", "url", F.col("last.page").alias("to_page"), F.col("last.url").alias("to_url")).distinct()


def _place(page, digest, url) -> tuple:
    """Sort key in Python; nulls first, as in Spark."""
    return (page is not None, page or 0, digest, url is not None, url or "")


def shard_bounds(marks: DataFrame, least: int = LEAST_SHARD, most: int = MOST_SHARDS) -> list[tuple]:
    """Smallest sort key of every shard but the first, in order; fewer than ``most``."""
    total = marks.agg(F.sum("bytes")).first()[0] or 0
    size = max(least, -(-total // most))
    if total <= size:
        return []
    before = running(marks, [F.col("page").asc_nulls_first(), "digest", F.col("url").asc_nulls_first()], "bytes", "before", inclusive=False)
    firsts = before.groupBy(int_div("before", size).alias("shard")).agg(F.min(F.struct("page", "digest", "url")).alias("f"))
    found = sorted({_place(*r["f"]) for r in firsts.filter("shard > 0").collect()})
    return found


# ---- records ------------------------------------------------------------------------------------


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page, digest: str, url, copy: int = 0) -> str:
    name = f"{page}\n{digest}\n{copy}\n{'-' if url is None else '=' + url}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(name.encode()).digest()[:16], version=5)}>"


def _uri(url: str) -> str:
    """The url without characters that a header cannot hold."""
    return quote(url, safe=_URI_SIGNS)


def member(headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One WARC record as a gzip member."""
    lines = [*headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page, digest: str, url, payload: bytes, copy: int, to: tuple | None, date: str) -> bytes:
    """The record of a page; ``to`` is (page, url) of the response that it revisits."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if to else http + payload
    headers = [("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", record_id(page, digest, url, copy)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _uri(url)))
    headers += [("WARC-Payload-Digest", "sha1:" + _b32(bytes.fromhex(digest))), ("WARC-Block-Digest", "sha1:" + _b32(hashlib.sha1(block).digest()))]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if to:
        to_page, to_url = to
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(to_page, digest, to_url)), ("WARC-Refers-To-Date", date)]
        if to_url is not None:
            headers.append(("WARC-Refers-To-Target-URI", _uri(to_url)))
        if to_page is not None:
            headers.append(("X-Refers-To-Page-Id", str(to_page)))
    return member([*headers, ("Content-Type", "application/http; msgtype=response")], block)


class _Shard:
    """Files of one shard, rolled by compressed size; ``rows`` are their manifest rows."""

    def __init__(self, store, root: str, shard: int, roll: int):
        self.store, self.root, self.shard, self.roll = store, root, shard, roll
        self.rows, self.file = [], None

    def add(self, data: bytes) -> None:
        if self.file and self.size + len(data) > self.roll:
            self.close()
        if not self.file:
            self.name = f"pages-{self.shard:06d}-{len(self.rows):05d}.warc.gz"
            self.file = _Renamed(self.store, f"{self.root}/{self.name}")
            self.out, self.size, self.n, self.hash = self.file.__enter__(), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.n += 1

    def close(self, failed: type | None = None) -> None:
        if self.file:
            self.file.__exit__(failed)
            self.rows.append((self.shard, len(self.rows), self.name, self.size, self.n, self.hash.hexdigest()))
            self.file = None


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = list(zip(*rows)) or [[]] * len(kinds)
    names = [field.split()[0] for field in MANIFEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _shard_of(bounds: list[tuple]):
    @F.arrow_udf("long")
    def shard(page: pa.Array, digest: pa.Array, url: pa.Array) -> pa.Array:
        rows = zip(page.to_pylist(), digest.to_pylist(), url.to_pylist())
        return pa.array([bisect_right(bounds, _place(*r)) for r in rows], pa.int64())

    return shard


def write_warc(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", roll_bytes: int = ROLL,
    least_shard: int = LEAST_SHARD, date: str = DATE,
) -> DataFrame:
    """Write the archive files and the manifest into ``folder``; returns the manifest."""
    spark = pages.sparkSession
    marks = materialize(_marks(pages, key, url, payload), "pages")
    bounds = shard_bounds(marks, least_shard)
    store, root = _store(folder)
    store.create_dir(root, recursive=True)

    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    own = pages.select(
        F.col(f"`{key}`").cast("bigint").alias("page"), F.sha1(whole(f"`{payload}`").cast("binary")).alias("digest"), F.col(f"`{url}`").alias("url"),
        F.lit(1).alias("kind"), whole(f"`{payload}`").alias("body"), none("bigint").alias("to_page"), none("string").alias("to_url"),
    )
    known = revisits(marks).select("page", "digest", "url", F.lit(0).alias("kind"), none("string").alias("body"), "to_page", "to_url")
    rows = own.union(known)
    shard = _shard_of(bounds)("page", "digest", "url") if bounds else F.lit(0).cast("bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["shard", F.col("page").asc_nulls_first(), "digest", F.col("url").asc_nulls_first(), "kind"]
    dealt = rows.withColumn("shard", shard).repartition(parts, "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        out, last, copy, target = None, None, 0, None
        try:
            for batch in batches:
                columns = [batch.column(i) for i in range(batch.num_columns)]
                for i in range(batch.num_rows):
                    page, digest, link, kind, body, to_page, to_link, number = (c[i].as_py() for c in columns)
                    if out is None or out.shard != number:
                        if out:
                            out.close()
                            yield _table(out.rows)
                        out = _Shard(store, root, number, roll_bytes)
                    if kind == 0:
                        last, copy, target = (page, digest, link), 0, (to_page, to_link)
                        continue
                    if last != (page, digest, link):
                        last, copy, target = (page, digest, link), 0, None
                    out.add(page_record(page, digest, link, body.encode(), copy, target, date))
                    copy, target = copy + 1, target or (page, link)  # repeated rows revisit the first
            if out:
                out.close()
                yield _table(out.rows)
        except BaseException as e:
            if out:
                out.close(type(e))
            raise

    names = ["page", "digest", "url", "kind", "body", "to_page", "to_url", "shard"]
    dealt.select(*names).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# ---- reading ------------------------------------------------------------------------------------


def members(stream, seen=None) -> Iterator[bytes]:
    """The contents of the gzip members of a stream, one at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest:
                rest = stream.read(_CHUNK)
                if not rest:
                    if parts:
                        raise ValueError("an archive ends inside a record")
                    return
                if seen:
                    seen.update(rest)
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's length and digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + _b32(hashlib.sha1(block).digest()):
        raise ValueError(f"a broken record: {headers.get('WARC-Record-ID')}")
    return headers, block


def _page_row(data: bytes) -> tuple:
    headers, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or _b32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"a payload that does not fit its digest: {headers['WARC-Record-ID']}")
    ids = [int(headers[h]) if h in headers else None for h in ("X-Page-Id", "X-Refers-To-Page-Id")]
    return ids[0], length, digest, kind, ids[1], headers.get("WARC-Target-URI"), payload.decode() if kind == "response" else None


_PAGE = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
         ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.string())]


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False, rows: int = 1024) -> DataFrame:
    """One row per record of the files that the manifest names; sizes and digests are checked."""
    fields = _PAGE if with_payload else _PAGE[:-1]
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "sha256", "records")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def table(own: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in own], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        for batch in batches:
            for name, sha256, records in zip(*(c.to_pylist() for c in batch.columns)):
                seen, own, held, n = hashlib.sha256(), [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in members(stream, seen):
                        own.append(_page_row(data))
                        held, n = held + len(data) * with_payload, n + 1
                        if len(own) == rows or held > 16 * _CHUNK:
                            yield table(own)
                            own, held = [], 0
                if seen.hexdigest() != sha256 or n != records:
                    raise ValueError(f"{name} is not the file of the manifest")
                yield table(own)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string"
    return manifest.repartition(parts, "file").mapInArrow(read, schema + ", payload string" * with_payload)
