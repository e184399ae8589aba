"""Merkle manifest, WARC archives and bisector clustering against plain Python, on rows with nulls, ties, copies and clashing columns."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from clickforge.llm import bisectors, merkle, warc
from clickforge.llm.queries import QUERIES, SQL
from clickforge.llm.token_files import _store
from clickforge.session import scratch_path

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_warc", "op13_centroid_clusters"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    expected = sorted(found.fetchall(), key=repr)
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert expected and sorted(map(tuple, df.select(columns).collect()), key=repr) == expected


# ---- Merkle manifest ----------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """The top of a run of nodes, and for each node the (left, right) siblings on its way up."""
    ways = [[] for _ in nodes]
    spans = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        ups, up_spans = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a : a + 8]
            for i, span in enumerate(spans[a : a + 8]):
                for k in span:
                    ways[k].append(("".join(run[:i]), "".join(run[i + 1 :])))
            ups.append(h(*run))
            up_spans.append([k for span in spans[a : a + 8] for k in span])
        nodes, spans = ups, up_spans
    return nodes[0], ways


def manifest_by_hand(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        groups[lang].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), (doc_id, text, lang, source, n_chars)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: r[:3])
        tops[g] = climb([r[2] for r in groups[g]])
    root, over = climb([tops[g][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for (_, _, own, (doc_id, text, lang, source, n_chars)), way in zip(groups[g], tops[g][1]):
            way = way + over[n]
            start = own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                start = leaf(doc_id, source, lang, n_chars, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
            for left, right in way:
                start = h(left, start, right)
            out.append((doc_id, own, tops[g][0], root, h(*[a + b for a, b in way]), start, start == root))
    return sorted(out, key=repr)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def manifest(df):
    return sorted(map(tuple, merkle.prove(df).select(MANIFEST).collect()), key=repr)


def test_manifest_of_odd_rows(nasty, clashing, nothing):
    expected = manifest_by_hand([tuple(r) for r in nasty.collect()])
    assert manifest(nasty) == expected == manifest(clashing)
    assert merkle.prove(nothing).count() == 0
    assert manifest(nasty.filter("doc_id = 3")) == manifest_by_hand([tuple(r) for r in nasty.filter("doc_id = 3").collect()])


def test_manifest_of_several_levels(spark):
    rng = random.Random(4)
    langs = ["en"] * 30 + ["fr", "de", None, "x", "é", "日", "a1", "a2", "a3", "a4"]
    rows = [(i, f"Text {i}", rng.choice(langs), "s", i) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert manifest(docs) == manifest_by_hand(rows)


# ---- archives -----------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, shard int, body string, digest string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], PAGES).repartition(4)


def archive(spark, pages, **how):
    folder = scratch_path(spark, "warc-test")
    return folder, warc.write_warc(pages, folder, **how)


def odd_pages():
    rng = random.Random(2)
    rows = [(i, f"http://h.org/{i % 7}?q=a b\n{i}", f"<p>page {i}</p>" * rng.randint(1, 50)) for i in range(60)]
    rows += [(100 + i, "http://same.org", "<p>the same everywhere</p>") for i in range(90)]
    rows += [(300, None, None), (301, "http://e.org", ""), (None, "http://n.org", "no key"), (None, "http://n.org/2", "no key")]
    rows += [(400, "http://t.org", "twice")] * 3 + [(7, "http://seven.org", "<p>the same everywhere</p>"), (500, "http://x/é", "é日 " * 40000)]
    return rows


def records_by_hand(rows):
    last = {}
    for page, url, html in rows:
        key = (page is not None, page or 0, url is not None, url or "")
        last[html or ""] = max(last.get(html or "", (False,)), key)
    out, used = [], set()
    for page, url, html in rows:
        data = (html or "").encode()
        key, group = (page is not None, page or 0, url is not None, url or ""), html or ""
        first = key == last[group] and group not in used
        used |= {group} if first else set()
        to = last[group]
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit",
                    None if first else (to[1] if to[0] else None)))
    return sorted(out, key=repr)


def test_archive_round_trip(spark):
    rows = odd_pages()
    folder, listed = archive(spark, pages_of(spark, rows), least_shard=4_000, roll_bytes=3_000)
    files = listed.collect()
    assert len({f.shard for f in files}) > 3 and max(f.number for f in files) > 0 and sum(f.records for f in files) == len(rows)
    back = warc.read_warc(spark, folder, with_payload=True)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, back.select(columns).collect()), key=repr) == records_by_hand(rows)
    texts = {r.page_id: r.payload for r in back.filter("record_type = 'response'").collect()}
    assert texts[500] == "é日 " * 40000 and texts[5] == rows[5][2]


def test_archives_do_not_depend_on_partitions(spark):
    rows = odd_pages()
    first = archive(spark, pages_of(spark, rows), least_shard=4_000, roll_bytes=3_000)[1].collect()
    random.Random(1).shuffle(rows)
    again = archive(spark, pages_of(spark, rows).repartition(9), least_shard=4_000, roll_bytes=3_000)[1].collect()
    assert sorted(first) == sorted(again)


def test_empty_archive_and_frequent_payloads(spark):
    folder, listed = archive(spark, pages_of(spark, odd_pages()).limit(0))
    assert listed.count() == warc.read_warc(spark, folder).count() == 0
    marks = warc._marks(pages_of(spark, odd_pages()), "page_id", "url", "html")
    pairs = [sorted(map(tuple, warc.revisits(marks, share).collect()), key=repr) for share in (1, 10, 10**6)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) == 90 + 1 + 1


def test_reader_finds_damage(spark):
    folder, listed = archive(spark, pages_of(spark, odd_pages()[:5]))
    store, root = _store(folder)
    path = f"{root}/{listed.first().file}"
    with store.open_input_stream(path, compression=None) as f:
        data = bytearray(f.read())
    data[4] ^= 1  # a byte of the gzip header's time: every record still unpacks
    with store.open_output_stream(path, compression=None) as f:
        f.write(bytes(data))
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_warc(spark, folder).count()


def test_records_are_gzip_members():
    import gzip

    own = warc.page_record(3, hashlib.sha1(b"abc").hexdigest(), "http://a/ b", b"abc", 0, None, warc.DATE)
    headers, block = warc.parse(gzip.decompress(own))
    assert headers["WARC-Target-URI"] == "http://a/%20b" and block.endswith(b"\r\n\r\nabc")
    assert own == warc.page_record(3, hashlib.sha1(b"abc").hexdigest(), "http://a/ b", b"abc", 0, None, warc.DATE)


# ---- clustering ---------------------------------------------------------------------------------


def clusters_by_hand(rows, k, rounds, dim, scale, seed):
    import math

    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    off = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((off(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, members in own.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    total = collections.Counter()
    for _, n, d in placed:
        total[n] += d
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in placed), key=repr)


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("dim,k,rounds", [(2, 5, 4), (3, 8, 10), (1, 3, 2)])
def test_clusters_with_ties_and_odd_vectors(spark, dim, k, rounds):
    rng = random.Random(dim)
    # a coarse grid: many equal vectors, ties and empty clusters
    rows = [(i, [rng.choice([-2.0, -0.5, 0.0, 0.25, 1.0, 3.0]) for _ in range(dim)]) for i in range(200)]
    rows += [(900, None), (901, [1.0] * (dim + 1)), (902, [float("nan")] * dim), (903, [float("inf")] + [0.0] * (dim - 1)), (904, [None] * dim), (905, [])]
    rows += [(None, [0.1] * dim), (7, [2.0] * dim), (7, [2.0] * dim)]
    data = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, key int, cluster int").repartition(3)
    got = bisectors.cluster(data, k=k, rounds=rounds, dim=dim)
    assert sorted(map(tuple, got.select(CLUSTER).collect()), key=repr) == clusters_by_hand(rows, k, rounds, dim, 1024, "3")
    assert bisectors.cluster(data.limit(0), dim=dim).count() == 0
    few = bisectors.cluster(data.filter("vec_id < 2"), k=k, dim=dim)
    assert sorted(map(tuple, few.select(CLUSTER).collect()), key=repr) == clusters_by_hand(rows[:2], k, 10, dim, 1024, "3")


def test_tournament_is_exact_for_large_numbers(spark):
    rng = np.random.default_rng(1)
    limit = bisectors.largest(64)
    centroids, points = rng.integers(-limit, limit + 1, (8, 64)), rng.integers(-limit, limit + 1, (200, 64))
    points[:50] = centroids[rng.integers(0, 8, 50)]
    sides = bisectors.Bisectors(centroids)
    winner = sides.nearest(points)
    expected = [min((sum((int(x) - int(y)) ** 2 for x, y in zip(p, c)), n) for n, c in enumerate(centroids)) for p in points]
    assert [(int(d), int(w)) for d, w in zip(sides.distance(points, winner), winner)] == expected
    huge = spark.createDataFrame([(1, [1e300])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit 64 bits"):
        bisectors.cluster(huge, dim=1)
