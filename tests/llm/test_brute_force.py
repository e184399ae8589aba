"""Registered queries against plain Python over whole tables."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from clickforge.llm import mixing, packing, simhash, toxicity
from clickforge.llm.queries import QUERIES
from clickforge.llm.components import components

FOLDER = "/root/testdata/sf0.001"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{FOLDER}/documents.parquet' order by 1").fetchall()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_id(spark, name):
    return {r.doc_id: r for r in QUERIES[name](spark, FOLDER).collect()}


def test_quality(spark, docs):
    got = by_id(spark, "op1_quality_rules")
    assert len(got) == len(docs)
    for k, text in docs:
        words = SPACED.findall(text)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        inside = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (
            len(words), sum(map(len, words)), len(lines) - len(set(lines)), len(inside))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(words) < 50 or 100 * len(inside) > 50 * len(words))
        assert not (r.base_failed and r.kept)
    truth = dict(duckdb.sql(f"select doc_id, quality from '{FOLDER}/labels.parquet'").fetchall())
    judged = [(got[k].kept, q) for k, q in truth.items() if not got[k].base_failed]
    assert np.mean([a == bool(q) for a, q in judged]) > 0.95


def test_mixing_equals_sql(spark):
    from clickforge.llm.queries import SQL

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    expected = sorted(con.sql(SQL["op2_source_mixing"]).fetchall())
    assert expected and sorted(map(tuple, QUERIES["op2_source_mixing"](spark, FOLDER).collect())) == expected


def components_by_hand(marks):
    m, root = np.array(marks, np.uint64), list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(m)):
        for j in np.flatnonzero(np.bitwise_count(m[i] ^ m[i + 1 :]) <= 4) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(m))]


def test_simhash(spark, docs):
    got = by_id(spark, "op3_simhash_near_dedup")
    marks = []
    for k, text in docs:
        words = SPACED.findall(lower(text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        ones = np.sum([[xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for b in range(64)] for s in shingles] or [[0] * 64], axis=0)
        marks.append(sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles)))
        assert got[k].fingerprint == f"{marks[-1]:016x}"
    assert [got[k].component_id for k, _ in docs] == [docs[r][0] for r in components_by_hand(marks)]


@pytest.mark.parametrize("crowd", [4096, 20])
def test_trie_join_on_families(spark, crowd):
    import random

    rng, marks = random.Random(3), set(range(40))
    for _ in range(25):
        x = rng.getrandbits(64)
        marks.add(x)
        for _ in range(rng.choice([0, 5, 80])):
            y = x
            for _ in range(rng.randint(1, 6)):
                y ^= 1 << rng.randrange(64)
            marks.add(y)
            x = y if rng.random() < 0.2 else x
    marks = sorted(marks)
    signed = [x - (1 << 64) if x >> 63 else x for x in marks]
    found = {r.vertex: r.root for r in components(simhash.links(spark.createDataFrame([(x,) for x in signed], "mark long"), crowd)).collect()}
    groups = lambda keys: sorted(sorted(k for k, g in zip(signed, keys) if g == v) for v in set(keys))
    assert groups([found.get(x, x) for x in signed]) == groups(components_by_hand(marks))


def test_one_document_of_each_group_stays(spark, docs):
    marks = [simhash.fingerprint(text) for _, text in docs]
    stay = {docs[r][0] for r in components_by_hand(marks)}
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in simhash.one_of_each(rows).collect()) == sorted(stay)


def test_licences(spark, docs):
    got = by_id(spark, "op4_licence_scan")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for k, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts, r = [i for i, _ in places], got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}


def encoded(docs, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: np.array(tokenizer.encode(text, add_special_tokens=False).ids + [end], "<u4") for k, text in docs}


def best_fit(lengths, size):
    """Room left in each sequence of best-fit decreasing, one piece after another."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= length]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= length
        else:
            rooms.append(size - length)
    return rooms


def test_packing(spark, docs):
    rows = QUERIES["op5_best_fit_packing"](spark, FOLDER).collect()
    expected = {(k, a // 2048): (a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()))
                for k, ids in encoded(docs, "word_bpe_49k.json", 0).items() for a in range(0, len(ids), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    assert len({r.sequence_id for r in rows}) == len(best_fit([r.length for r in rows], 2048))


def test_plan_is_best_fit_decreasing():
    import random

    rng = random.Random(5)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, rng.choice([5, 50, 100])) for _ in range(rng.randint(1, 300)))
        rooms, used = best_fit(counts.elements(), 100), set()
        for length, first, end, per, sequence, _ in packing.plan(counts, 100):
            used |= {sequence + i // per for i in range(end - first)}
        assert len(used) == len(rooms)


def test_token_files(spark, docs):
    start, expected = 0, []
    for k, ids in encoded(docs, "byte_bpe_50k.json", 2).items():
        expected.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op10_token_files"](spark, FOLDER).collect())) == expected


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    from clickforge.llm.tokens import TextEncoder

    own = TextEncoder(public_tokenizers.path(name))
    texts = ["", " ", "a  b", "x \n y", "don't I'll 12 3.5 ½", "tail ", "\nlead", "日本語", "İstanbul", "foo\n\n bar", "'s 'll", "²³ 10² aª",
             "<|endoftext|> x", "hi <|endoftext|> x", "<|startoftext|>", "a<|startoftext|>b <|endoftext|>", "<|ENDOFTEXT|> <|endoftext", "a\u00a0b",
             "soft\u00adhyphen", "ﬁ Å"]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    texts += [f"x {t} y{t}" for t in map(str, (fresh.id_to_token(i) for i in fresh.get_added_tokens_decoder()))]
    for text, e in zip(texts, fresh.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == np.array(e.ids, own.dtype).tobytes(), text


def test_containment(spark, docs):
    got, order = by_id(spark, "op8_containment_fingerprints"), docs[::-1]
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def sketch(text):
        words, every = SPACED.findall(text), set()
        for i in range(max(1, len(words) - 4) if words else 0):
            h = 42
            for w in words[i : i + 5]:
                h = xxhash.xxh64_intdigest(w.encode(), h)
            every.add(h)
        return sorted([h for h in every if h >> 61 == 0] or sorted(every, key=signed)[:1], key=signed)

    for i, (k, text) in enumerate(order):
        follow, cut = order[(i + 1) % len(order)][1], len(text) // 3
        edited = text[: len(text) - cut] + follow[:cut]
        a, b, c = map(sketch, (text, edited, follow))
        like = lambda x, y: 1.0 if not x and not y else len(set(x) & set(y)) / min(len(x), len(y)) if x and y else 0.0
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{h:016x}" for h in a) and r.edited_fingerprint == "".join(f"{h:016x}" for h in b)
        assert abs(r.near_edited - like(a, b)) < 1e-9 and abs(r.near_next - like(a, c)) < 1e-9


def test_pages(spark):
    got = {r.page_id: r for r in QUERIES["op6_html_wrappers"](spark, FOLDER).collect()}
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
    judged = {r.page_id: r for r in QUERIES["op9_url_graph_filter"](spark, FOLDER).collect()}
    for k, url, page in duckdb.sql(f"select page_id, url, html from '{FOLDER}/pages.parquet'").fetchall():
        inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", inside)]
        assert got[k].text == "\n".join(filter(None, blocks)) and got[k].n_chars == len(got[k].text)
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        r = judged[k]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_distrust_reaches_hosts_that_link_to_blocked_ones(spark):
    from clickforge.llm import url_graph

    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://good.org/x", link("liked.net")), (3, "http://farm.net/x", link("bad.com")),
            (4, "http://liked.net/x", ""), (5, "http://alone.net/x", "")]
    got = {r.page_id: r for r in url_graph.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k].verdict for k in range(1, 6)] == ["block", "allow", "block", "allow", "allow"]
    assert got[3].distrust > 0 and got[4].trust > 0
    assert abs(sum(r.trust for r in got.values()) - 1) < 1e-6


def test_links_without_a_scheme_are_links_between_hosts(spark):
    from clickforge.llm import url_graph

    page = "<a href='//Other.org/x'>a</a><a href=https://third.org>b</a><a href='/own//path'>c</a><a href='x//y'>d</a>"
    pages = spark.createDataFrame([("http://a.org/", page)], "url string, html string")
    assert sorted(r.target for r in url_graph.host_edges(pages).collect()) == ["other.org", "third.org"]


def test_toxicity_is_right_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, folder).collect()}
    truth = duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in rows.items())
    own = [(rows[k].score, y) for k, y in truth if rows[k].held_out]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in own]) > 0.9


def test_pipeline_stages_follow_from_their_operators(spark):
    """Ids and counts of every stage, recomputed from its input by plain Python or by the operator of the stage."""
    stages, folder = dict(corpus_pipeline.STAGES), FOLDER
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    good = stages["quality rules"](spark, rows, folder)
    assert sorted(r.doc_id for r in good.collect()) == sorted(k for k, r in by_id(spark, "op1_quality_rules").items() if r.kept)
    clean = stages["toxicity"](spark, good, folder)
    scored = toxicity.score_documents(good, spark.read.parquet(f"{folder}/labels.parquet"))
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scored.collect() if not r.predicted)
    own = sorted((r.doc_id, r.text or "") for r in clean.collect())
    stay = {own[r][0] for r in components_by_hand([simhash.fingerprint(t) for _, t in own])}
    single = stages["near-dedup"](spark, clean, folder)
    assert {r.doc_id for r in single.collect()} == stay and single.count() == len(stay)
    mixed = collections.Counter(r.doc_id for r in stages["source mixing"](spark, single, folder).collect())
    assert mixed == copies_by_hand(single.collect())
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and collections.Counter(r.doc_id for r in out if r.piece == 0) == mixed
    lengths = collections.defaultdict(int)
    for r in out:
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= 2048 and len(lengths) == len(best_fit([r.length for r in out], 2048))


def copies_by_hand(rows):
    """Poisson counts of the documents, source weights proportional to the square root of the sources' sizes."""
    import math

    sizes = collections.Counter(r.source for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    out = collections.Counter()
    for r in rows:
        mean = math.sqrt(sizes[r.source]) / total * len(rows) / sizes[r.source]
        u = (int(hashlib.md5(f"42:{r.doc_id}:count".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        reached, n = math.exp(-mean), 0
        while reached < u:
            n += 1
            reached += math.exp(-mean + n * math.log(mean) - math.lgamma(n + 1))
        if n:
            out[r.doc_id] = n
    return out
