"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import itertools
import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clickforge.llm import containment, licences, mixing, packing, quality, simhash, token_files, toxicity, url_graph, wrappers
from clickforge.session import scratch_path

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def files(docs):
    spark = docs.sparkSession
    return token_files.read_token_files(spark, token_files.write_token_files(docs, scratch_path(spark, "t"), BYTE, 2))


BY_ROW = {
    "quality": quality.score_quality,
    "simhash": simhash.near_duplicates,
    "licences": licences.scan_licences,
    "containment": containment.compare_edited,
    "files": files,
}


@pytest.mark.parametrize("name", sorted(BY_ROW))
def test_one_row_per_document(name, nasty, clashing, nothing):
    apply = BY_ROW[name]
    assert apply(nasty).count() == nasty.count()
    assert apply(clashing).count() == nasty.count()
    assert apply(nothing).count() == 0


def test_quality_values(nasty):
    rows = {r.doc_id: r.quality for r in quality.score_quality(nasty).collect()}
    assert (rows[2].n_words, rows[2].word_chars, rows[2].base_failed, rows[2].kept) == (0, 0, True, False)
    assert rows[3].n_words == rows[4].n_words == 0
    assert (rows[5].n_words, rows[5].n_repeat_words, rows[5].base_failed) == (30000, 30000, True)
    assert rows[1].n_words == 180 and rows[1].n_repeat_words == 180
    assert rows[8].n_symbols == 3


def test_simhash_values(nasty):
    rows = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(nasty).collect()}
    assert rows[2, "0" * 16] == rows[3, "0" * 16] == rows[4, "0" * 16] == 2
    assert sum(1 for r in simhash.one_of_each(nasty).collect() if r.doc_id == 6) == 2  # two texts, one of the copies
    assert simhash.one_of_each(nasty).columns == nasty.columns


def test_licence_values(nasty):
    rows = {r.doc_id: r for r in licences.scan_licences(nasty).filter("doc_id = 2 or n_base > 0").collect()}
    assert (rows[2].n_words, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "", 0.0)
    assert (rows[6].first_word, rows[6].last_word, rows[6].base_labels, rows[6].labels) == (3, 3, "apache", "apache,apache-2.0")
    twice = licences.Index(10, {}).scan(licences.cut_words("MIT license, mit LICENSE; general public license"))[0]
    assert sorted(twice) == [(0, "mit"), (2, "mit"), (4, "gpl")]


def test_containment_values(nasty):
    rows = {(r.doc_id, r.n_chars): r for r in containment.compare_edited(nasty).collect()}
    assert rows[2, 0].fingerprint == "" and rows[3, 0].near_next == 1.0  # next of 3 is 2, both empty
    assert len({r.fingerprint for k, r in rows.items() if k == (6, 47)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows.values())


def test_packing(spark, nasty, clashing, nothing):
    from collections import defaultdict

    for docs in (nasty, clashing):
        rows = packing.pack(docs, WORD, 0, with_ids=True).collect()
        assert sum(r.piece == 0 for r in rows) == nasty.count()
        places = defaultdict(list)
        for r in rows:
            assert len(r.ids) == r.length <= 2048
            places[r.sequence_id].append((r.offset, r.length))
        for own in places.values():
            ends = 0
            for at, n in sorted(own):
                assert at == ends
                ends += n
            assert ends <= 2048
    assert packing.pack(nothing, WORD, 0).count() == 0


def test_mixing(nasty, clashing, nothing):
    for docs in (nasty, clashing):
        mixed = mixing.mix(docs, weights={"a": 3.0, None: 1.0}, total=4000)
        assert mixed.columns == docs.columns
        seen = {r[0]: r[1] for r in mixed.groupBy("source").count().collect()}
        assert set(seen) == {"a", None} and 2500 < seen["a"] < 3500 and 700 < seen[None] < 1300
    assert mixing.mix(nothing).count() == 0
    assert sorted(map(str, mixing.mix(nasty).collect())) == sorted(map(str, mixing.mix(nasty.repartition(7)).collect()))


def test_merged_fingerprints_are_those_of_all_shingles(spark):
    rng = random.Random(1)
    lots = [[rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([0, 1, 1, 2, 5, 30]))] for _ in range(300)]

    def sketch(every):
        return sorted(h for h in set(every) if 0 <= h < 2**61) or sorted(set(every))[:1]

    rows = [(sketch(a), sketch(b), sketch(c), sketch(a + b + c)) for a, b, c in zip(lots[::3], lots[1::3], lots[2::3])]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>, c array<long>, whole array<long>")
    merge = containment.merge
    for r in frame.select("whole", merge(merge(F.col("a"), F.col("b")), F.col("c")).alias("x"), merge(F.col("c"), merge(F.col("b"), F.col("a"))).alias("y")).collect():
        assert r.x == r.y == r.whole
    # texts: the same as the sketch of both texts' shingles, and of a text with itself
    texts = spark.createDataFrame([("one two three four five six " * 3,), ("short text",), ("",), (None,)], "t string")
    own = texts.select(containment.hashes(F.coalesce("t", F.lit(""))).alias("h")).collect()
    assert [r.x for r in spark.createDataFrame([(r.h, r.h) for r in own], "a array<long>, b array<long>").select(merge(F.col("a"), F.col("b")).alias("x")).collect()] == [r.h for r in own]


def test_toxicity(nasty, clashing, nothing, labels):
    for docs in (nasty, clashing):
        rows = toxicity.score_documents(docs, labels).collect()
        assert len(rows) == nasty.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score_documents(nothing, labels).count() == 0
    assert {r.score for r in toxicity.score_documents(nasty, labels.limit(0)).collect()} == {0.0}
    assert "idiot" in toxicity.words_in("you i d i o t, an id-iot")


def test_pages(spark):
    rows = [
        (1, "http://a.example.org/es/1", "<article><p>Caf&eacute; <b>au</b>\n lait<p>two"), (2, None, None), (3, "no scheme", ""),
        (4, "https://B.com/de/x?y#z", "<nav><a href='http://a.example.org/en/1'>menu</a></nav><div>body text</div><footer>f</footer><p"),
        (None, "x://org", "<div class='cookie-notice'>no</div><main>yes<script>1<2</script><aside>no</aside></main>"),
        (4, "https://B.com/de/x?y#z", "<form>no</form><div>other text</div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = sorted(((r.page_id or 0), r.text, r.n_chars) for r in wrappers.extract_text(pages).collect())
    assert text == [(0, "yes", 3), (1, "Café au lait\ntwo", 16), (2, "", 0), (3, "", 0), (4, "body text", 9), (4, "other text", 10)]
    seen = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_graph.judge(pages).collect()}
    assert seen == {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "b.com", "/de/x", "com/de/", "block"), (None, "org", "", None, "allow"),
    }
    crowd = pages.selectExpr("*", "'x' as host", "'y' as content", "'z' as wrapper", "1 as salt", "2 as _key", "3 as _html", "4 as text", "5 as n_chars")
    assert text == sorted(((r.page_id or 0), r.text, r.n_chars) for r in wrappers.extract_text(crowd).collect())
    assert wrappers.extract_text(pages.limit(0)).count() == url_graph.judge(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    page = "<div>own text<ul><li>same<li>same</ul></div>"
    rows = [(k, "http://copies.org/x", page + f"<!-- {k} -->") for k in range(40)] + [(90, "http://one.org/x", page)]
    rows += [(k, "http://two.org/x", "<div>first</div><section>only here</section>") for k in range(50, 53)] + [(60, "http://two.org/y", "<div>second</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    assert {got[k] for k in [*range(40), 90]} == {"own text\nsame\nsame"}
    assert got[50] == "first\nonly here" and got[60] == "second"


def test_wrapper_decides_per_layout_and_inside_articles(spark):
    box = "<div class='x1'>Share it with friends</div>"
    rows = [(k, "http://both.org/x", f"<article><p>story {k}</p>{box}<div class='x2'>note {k}</div></article>") for k in range(4)]
    rows += [(k, "http://both.org/y", f"<div class='x3'>Same on each page</div><section>plain page {k}</section>") for k in range(4, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    assert got == {k: f"story {k}\nnote {k}" if k < 4 else f"plain page {k}" for k in range(8)}


def test_names_of_all_elements_and_names_that_mislead(spark):
    rows = [(k, "http://names.org/x", f"<h1 class='header'>Title {k}</h1><article><p>story {k}</p><p class='advert'>buy {k}<p>more {k}</p>"
             f"<div class='share-price'>price {k}</div><section class='related-work'>work {k}</section><div class='share-links'>send {k}</div>"
             f"<div class='related'>see {k}</div><div class='replies'>reply {k}</div><button>press {k}</button></article>") for k in range(4)]
    rows += [(k, "http://plain.org/x", f"<head><title>t</title><body><span class='cookie-note'>we bake {k}</span><div>text {k}</div>") for k in range(4, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in wrappers.extract_text(pages).collect()}
    assert got == {k: f"story {k}\nmore {k}\nprice {k}\nwork {k}" if k < 4 else f"text {k}" for k in range(8)}


def test_wrapper_does_not_depend_on_the_order_of_pages(spark):
    bodies = ["<div>a<p>b</p></div><section>x</section>", "<section>x</section><div>a<p>c</p></div>", "<div>d</div><ul><li>x</ul>", "<ul><li>x</ul><div>a</div>"]
    seen = set()
    for order in itertools.permutations(range(4)):
        pages = spark.createDataFrame([(k, "http://o.org/x", bodies[k]) for k in order], "page_id long, url string, html string")
        host = wrappers.infer_wrappers(pages.repartition(1 + order[0])).collect() if order[:2] in [(0, 1), (3, 2), (2, 0)] else []
        seen |= {r.content for r in host}
    assert len(seen) == 1


def test_long_and_broken_pages_take_time_in_proportion():
    shapes = {"quote": "<a b=\"", "lone": "<a b='x>t", "deep": "<div>x", "ends": "<div></ul>", "open": "<", "class": "<p class='", "comment": "<!-", "mixed": "<p>t<b>u</b>"}
    for name, piece in shapes.items():
        pages = [piece * n + tail for n in (20000, 40000) for tail in ("", "<b>z</b>y")]
        began = time.monotonic()
        own = [wrappers.wrapper_of(p) for p in pages]
        merged = wrappers.infer(iter(own))
        content = {k: set(v) for k, v in wrappers.decide(merged).items()}
        texts = [wrappers.extract(p, content) for p in pages]
        assert time.monotonic() - began < 60, name  # a step that grows with the square would take hours
        assert len(texts) == 4
    assert wrappers.extract("<article><a b='x>link</a> text", {"main": {wrappers.below(wrappers.TOP, "article")}, "rich": set(), "roots": {wrappers.below(wrappers.TOP, "article")}}) == "link text"


def test_wrapper_grows_less_and_less_on_random_markup():
    rng = random.Random(5)
    page = lambda: "".join(f"<{t}>{rng.random()}</{t}>" for t in rng.choices("bius", k=60))
    sizes, merged = [], None
    for _ in range(200):
        own = wrappers.wrapper_of(page())
        merged = own if merged is None else wrappers.align(merged, own)
        sizes.append(len(merged))
    assert sizes[199] - sizes[99] < (sizes[99] - sizes[0]) / 2


def test_alignment_keeps_every_node_in_order():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcdefg", k=rng.randrange(12))) for _ in range(2))
        pairs = wrappers._matches(list(a), list(b))
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        merged = wrappers.align([["t", x] for x in a], [["t", x] for x in b])
        assert len(merged) == len(a) + len(b) - len(pairs)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, nasty, clashing, nothing, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (nasty, clashing, nothing):
        out = stage(spark, docs, str(tmp_path))
        out.count()
        assert (out.columns == docs.columns) == (name != "best-fit packing")
