"""The numbered queries: each operator with its production parameters on its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickforge.llm import (
    bisectors, containment, licences, merkle, mixing, packing, quality, simhash, token_files, toxicity, url_graph, warc, wrappers,
)
from clickforge.llm.statements import MERKLE_SQL, WARC_SQL, cluster_sql
from clickforge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_quality_rules")
def quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs.select("doc_id", F.col("text")), drop_text=True)
    q = scored.columns[-1]
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return scored.select("doc_id", *[F.col(q)[m].alias(m) for m in measures], F.round(F.col(q)["score"], 6).alias("score"))


MIXING_SQL = """
with sizes as (select source, count(*) as n, sqrt(count(*)) as w from documents group by source),
means as (select source, w / sum(w) over () * sum(n) over () / n as mean from sizes),
steps as (select source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) over (partition by source order by k) as reached
  from means, range(0, 500) r(k)),
drawn as (select doc_id, source, (cast('0x' || substr(md5('42:' || doc_id || ':count'), 1, 13) as bigint)::double + 0.5)
  / 4503599627370496.0 as u from documents),
counted as (select doc_id, drawn.source, (select count(*) from steps s where s.source = drawn.source and s.reached < u) as n from drawn)
select doc_id, source, unnest(range(0, n)) as copy from counted
"""


@query("op2_source_mixing", MIXING_SQL)
def source_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mixing.mix(docs, copy="copy").select("doc_id", "source", F.col("copy").cast("bigint").alias("copy"))


@query("op3_simhash_near_dedup")
def simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_licence_scan")
def licence_scan(spark, folder):
    return licences.scan_licences(table(spark, folder, "documents"))


@query("op5_best_fit_packing")
def best_fit_packing(spark, folder):
    docs = table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


@query("op6_html_wrappers")
def html_wrappers(spark, folder):
    return wrappers.extract_text(table(spark, folder, "pages"))


@query("op7_toxicity")
def toxic_documents(spark, folder):
    return toxicity.score_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_containment_fingerprints")
def containment_fingerprints(spark, folder):
    return containment.compare_edited(table(spark, folder, "documents"))


@query("op9_url_graph_filter")
def url_graph_filter(spark, folder):
    return url_graph.judge(table(spark, folder, "pages"))


@query("op10_token_files")
def token_id_files(spark, folder):
    docs = table(spark, folder, "documents")
    files = token_files.write_token_files(
        docs, scratch_path(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return token_files.read_token_files(spark, files)


@query("op11_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark, folder):
    return merkle.prove(table(spark, folder, "documents"))


@query("op12_warc", WARC_SQL)
def warc_archives(spark, folder):
    archive = scratch_path(spark, "warc")
    warc.write_warc(table(spark, folder, "pages"), archive)
    return warc.read_warc(spark, archive).drop("target_uri")


@query("op13_centroid_clusters", cluster_sql(bisectors.CLUSTERS, bisectors.ROUNDS, bisectors.DIM, bisectors.SCALE, bisectors.SEED))
def centroid_clusters(spark, folder):
    return bisectors.cluster(table(spark, folder, "embeddings"))
