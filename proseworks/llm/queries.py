"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseworks.llm import decontam, embedding_dedup, near_dedup, packing, pii, quality, sharding, token_store, toxicity, url_filter
from proseworks.llm.common import held_out, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    out = sharding.assign_shards(docs, 24, keep=["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings"), 0.98)


def op5_chosen_path_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op6_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.found(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    every = lambda c: F.regexp_count(c, F.lit("[a-z]+:")).cast("long")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "secrets", (every("spans") + every("secrets")).alias("n_found"))


#: The rules of the registered query, fixed values: host, path, action.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op7_range_join_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op8_zstd_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = token_store.write_tokens(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_store.read_tokens(manifest, folder, ids=False)


def op9_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_histogram_sort, op2_line_crf_quality, op3_best_fit_packing, op4_inverted_multi_index, op5_chosen_path_near_duplicates,
        op6_boosted_pii, op7_range_join_url_rules, op8_zstd_token_files, op9_seeded_alignment, op10_compression_toxicity,
    )
}

_URL_SQL = r"""
WITH part AS (
  SELECT page_id, url, strpos(url, '://') AS pos FROM pages
), cut AS (
  SELECT page_id,
         CASE WHEN pos > 0 THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM part
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM cut LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fit WHERE n = 1
"""

#: DuckDB SQL that gives the same rows by another way, where SQL can say it.
ORACLE = {"op7_range_join_url_rules": _URL_SQL}
