"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fm_index, huffman_files, license_rules, minhash_forest, pii_crf, quality_crf, sharding, trie_bpe, url_rules
from .stages import shared_folder, shipped, table, tokenizer_path


def op1_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op2_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_crf.spans(docs, pii_crf.fit(docs))


def op3_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = sharding.with_slots(docs).select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), "virtual_slot"
    )
    weights = sharding.weigh(docs)
    folder = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.store_map(sharding.map_table(spark, 1, sharding.assign(weights, 16), weights), folder)
    first = {r.slot: r.shard for r in sharding.load_map(spark, folder).collect()}  # as many rows as there are slots
    sharding.store_map(sharding.map_table(spark, 2, sharding.rebalance(first, weights, 16), weights), folder)
    return sharding.place(docs, sharding.load_map(spark, folder)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.occurrences(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_huffman_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = huffman_files.write(docs, tokenizer_path("byte_bpe_50k.json"))
    return huffman_files.read(spark, folder, with_ids=False)


def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_crf.with_scores(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(quality_crf.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_rules.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return trie_bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands beside the package

    return corpus_pipeline.run(spark, sf_dir)


_OP6_SQL = r"""
WITH cut AS (
  SELECT page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN ''
              ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) + length(rpath)) AS rule,
         arg_max(r.verdict, length(rhost) + length(rpath)) AS verdict
  FROM parts p JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""


#: Rules of one sentence; of the longer ones the driver's tables hold none.
_NOTICES = ", ".join(
    f"('{name}', trim(regexp_replace(lower('{texts[0]}'), '[^0-9a-z]+', ' ', 'g')))" for name, texts in license_rules.RULES if len(texts) == 1
)

_OP9_SQL = rf"""
WITH notices(name, words) AS (VALUES {_NOTICES}),
cut AS (
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '[.!?][^0-9A-Za-z\x80-\x{{10FFFF}}]*?([ \t\n\x0B\f\r]|$)')) AS sentence FROM documents
  UNION ALL
  SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\n|[.!?][^0-9A-Za-z\x80-\x{{10FFFF}}]*?([ \t\n\x0B\f\r]|$)')) AS sentence FROM documents
), hits AS (
  SELECT DISTINCT doc_id, name
  FROM cut JOIN notices ON words = trim(regexp_replace(lower(sentence), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))
)
SELECT d.doc_id, count(h.name) AS n_licenses, coalesce(string_agg(h.name, ',' ORDER BY h.name), '') AS licenses
FROM documents d LEFT JOIN hits h USING (doc_id)
GROUP BY d.doc_id
"""

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lsh_forest": op1_lsh_forest,
    "op2_skip_chain": op2_skip_chain,
    "op3_virtual_slots": op3_virtual_slots,
    "op4_fm_index": op4_fm_index,
    "op5_divergence": op5_divergence,
    "op6_url_rules": op6_url_rules,
    "op7_huffman_files": op7_huffman_files,
    "op8_line_crf": op8_line_crf,
    "op9_license_rules": op9_license_rules,
    "op10_trie_bpe": op10_trie_bpe,
    "pipeline": pipeline,
}

_SQL = {"op6_url_rules": _OP6_SQL, "op9_license_rules": _OP9_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(f):
        return lambda spark, sf_dir: f(shipped(spark), sf_dir)

    return {k: ready(f) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
