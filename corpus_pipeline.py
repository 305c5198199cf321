"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents, and
any others that are there; n_chars follows the text.  Rows of null or empty text go the way of
all others: the classifier scores them by the share of good labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import fm_index, minhash_forest, pii_crf, quality_crf, trie_bpe
from orrery.llm.stages import saved, shipped, small, table, tokenizer_path, unused


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF scores below 0.5 go; repeated rows are judged alike, an empty table stays one."""
    shipped(spark)
    model, score = quality_crf.fit(docs, table(spark, sf_dir, "labels")), unused("score", docs.columns)
    return quality_crf.with_scores(docs, model, score=score).where(F.col(score) >= 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that of smallest id; of equal ids any one, and a null id only if there is no other.

    Each row is a document of its own: of repeated rows, of one id or of null ids, one stays, and rows of one id that
    are no near copies all do.  An empty table stays one.
    """
    shipped(spark)
    row = unused("row", docs.columns)
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "rows")  # the same ids in every pass
    found = saved(minhash_forest.near_duplicates(rows.select(row, "text"), key=row), "near").select(F.col("doc_id").alias(row), "component_id", "kept")
    shared = found.where(~F.col("kept")).select("component_id").distinct()
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    members = found.join(shared, "component_id", "left_semi").join(rows.select(row, "doc_id"), row).select("component_id", order.alias("at"))
    best = members.groupBy("component_id").agg(F.min("at").alias("best"))
    best = small(saved(best, "best"), minhash_forest.BROADCAST_IDS)  # a large component is not joined in one task
    copies = saved(members.join(best, "component_id").where(F.col("at") != F.col("best")).select(f"at.{row}"), "copies")
    return rows.join(small(copies, minhash_forest.BROADCAST_IDS), row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut from the texts; all rows stay, repeated ones too, and a null text stays null."""
    clean = fm_index.remove(docs, table(shipped(spark), sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets; all rows stay, repeated ones too, and a null text stays null."""
    shipped(spark)
    clean = pii_crf.redacted(docs, pii_crf.fit(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests of ids and decoded text, and the ids, a row for each row; of null and empty texts no ids."""
    shipped(spark)
    return trie_bpe.digests(docs, tokenizer_path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE", token_ids),
]

#: SQL can express none of the five stages; they are tested against brute force and round trips.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
