"""A training corpus in five stages: quality rules, language, near duplicates, repeated passages, packing.

Each stage takes all rows that the one before it kept. The first four return the columns of documents.
Rows without a doc_id cannot be linked with others and stay, as do texts without words; rows that share a
doc_id are told apart by their texts. A document whose whole text repeats others goes with its last passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import jaccard_join, language_id, packing, quality, substring_dedup
from shelfmark.llm.tables import read, stage, with_narrow


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the trees, which learn from the labels of these documents."""
    return quality.keep(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages learned from these documents."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return language_id.keep(docs, language_id.learn(known.where(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each group of texts that shingle similarity links; the docs given are
    files or staged, so that a row keeps its number from one scan to the next."""
    row = next(f"row_{n}" for n in range(len(docs.columns) + 1) if f"row_{n}" not in {c.lower() for c in docs.columns})
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    known = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, sets = jaccard_join.text_clusters(known, ("row", "doc_id"))
    linked = rows.where("n > 0 and doc_id is not null").join(sets.select("hi", "lo", "cluster"), ["hi", "lo"])
    first = linked.groupBy("cluster").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias(row))
    alone = rows.where("n = 0 or doc_id is null").select(F.col("row").alias(row))
    return with_narrow(numbered, stage(first.union(alone), "pipeline-kept"), row).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a lesser id holds as well."""
    return substring_dedup.without_passages(docs, substring_dedup.repeated_passages(docs.select("doc_id", "text")))


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batch and slot of every document left."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("known_language", known_language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("length_buckets", length_buckets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each is written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The stages cannot be expressed in SQL; tests compare them with plain versions.
ORACLE_SQL = None
