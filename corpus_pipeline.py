"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, mixing to target weights, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with their columns; the last returns
tokens. Each works on all that the one before kept. run() applies them to the table of documents, each stage's result
a Parquet table in the shared folder.

Each stage's table goes when the next one is written. Nulls: a null text has no words; the classifier scores it like an empty one. Documents that the line stage empties go
with it; those that were empty before stay. The near-duplicate stage links documents whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more and keeps, of each group, the document with the smallest id. The mix repeats
documents whose source is wanted more than once over, and cuts the text that reaches a source's target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from infotraj.llm import bpe, linededup, mixing, quality, simhash
from infotraj.llm.common import free, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mixing.mix(docs)
    return out.withColumn("n_chars", F.when(F.col("taken") < F.col("size"), F.length("text")).otherwise(F.col("n_chars"))).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, bpe.vocabulary_path()).select(F.col("id").alias("doc_id"), "n_tokens", "ids")


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("source_mixing", mixed),
    ("bpe_encoding", encoded),
]

#: The classifier and the token merges are beyond SQL; tests hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        if before is not None:
            free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
