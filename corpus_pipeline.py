"""A training corpus from `documents`: drop toxic texts, exact copies, near copies and benchmark leaks, then mix sources.

Each stage takes (spark, docs, sf_dir), with docs read from Parquet, and returns a frame; all but the last return the
columns of documents. Of equal texts the largest doc_id stays, of near copies the smallest. Near copies are linked on
shingles of five words: by SimHash, then, among what it leaves, by Jaccard similarities of 0.8 or more. The last stage keeps every document and says how many copies of it the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, exactdedup, mixing, setjoin, simhash, toxicity
from ledgerloom.llm.stages import written

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels whose crc32(doc_id) mod 3 is not 1, as op1 does."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 == 1)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fingerprints find the closest copies at little cost, the exact join all others at the stated similarity."""
    return setjoin.drop_near_sets(simhash.drop_near_copies(docs, shingle_words=5), words=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("simhash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
