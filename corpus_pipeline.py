"""A training-data pipeline of five operators over the documents table.

Quality rules, toxicity, near duplicates, mixing to target weights, BPE encoding: each
stage takes (spark, docs, sf_dir), works on every row that the stage before kept, and
returns the documents that stay, in the columns of documents; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.llm.bpe_codec import bpe_encode
from sparkwarden.llm.common import stored
from sparkwarden.llm.mixing import mixed_documents
from sparkwarden.llm.quality_rules import quality_filter
from sparkwarden.llm.queries import table, vocabulary
from sparkwarden.llm.simhash import near_duplicate_filter
from sparkwarden.llm.toxicity import toxicity_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_filter(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold."""
    return toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_duplicate_filter(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document of the mix."""
    ids = bpe_encode(docs, vocabulary("word_bpe_49k.json"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("simhash_near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("bpe_encoding", encoding),
]

#: Hashing, trees and tokenization are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; what a stage keeps is written in the shared folder
    and read by the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
