"""One query per operator of this subpackage: (spark, sf_dir) -> DataFrame.

The vocabulary files' folder is a parameter: ``$PUBLIC_TOKENIZERS`` or, where
that is unset, the installed package's.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import bpe_round_trip
from .context_tree import context_tree_scores
from .fingerprint import edited_likeness
from .hard_negatives import HARD_NEGATIVES_SQL, hard_negatives, shifted, usable_vectors
from .license_scan import license_scan
from .mixing import mix
from .quality_rules import QUALITY_SQL, quality_metrics
from .simhash import near_duplicates
from .token_count import token_counts
from .toxicity import toxicity_scores
from .turn_repair import conversation_repair
from .url_filter import url_filter
from .warc import WARC_SQL, archive_round_trip


def vocabulary(name: str) -> str:
    folder = os.environ.get("PUBLIC_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree_scores(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_metrics(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=2)


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(table(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted(F.col("label"), F.col("vec_id")))
    return hard_negatives(usable_vectors(rows))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_context_tree": op1_context_tree,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_bpe_codec": op7_bpe_codec,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
    "op11_turn_repair": op11_turn_repair,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_url_filter": op13_url_filter,
}

ORACLES: dict[str, str] = {"op5_quality_rules": QUALITY_SQL, "op9_warc": WARC_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
