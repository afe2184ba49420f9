"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns
documents; the last returns the packed pieces. `run` writes every stage as Parquet to the
session's shared checkpoint folder and reads it again, which cuts lineage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import boosted_trees, fingerprint_index, simhash, vector_packing, weak_rules
from keelson.llm.common import checkpoint_folder, delete


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below 0.7."""
    return boosted_trees.keep_good(docs, boosted_trees.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or whose posterior quality is below one half."""
    return weak_rules.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: at least 0.8 of five-word shingles shared, fingerprints within 11 bits."""
    return simhash.keep_one(docs, shingle=3, segments=6, radius=11, similarity=0.8, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out words of windows seen earlier; texts that lose nothing stay as they are, and n_chars follows the text."""
    found = fingerprint_index.dedup(docs, keep_text=True)
    lost = F.col("n_removed") > 0
    own = {c: F.col(f"`in.{c}`") for c in docs.columns}
    own["text"] = F.when(lost, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(lost, F.char_length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*(x.alias(c) for c, x in own.items()))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens: one row for each piece."""
    return vector_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the expectation-maximisation of the rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; a stage's folder goes once the next one is written."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            delete(spark, f"{at}/{k - 1}")
    return docs
