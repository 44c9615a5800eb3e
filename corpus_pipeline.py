"""From raw documents to token files: each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftlake.llm import decontamination, mixing, near_dup, quality_rules, token_files
from siftlake.llm.common import read, shared_path

TOKENIZER = "word_bpe_49k.json"


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, null and empty texts among them."""
    return quality_rules.accepted_documents(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)
    stays, and every row without words or without doc_id."""
    return near_dup.distinct_documents(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontamination.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice. A null
    source is a source; repeated rows are taken together."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document; a null or empty text is its end id alone."""
    return token_files.token_output(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality_rules", rules_stage), ("near_duplicates", near_dup_stage),
          ("decontamination", decontamination_stage), ("mix_sources", mix_stage), ("token_files", token_stage)]

#: SQL has no tokenizer; tests hold the pipeline against a plain version on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on all rows that the one before has written. An empty
    table passes through and gives no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
