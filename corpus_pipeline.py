"""From raw documents to token ids: five stages, each a table written as Parquet and read again by the next.

Every stage defines awkward rows as its operator does (see their docstrings). Null texts fail the quality rules, so that later stages don't meet any; null
doc_ids are kept and come before all others where order counts; repeated rows are copies, of which the near-duplicate stage keeps one; ties in doc_id go
by the place stored; an empty table gives an empty result. All stages but the last return the columns that they were given, others than those of documents too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from broadsheet.llm import bpe, contamination, line_dedup, near_duplicates, quality, queries
from broadsheet.storage import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rejected documents go."""
    return quality.keep_good(docs)


def line_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines like an earlier one go."""
    return line_dedup.dedup_lines(docs, least=1)


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one document of each group of near duplicates stays."""
    return near_duplicates.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: contaminated documents go, shorter matches are cut out."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every kept text as ids, and the digest of what they decode to. The last stage: one row per document."""
    return bpe.encode_documents(docs, queries.TOKENIZER, decoded=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_similarity), ("near_duplicates", near_duplicate_join), ("decontamination", decontamination), ("bpe_encoding", encode)]

#: The quality rules' estimates and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
