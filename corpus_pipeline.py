"""Training-data pipeline: stages over the table of documents, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a frame with the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pitpanel.llm.bin_packing import packed
from pitpanel.llm.decontaminate import clean_rows
from pitpanel.llm.language_id import in_known_language, learn
from pitpanel.llm.near_dedup import near_duplicates
from pitpanel.llm.queries import held_out, table
from pitpanel.llm.secret_tags import redact
from pitpanel.session import scratch_path

#: A document whose language has less probability than this is not in a language that the corpus labels.
LEAST_LANGUAGE = 0.4


def same_columns(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[f"`{c}`" for c in docs.columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned; those without letters and doubtful ones go."""
    net = learn(docs.filter(~held_out(F.col("doc_id"), 5)))
    return in_known_language(docs, net, LEAST_LANGUAGE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more); those without an id stay."""
    gone = near_duplicates(docs, width=5, percent=80).filter(~F.col("kept")).select("doc_id").distinct()
    return same_columns(docs.join(gone, "doc_id", "left_anti"), docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ten benchmark words."""
    return clean_rows(docs, table(spark, sf_dir, "benchmark"), width=10)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark and n_chars counted anew."""
    return same_columns(redact(docs).withColumn("n_chars", F.length("text").cast("long")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in sequences of at most 1024."""
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the network, the random field and the tokenizer have none. tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
