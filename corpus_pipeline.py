"""The corpus pipeline: quality rules, line deduplication, near duplicates, mixing and tokens, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every stage's rows
as Parquet to the shared folder and reads them back for the next one, so a lost executor never repeats earlier stages.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from shelfwise.llm.common import Scratch, read, ship
from shelfwise.llm.queries import vocabulary_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five or more documents stay in the one with the largest doc_id; texts and n_chars change."""
    ship(spark)
    return line_dedup.drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingles 0.8 alike or more, the least doc_id stays."""
    ship(spark)
    return ngram_join.keep_one(docs, width=5, num=80, den=100)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until sources have their target weights."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's tokens, and digest of the decoded text."""
    ship(spark)
    return bpe.token_report(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixture),
    ("BPE", tokens),
]

#: Tokens are not expressible in SQL; the test compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return scratch.store(STAGES[-1][1](spark, docs, sf_dir))
