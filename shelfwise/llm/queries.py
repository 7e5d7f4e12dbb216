"""The registered queries of this subpackage and their DuckDB SQL.

Each query applies one operator to its whole table and derives the columns of its contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import bpe, chat, filter_audit, fingerprints, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, secret_scan, structure_repair, toxicity
from shelfwise.llm.common import read
from shelfwise.llm.oracle import ORACLE_SQL  # noqa: F401

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """The place of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k fingerprints of all documents and of their edited texts."""
    return fingerprints.fingerprint_report(read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to the target weights of their sources."""
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return pii.pii_report(read(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that many documents share, dropped from all documents but one."""
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that are alike in their 4-word shingles."""
    return ngram_join.jaccard_components(read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all documents."""
    return quality_rules.quality_report(read(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secret_scan.secret_report(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents, and their decoding."""
    return bpe.token_report(read(spark, sf_dir, "documents"), vocabulary_path())


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and read back; with one that quotes the template (conversation -7)."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    quoting = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_report(turns.unionByName(quoting))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash of conversation and turn, and repaired at the least cost."""
    turns = read(spark, sf_dir, "conversations")
    return structure_repair.repair_report(structure_repair.damage(turns), turns)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order of the filters."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_mixing, op3_pii_surrogates, op4_line_dedup, op5_ngram_join, op6_quality_rules, op7_quality_classifier, op8_secret_scan, op9_bpe, op10_chat, op11_structure_repair, op12_filter_audit, op13_toxicity, pipeline)}
