"""The corpus pipeline: documents through quality rules, the quality classifier, near-duplicate
removal, decontamination and piece encoding. Every stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterlake.llm import bayes_svm, jaccard, pieces, rules, winnow
from meterlake.llm.queries import PIECE_MODEL, table
from meterlake.llm.store import kept


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed limits or are outliers of their language and source go."""
    return rules.good_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled rows of the whole
    table: those that the rules keep are nearly all good, and from them alone it would reject none."""
    return bayes_svm.good_documents(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at 0.8, the one with the least id stays."""
    return jaccard.one_of_each_group(docs, 5, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a run of words with the benchmark go."""
    return winnow.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sentence_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return pieces.encode_documents(docs, PIECE_MODEL)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("n-gram jaccard join", near_duplicates),
    ("decontamination", decontamination),
    ("sentence pieces", sentence_pieces),
]

#: Outlier estimates, a fitted model and best paths are not SQL; the tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
