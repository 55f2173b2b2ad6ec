"""The corpus pipeline: documents in, token ids out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns
a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, near_dedup, quality_classifier, sentencepiece_scan, substring_dedup
from tidemark.llm.queries import vocabulary
from tidemark.llm.shared import cut, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels that are not held out, predicts to be good."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id."""
    return near_dedup.one_of_each(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of 20-word passages that start earlier."""
    return _counted(substring_dedup.without_repeats(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark passages; the passages of the others are cut out of their text."""
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), "both"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its number of tokens, their crc32, its chunks, and whether they decode to its text."""
    return sentencepiece_scan.encode(docs, vocabulary("piece_bpe_32k.model")).drop("ids")


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Neither the classifier nor the pieces can be written in SQL.
ORACLE_SQL = None
