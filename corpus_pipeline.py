"""From documents to a training corpus: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import exact_dedup, jaccard_join, line_crf, mixing, piece_codec
from loomline.llm.common import stored, table
from loomline.llm.queries import piece_model


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = line_crf.scored(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter(scored["__score"] >= line_crf.THRESHOLD).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the largest id stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document."""
    return mixing.mixture(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and ids, the SentencePiece ids of the text."""
    return piece_codec.encoded(docs, piece_model()).withColumnRenamed("__ids", "ids")


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_copies), ("near duplicates", drop_near_copies), ("mixing", mix_sources), ("sentencepiece", encode)]

#: The classifier, near duplicates and token ids are beyond SQL; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
