"""From raw documents to packed training sequences, stage by stage; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symptomlake.llm import decontam, minhash, packing, pii, quality
from symptomlake.llm.order import stored
from symptomlake.llm.queries import table

#: Documents with a quality score below this go. Lower than where a document counts as good, to spare doubtful ones.
LEAST_QUALITY = 0.5


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labels of documents still there."""
    return quality.keep(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs, minhash.Links(words=5, over=80))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that disclose it, masked."""
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [("quality classifier", good), ("near-duplicates", different), ("benchmark decontamination", unseen),
          ("personal data", private), ("packing", packed)]

#: Trained weights and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
