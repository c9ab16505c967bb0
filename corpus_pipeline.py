"""From raw documents to packed training sequences, one operator a stage.

Each stage takes what its predecessor kept and returns rows with the columns of
``documents``, but for the last one, which returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import bagminhash, mixing, packing, quality, secrets
from eventloom.llm.common import stash, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null texts are judged as empty ones; copies and repeated rows share their fate; an empty table stays empty."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id. Null texts are alone, repeated ids give one row, rows without an id stay if no row with one has their text."""
    return bagminhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets of any layer masked in the text. Null texts stay null; rows are kept as they come."""
    clean = docs.withColumn("text", secrets.redacted(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that meets the target weights of sources, languages and topics. Null sources and languages are values of their own; texts without tokens are not drawn; rows with one id share their draw."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences. A null or empty text is its end mark alone; repeated rows are packed once each; an empty table gives no rows."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [
    ("quality classifier", good_quality),
    ("near-dedup", distinct),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has neither the trained classifier nor the tokenizer; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
