"""Queries of the training-data operators over the whole tables, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, fertility, fingerprints, licenses, mixing, negatives, ngram_trie, packing, quality, secrets, sharding, toxicity, whitening
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_documents(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(table(spark, sf_dir, "documents")))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents"), targets=mixing.TARGETS))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(fingerprints.fingerprint(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.digest(fertility.judge(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.score_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_sharding": op3_sharding,
        "op4_toxicity": op4_toxicity,
        "op5_packing": op5_packing,
        "op6_near_dedup": op6_near_dedup,
        "op7_mixing": op7_mixing,
        "op8_secret_scans": op8_secret_scans,
        "op9_fingerprints": op9_fingerprints,
        "op10_quality_rules": op10_quality_rules,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_lm_scoring": op12_lm_scoring,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scans": licenses.ORACLE_SQL,
        "op3_sharding": sharding.ORACLE_SQL,
        "op7_mixing": mixing.ORACLE_SQL,
        "op13_hard_negatives": negatives.ORACLE_SQL,
    }
