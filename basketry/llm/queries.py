"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from basketry.llm import divergence, fim, licenses, mixing, packing, pii, quality, secrets, sharding, simhash, substrings, topk, toxicity
from basketry.llm.common import read_table


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.feistel_shards(read_table(spark, sf_dir, "documents"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.trained(docs, read_table(spark, sf_dir, "labels")))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(read_table(spark, sf_dir, "documents"))


def op4_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read_table(spark, sf_dir, "documents"))


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op7_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.pii_scan(docs, pii.trained(docs))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read_table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op11_level_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"))


def op12_displacement_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(read_table(spark, sf_dir, "documents"))


def op13_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digests(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_license_scans, op2_toxicity_crf, op3_secret_scans, op4_bin_slack_packing, op5_feistel_sharding, op6_entropy_mixing,
        op7_pii_semi_markov, op8_exact_topk, op9_simhash_components, op10_weak_quality, op11_level_products, op12_displacement_fim,
        op13_suffix_automata)
}
SQL: dict[str, str] = {
    "op1_license_scans": licenses.oracle_sql(),
    "op5_feistel_sharding": sharding.oracle_sql(),
    "op8_exact_topk": topk.oracle_sql(),
    "op11_level_products": divergence.oracle_sql(),
    "op12_displacement_fim": fim.oracle_sql(),
    "op13_suffix_automata": substrings.oracle_sql(),
}
