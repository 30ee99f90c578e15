"""Queries of the training-data operators over the driver's tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import dimension_scan, divergence, kdtree, license_scan, perspectives, piece_codec, simhash, source_mix, substring_dedup, token_shards, toxicity, turn_repair, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_shards.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_shards.read_digests(manifest)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(_table(spark, sf_dir, "documents")))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_kdtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.exact_search(_table(spark, sf_dir, "embeddings"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sizes(_table(spark, sf_dir, "documents"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.search(_table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(_table(spark, sf_dir, "documents"))


def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edits(_table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(_table(spark, sf_dir, "conversations")))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_shards, op2_license_scan, op3_perspectives, op4_toxicity, op5_simhash, op6_kdtree_top_k, op7_source_mix, op8_piece_codec, op9_dimension_scan, op10_substring_dedup, op11_winnowing, op12_turn_repair, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": license_scan.ORACLE_SQL, "op3_perspectives": perspectives.ORACLE_SQL, "op6_kdtree_top_k": kdtree.ORACLE_SQL, "op7_source_mix": source_mix.ORACLE_SQL, "op10_substring_dedup": substring_dedup.ORACLE_SQL, "op12_turn_repair": turn_repair.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
