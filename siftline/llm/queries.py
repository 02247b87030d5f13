"""The opN_ queries: thin calls of the operators with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op2_toxicity_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op4_soft_membership_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op6_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edit_digest

    return edit_digest(table(spark, sf_dir, "documents"))


def op7_simple8b_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_digest

    return token_digest(table(spark, sf_dir, "documents"))


def op8_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_pii_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op10_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
