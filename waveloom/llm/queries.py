"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, langid, licenses, lm_scoring, mixing, near_dup, packing, quality_rules, secrets, token_store
from .common import documents, scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-store")
    token_store.write(documents(spark, sf_dir), path)
    return token_store.read(spark, path)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(documents(spark, sf_dir), keep="max")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir), _labels(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses in bits to 6 places."""
    out = lm_scoring.score(documents(spark, sf_dir), _labels(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("target_loss", "background_loss", "score")})


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_store, op2_jaccard_join, op3_exact_dedup, op4_secret_scan, op5_quality_rules, op6_license_scan, op7_lm_scoring, op8_source_mixing, op9_language_id, op10_packing)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": near_dup.SQL, "op3_exact_dedup": exact_dedup.SQL, "op4_secret_scan": secrets.SQL, "op6_license_scan": licenses.SQL, "op7_lm_scoring": lm_scoring.SQL}
