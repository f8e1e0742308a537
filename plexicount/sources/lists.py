"""Side files: whitelists with corrections, blacklists, lists of UMIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read


def _columns(spark: SparkSession, path: str) -> DataFrame:
    lines = read(spark, "numbered_lines", path).select("ordinal", F.trim(F.regexp_replace("value", r"^[\s]+|[\s]+$", "")).alias("value"))
    return lines.where("value <> ''").select("ordinal", F.split("value", "\t").alias("c"))


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """barcode."""
    return _columns(spark, path).select(F.col("c")[0].alias("barcode")).distinct()


def whitelist_corrections(spark: SparkSession, path: str) -> DataFrame:
    """variant, barcode; of a variant that stands in several lines the last holds."""
    rows = _columns(spark, path).where(F.size("c") > 1).select("ordinal", F.col("c")[0].alias("barcode"), F.explode(F.split(F.col("c")[1], ",")).alias("variant"))
    return rows.where("variant <> ''").groupBy("variant").agg(F.max_by("barcode", "ordinal").alias("barcode"))


def blacklist(spark: SparkSession, path: str) -> DataFrame:
    return whitelist(spark, path)


def umi_list(spark: SparkSession, path: str) -> DataFrame:
    """umi; lines that begin with # are comments."""
    return _columns(spark, path).select(F.col("c")[0].alias("umi")).where(~F.startswith("umi", F.lit("#"))).distinct()
