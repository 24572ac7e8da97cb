"""The registered queries of the corpus operators, with DuckDB SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html, langid, licenses, lm, mixing, mtree, neardup, quality, sharding
from .common import table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op1(table(spark, sf_dir, "documents"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op3(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op4(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.op6(table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op10(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language": op1_language,
    "op2_shards": op2_shards,
    "op3_mix": op3_mix,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_language_model": op7_language_model,
    "op8_decontaminate": op8_decontaminate,
    "op9_main_text": op9_main_text,
    "op10_license_scan": op10_license_scan,
}
ORACLE_SQL = {"op5_top_k": mtree.ORACLE_SQL, "op8_decontaminate": decontaminate.ORACLE_SQL}
