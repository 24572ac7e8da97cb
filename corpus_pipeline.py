"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing to target weights, sharding.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame; all but the last return the columns of
docs. run() writes each stage's result to the shared folder and rereads it for the next.

In every stage null ids are ids like others, rows with one id and other texts are told apart by the text, other columns are carried along, an empty table gives an
empty one, and texts of any length are read whole: a long one makes one task longer, it is never cut or skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, langid, mixing, neardup, sharding
from lumenframe.llm.common import dropped, table, written

#: A document stays if its main language makes up this share of it; texts without letters have none. Even mixes of four languages fall short of it.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known main language. Null texts, texts without a letter and mixes whose largest share is under LEAST_SHARE go; repeated rows stay as often as they stand."""
    own = tuple(docs.columns)
    found = langid.identify(docs.select(*(F.col(c).alias(f"d_{c}") for c in own)), langid.fit(docs), "d_doc_id", "d_text", keep=tuple(f"d_{c}" for c in own))
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select(*(F.col(f"d_{c}").alias(c) for c in own))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of least id; of repeated rows one. Texts without a word are a class with equal texts only."""
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. Null texts have no words, so they stay; a proximity match alone is no reason to go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter("n_hit > 0")
    bad = found.select(F.col("id").alias("__id"), "fp").distinct()
    rows = docs.withColumn("__fp", F.xxhash64("text"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["__id"]) & (rows["__fp"] == bad["fp"]), "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice. Texts without words are kept once; of equal rows any may be the one taken."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot, which replace columns of these names."""
    return sharding.sharded(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture), ("shards", shards)]

#: The model of languages and the sampling of near-duplicates have no SQL statement; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            dropped(before)
    return docs
