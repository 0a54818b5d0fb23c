"""The corpus pipeline: quality classifier, near-dedup, benchmark decontamination, mixing and sharding.

A stage is a function of (spark, docs, sf_dir). Each one's result is written as Parquet to the
shared folder and read again as the next one's docs. It works on all rows that its predecessor
kept; all but the last return the columns of docs, the last adds the shard.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.llm import byte_cnn, kdtree_shards, mixing, simhash_forest, suffix_decontam
from ledgerweave.llm.common import save, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_cnn.keep_good(spark, docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_forest.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_decontam.decontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kdtree_shards.shard(spark, docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: Learned models, fingerprints and random draws can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
