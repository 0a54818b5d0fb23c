"""One query for each operator, applied to its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerweave.llm import byte_cnn, isolation_forest, kdtree_shards, licenses, line_dedup, mixing, simhash_forest, suffix_decontam, url_filter, warc
from ledgerweave.llm.common import P, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the lines that stay."""
    out = line_dedup.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnRenamed(P + "removed", "lines_removed")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, table(spark, sf_dir, "documents"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to damaged WARC files and salvaged from them: all records, and the log of the quarantined gaps."""
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def salvaged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the places in the files, which SQL can't tell."""
    return op3_warc_salvage(spark, sf_dir).select("kind", "page_id", "url", "html")


def op4_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that aren't anomalous."""
    return isolation_forest.kept(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents to be removed, with their longest match to each benchmark item."""
    return suffix_decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_forest.duplicates(spark, table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: all columns of its documents, their shards and their places there."""
    return mixing.shuffled(*mixing.dealt(spark, table(spark, sf_dir, "documents"))).withColumnsRenamed({P + "shard": "shard", P + "place": "place"})


def op8_kdtree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree_shards.shard(spark, table(spark, sf_dir, "documents"))


def op9_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return byte_cnn.keep_good(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "__lw_probability").withColumnRenamed("__lw_probability", "probability")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL in words, its log odds, and whether it stays."""
    out = url_filter.score(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), table(spark, sf_dir, "documents"), quality=table(spark, sf_dir, "labels"))
    return out.select("page_id", "url", F.array_join(P + "tokens", " ").alias("words"), F.round(P + "log_odds", 6).alias("log_odds"), F.col(P + "keep").alias("keep"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_license_scan, op3_warc_salvage, op4_isolation_forest, op5_suffix_decontam, op6_simhash_forest, op7_mixing, op8_kdtree_shards, op9_byte_cnn, op10_url_filter, salvaged_pages)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op2_license_scan": licenses.sql(), "salvaged_pages": warc.SQL, "op5_suffix_decontam": suffix_decontam.SQL}
