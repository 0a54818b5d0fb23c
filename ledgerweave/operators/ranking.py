"""Ranks over a whole table, without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.sources.scratch import new_folder


def global_rank(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """df with each row's number in ascending order, from 1. The rows are sorted by range and written once; what is summed
    in one place is a count for each partition. The order must have no ties, else equal rows' ranks may differ between runs."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, "ranked")
    df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_id", 33))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(before, "_part").withColumn(name, number.cast("long")).drop("_id", "_part", "_before")
