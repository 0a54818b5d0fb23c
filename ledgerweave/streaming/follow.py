"""An extension: follow a growing tree of logs as a stream of its new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerweave.operators import entries as en
from ledgerweave.plans.catalogue import usd
from ledgerweave.sources import logs


def follow(spark: SparkSession, root: str, out: str, checkpoint: str, year: int | None = None) -> StreamingQuery:
    """Whenever files arrive below root, computes the days' costs anew from all of them and writes them to `out`. Recomputing
    keeps the deduplication exact, which goes by the scan order of all files."""

    def refresh(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            days = en.daily(en.entries(logs.read(batch.sparkSession, root), year))
            days.withColumn("cost", usd(days["cost"])).write.mode("overwrite").parquet(out)

    files = spark.readStream.format("text").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    return files.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
