"""Tables, the shared folder and small helpers for the operators of this subpackage."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Marks the helper columns that an operator adds beside columns of its input.
P = "__lw_"


#: Texts of up to about this many bytes go to a Python worker at once, unless the session says otherwise: batches of so and
#: so many rows have no bound in bytes, and the JVM, the worker and the way between them hold several.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if spark.sparkContext.getConf().get(_BATCH) is None and str(spark.conf.get(_BATCH)).rstrip("b") == str(64 << 20):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerweave-{spark.sparkContext.applicationId}"


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it again: its lineage ends here, and a lost executor loses nothing."""
    bound_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Deletes what save() has written in this application; results that still read it become unusable."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shards beyond this number share partitions, so that a shuffle has no more than so many.
MOST_PARTITIONS = 65_536


def by_shard(df: DataFrame, column: str, shards: int, *order: str) -> DataFrame:
    """Every shard in one partition, and there together, in the given order; up to MOST_PARTITIONS shards each has one of its own."""
    parts = max(1, min(shards, MOST_PARTITIONS))
    own = F.col(column) if parts == shards else F.expr(f"cast(cast(`{column}` as long) * {parts} div {shards} as int)")
    return df.repartitionById(parts, own).sortWithinPartitions(column, *order)


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


def log2_ceil(x: float) -> int:
    return max(0, math.ceil(math.log2(x))) if x > 1 else 0
