"""The activity relation from a table of events.

Columns of the relation, whatever the source: file (unit of the session pass), file_ord (its order), ord (scan order of records), role (session,
subagent or other), parent_file, type, has_usage, message_id, is_tool_result, is_sidechain, ts (text), moment, dt (date as text), hour, record_session_id, stem, project_hash, is_subagent, cwd, entrypoint, model,
input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, cost_units (recorded cost in 1e-8 dollars),
tools, text (of a user record).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions over events that Spark SQL and DuckDB read alike; k and v are made first.
FIRST = {
    "k": "CAST(regexp_extract(props, '(-?[0-9]+)', 1) AS BIGINT)",
    "v": "CAST(round(value * 100) AS BIGINT)",
    "dt": "substr(CAST(ts AS STRING), 1, 10)",
}
COLUMNS = {
    "ord": "event_id",
    "message_id": "CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 10 = 9 THEN 'm' || CAST(event_id - 1 AS STRING) ELSE 'm' || CAST(event_id AS STRING) END",
    "type": "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'assistant' ELSE 'user' END",
    "is_tool_result": "event_type = 'error'",
    "is_sidechain": "event_id % 11 = 0",
    "moment": "ts",
    "dt": "dt",
    "hour": "CAST(hour(ts) AS BIGINT)",
    "file": "'s' || CAST(user_id AS STRING) || '-' || dt",
    "parent_file": "'s' || CAST(user_id - 1 AS STRING) || '-' || dt",
    "is_subagent": "user_id % 5 = 4",
    "role": "CASE WHEN user_id % 5 = 4 THEN 'subagent' ELSE 'session' END",
    "project_hash": "'-work-proj--' || CAST(user_id % 7 AS STRING)",
    "cwd": "CASE WHEN event_id % 3 = 0 THEN '/work/proj-' || CAST(user_id % 7 AS STRING) WHEN event_id % 3 = 1 THEN '/work/proj-' || CAST(user_id % 7 AS STRING) || '/sub' END",
    "model": "CASE WHEN event_type = 'purchase' AND user_id % 25 = 0 THEN 'mystery-model' WHEN event_type = 'purchase' THEN 'claude-opus-4-6' WHEN event_type = 'view' THEN 'anthropic/claude-sonnet-4-6' WHEN event_type = 'click' THEN 'claude-haiku-4-5-20251001' END",
    "input_tokens": "k",
    "output_tokens": "k * 7",
    "cache_creation_tokens": "k * 3",
    "cache_read_tokens": "v * 10",
    "cost_units": "CASE WHEN event_id % 4 = 0 THEN v * 10000 ELSE 0 END",
    "tool": "event_type",
}
#: The events are nearly uniform; this gives change points and outliers something to find.
STEP = {
    "cache_read_tokens": "CASE WHEN dt >= '2024-01-16' THEN v * 30 ELSE v * 10 END",
    "cost_units": "CASE WHEN event_id % 4 <> 0 THEN 0 WHEN dt = '2024-01-20' THEN v * 100000 ELSE v * 10000 END",
}


def activity(spark: SparkSession, sf_dir: str, step: bool = False) -> DataFrame:
    """events.parquet as activity; with step, cache reads triple on 2024-01-16 and recorded costs are tenfold on 2024-01-20."""
    return of_events(spark.read.parquet(f"{sf_dir}/events.parquet"), step)


def of_events(events: DataFrame, step: bool = False) -> DataFrame:
    """The relation from events, row by row, so that their order stays."""
    events = events.select("*", *(F.expr(e).alias(c) for c, e in FIRST.items()))
    own = COLUMNS | (STEP if step else {})
    out = events.select(*(F.expr(e).alias(c) for c, e in own.items()))
    return out.select(
        "*",
        (F.col("type") == "assistant").alias("has_usage"),
        F.col("moment").cast("string").alias("ts"),
        F.col("file").alias("record_session_id"),
        F.col("file").alias("stem"),
        F.array("file").alias("file_ord"),
        F.lit(None).cast("string").alias("entrypoint"),
        F.when(F.col("type") == "assistant", F.array("tool")).otherwise(F.array().cast("array<string>")).alias("tools"),
        F.when(F.col("type") == "user", F.concat(F.lit("do "), F.col("ord"))).alias("text"),
    ).drop("tool")


def sql(step: bool = False) -> str:
    """The same relation as a DuckDB common table expression named act."""
    own = COLUMNS | (STEP if step else {})
    first = ", ".join(f"{e} AS {c}" for c, e in FIRST.items())
    return f"act AS (SELECT {', '.join(f'{e} AS {c}' for c, e in own.items())} FROM (SELECT *, {first} FROM events))"
