"""The session pass: one row for each file, with its prompts, models and subagents. Its rules differ from those of the
entries: ids are deduplicated within a file and before usage is asked for, and only recorded cost counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.text import decoded_name, decoded_path, project_name
from ledgerweave.functions.time import minutes_between
from ledgerweave.operators.entries import TOKENS, first_by


def in_year(activity: DataFrame, year: int | None) -> DataFrame:
    rows = activity.where("ts is not null") if year is not None else activity
    if year is not None:
        rows = rows.where(F.col("year") == year if "year" in activity.columns else F.substring("dt", 1, 4).cast("int") == year)
    return rows


def session_messages(activity: DataFrame) -> DataFrame:
    """Assistant rows, one for each id within a file; they may lack usage."""
    return first_by(activity.where(F.col("type") == "assistant"), ["file", "message_id"])


def prompts(activity: DataFrame, keep: int = 5) -> DataFrame:
    """(file, n, text, ts, entrypoint): the first prompts of each file; n counts from 1."""
    human = activity.where((F.col("type") == "user") & ~F.col("is_tool_result") & ~F.col("is_sidechain") & (F.trim("text") != ""))
    return human.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("ord")).cast("long")).where(F.col("n") <= keep).select("file", "n", "text", "ts", "entrypoint")


def model_totals(activity: DataFrame) -> DataFrame:
    used = session_messages(activity).where("has_usage")
    return used.groupBy("file", F.coalesce("model", F.lit("unknown")).alias("model")).agg(*(F.sum(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TOKENS))


def files(activity: DataFrame) -> DataFrame:
    """One row for each file that has tokens, sessions and subagents alike."""
    user = F.col("type") == "user"
    human = user & ~F.col("is_tool_result") & ~F.col("is_sidechain") & (F.trim("text") != "")
    epoch, moment = F.unix_timestamp(F.col("moment").cast("timestamp")), F.struct("moment", "ts")
    timed, back = F.when(F.col("moment").isNotNull(), F.struct(epoch, "ord")), F.when(F.col("moment").isNotNull(), F.struct(-epoch, "ord"))
    activity = activity.where("ts is not null")
    base = activity.groupBy("file").agg(
        F.first("stem").alias("stem"),
        F.first("role").alias("role"),
        F.first("parent_file").alias("parent_file"),
        F.first("project_hash").alias("project_hash"),
        F.max_by("record_session_id", F.when(F.col("record_session_id").isNotNull(), F.col("ord"))).alias("last_id"),
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("ord"))).alias("cwd"),
        F.first("file_ord").alias("file_ord"),
        F.min_by(moment, timed).alias("begin"),
        F.min_by(moment, back).alias("end"),
        F.count_if(human).alias("prompt_count"),
        F.count_if(user & F.col("is_tool_result")).alias("tool_message_count"),
        F.min_by("text", F.when(human, F.col("ord"))).alias("first_prompt"),
    )
    said = session_messages(activity)
    used = F.col("has_usage")
    tokens = said.groupBy("file").agg(*(F.sum(F.when(used, F.coalesce(F.col(t), F.lit(0))).otherwise(0)).alias(t) for t in TOKENS), F.sum(F.coalesce(F.col("cost_units"), F.lit(0))).alias("cost_units"))
    out = base.join(tokens, "file").withColumn("total_tokens", sum((F.col(t) for t in TOKENS[1:]), F.col(TOKENS[0]))).where("total_tokens > 0")
    return out.select(
        "file",
        "role",
        "parent_file",
        F.coalesce("last_id", "stem").alias("session_id"),
        "project_hash",
        F.coalesce("cwd", decoded_path(F.col("project_hash"))).alias("project_path"),
        F.when(F.col("cwd").isNotNull(), project_name(F.col("cwd"))).otherwise(decoded_name(F.col("project_hash"))).alias("project_name"),
        "file_ord",
        F.col("begin.ts").alias("timestamp_start"),
        F.col("end.ts").alias("timestamp_end"),
        minutes_between(F.col("begin.moment"), F.col("end.moment")).alias("duration_minutes"),
        *TOKENS,
        "total_tokens",
        "cost_units",
        "prompt_count",
        "tool_message_count",
        F.trim("first_prompt").alias("first_prompt"),
    )


def sessions(files: DataFrame) -> DataFrame:
    """Top-level sessions of files(); the least `order` comes first: by recorded cost, then in scan order."""
    own = files.where("role = 'session'")
    return own.withColumn("order", F.struct((-F.col("cost_units")).alias("c"), "file_ord"))


def subagents(files: DataFrame) -> DataFrame:
    """Subagents of sessions that count, with the parent's session id; `order` goes by tokens, ties in the parents' order."""
    own = files.where("role = 'subagent'").drop("role")
    parent = sessions(files).select(F.col("file").alias("parent_file"), F.col("session_id").alias("parent_session_id"), F.col("order").alias("parent_order"))
    joined = own.join(parent, "parent_file")
    return joined.withColumn("order", F.struct((-F.col("total_tokens")).alias("t"), "parent_order", "file_ord"))
