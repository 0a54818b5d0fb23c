"""Assistant entries: filters, deduplication, cost and the roll-ups by day, model and project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.models import clean_name, priced_units
from ledgerweave.functions.text import decoded_name, decoded_path, percent, project_name, rounded_ratio

TOKENS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def first_by(df: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key in scan order; rows whose last key is null all stay, spread over the tasks by their order."""
    apart = F.when(F.col(keys[-1]).isNull(), F.col(order))
    numbered = df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, apart).orderBy(order)))
    return numbered.where("_first = 1").drop("_first")


def entries(activity: DataFrame, year: int | None = None) -> DataFrame:
    """Assistant rows with usage, of the given year, one for each message id; with defaults and the cost that counts:
    the recorded one, or else the list price. The filters come before the deduplication, so a row that they drop claims no id."""
    rows = activity.where((F.col("type") == "assistant") & F.col("has_usage") & F.col("ts").isNotNull())
    if year is not None:
        rows = rows.where(F.col("year") == year if "year" in activity.columns else F.substring("dt", 1, 4).cast("int") == year)
    rows = first_by(rows, ["message_id"])
    rows = rows.withColumns({t: F.coalesce(F.col(t), F.lit(0)) for t in TOKENS} | {"session_id": F.coalesce("record_session_id", "stem"), "model": F.coalesce("model", F.lit("unknown")), "cost_units": F.coalesce(F.col("cost_units"), F.lit(0))})
    return rows.withColumn("cost", F.when(F.col("cost_units") > 0, F.col("cost_units")).otherwise(priced_units(F.col("model"))))


def daily_model(entries: DataFrame) -> DataFrame:
    sums = entries.where("dt is not null").groupBy("dt", "model").agg(*(F.sum(t).alias(t) for t in TOKENS), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("messages"))
    # the price stands in for a day's model without any cost as well
    return sums.withColumn("cost", F.when(F.col("cost") > 0, F.col("cost")).otherwise(priced_units(F.col("model"))))


def daily(entries: DataFrame) -> DataFrame:
    """One row for each date: token sums, cost in units, messages, sessions, ratio of cache reads to output."""
    own = entries.where("dt is not null").groupBy("dt").agg(*(F.sum(t).alias(t) for t in TOKENS), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("messages"), F.countDistinct("session_id").alias("sessions"))
    return own.withColumn("cache_output_ratio", rounded_ratio(F.col("cache_read_tokens"), F.col("output_tokens")))


def model_costs(daily_models: DataFrame) -> DataFrame:
    return daily_models.groupBy(clean_name(F.col("model")).alias("model")).agg(F.sum("cost").alias("cost"))


def projects(entries: DataFrame) -> DataFrame:
    """One row for each project hash. Its path is the cwd seen most often (of equally frequent ones the greatest), else
    what the hash stands for; its sessions are those outside subagents, or all if there are none."""
    rows = entries.withColumns({"hash": F.when(F.coalesce(F.col("project_hash"), F.lit("")) == "", "unknown").otherwise(F.col("project_hash")), "epoch": F.unix_timestamp(F.col("moment").cast("timestamp"))})
    has = F.col("epoch").isNotNull()
    # by session first: distinct sessions are then a count of rows, and a hot project is spread over its sessions
    first, last = F.when(has, F.struct("epoch", "ord", "ts")), F.when(has, F.struct((-F.col("epoch")).alias("e"), "ord", "ts"))
    by_session = rows.groupBy("hash", "session_id").agg(
        *(F.sum(t).alias(t) for t in TOKENS),
        F.count(F.lit(1)).alias("messages"),
        F.bool_or("is_subagent").alias("aide"),
        F.bool_and("is_subagent").alias("aide_only"),
        F.min(first).alias("first"),
        # of the rows in the last second the first in scan order
        F.min(last).alias("last"),
    )
    known = F.col("session_id").isNotNull()
    base = by_session.groupBy("hash").agg(
        *(F.sum(t).alias(t) for t in TOKENS),
        F.sum("messages").alias("messages"),
        F.count_if(known & ~F.col("aide_only")).alias("main_sessions"),
        F.count_if(known).alias("all_sessions"),
        F.count_if(known & F.col("aide")).alias("subagent_sessions"),
        F.min("first")["ts"].alias("first_seen"),
        F.min("last")["ts"].alias("last_seen"),
    )
    by_cwd = rows.where("cwd is not null").groupBy("hash", "cwd").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.max_by("cwd", F.struct("n", "cwd")).alias("cwd"))
    out = base.join(by_cwd, "hash", "left")
    path = F.coalesce("cwd", decoded_path(F.col("hash")))
    name = F.when(F.col("cwd").isNotNull(), project_name(F.col("cwd"))).otherwise(decoded_name(F.col("hash")))
    sessions = F.when(F.col("main_sessions") > 0, F.col("main_sessions")).otherwise(F.col("all_sessions"))
    return out.select("hash", path.alias("path"), name.alias("name"), *TOKENS, "messages", sessions.alias("sessions"), "subagent_sessions", "first_seen", "last_seen")


def ranked_projects(projects: DataFrame) -> DataFrame:
    """Named projects only, if there are any, with their rank by output and share of it."""
    named = (F.col("name") != "") & (F.col("name") != "workspace root")
    pool = projects.withColumn("_any", F.bool_or(named).over(Window.partitionBy())).where(named | ~F.col("_any")).drop("_any")
    whole = F.sum("output_tokens").over(Window.partitionBy())
    return pool.withColumns({"rank": F.row_number().over(Window.orderBy(F.desc("output_tokens"), "hash")).cast("long"), "share_pct": percent(F.col("output_tokens"), whole)})


def tool_counts(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("tools").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def hours(entries: DataFrame) -> DataFrame:
    """24 rows: messages in each hour."""
    counts = entries.where("hour is not null").groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
    every = entries.sparkSession.range(24).withColumnRenamed("id", "hour")
    return every.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def usage_total(row: str = "") -> Column:
    return sum((F.col(f"{row}{t}") for t in TOKENS[1:]), F.col(f"{row}{TOKENS[0]}"))
