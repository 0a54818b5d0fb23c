"""Analyses of the roll-ups, each a DataFrame. Windows without partitions run over days, hours and projects only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerweave.functions.models import TIERS, UNIT, input_price, read_price, tier, write_price
from ledgerweave.functions.text import percent, rounded_ratio
from ledgerweave.functions.time import hour_label, short_date, weekday
from ledgerweave.operators.entries import TOKENS

def whole() -> WindowSpec:
    return Window.partitionBy()


def dollars(units: Column) -> Column:
    return units.cast("double") / UNIT


def to_places(x: Column, k: int) -> Column:
    """Rounded to k decimals by scaling, halves away from zero."""
    return F.round(x * 10**k) / 10**k


def median(values: Column) -> Column:
    """The middle value, or the mean of the middle two; 0 of nothing."""
    return F.coalesce(F.percentile(values, 0.5), F.lit(0.0))


def index_percentiles(df: DataFrame, value: str, **p: float) -> DataFrame:
    """One row: for each p element floor(n * p) of the n sorted values, counted from 0; 0 of nothing. The values are whole
    minutes, so that only the counts of distinct ones are brought together."""
    counts = df.groupBy(F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.withColumns({"upto": F.sum("n").over(Window.orderBy("x")), "all": F.sum("n").over(whole())})
    return upto.agg(*(F.coalesce(F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * F.lit(q)), F.col("all") - 1), F.col("x"))), F.lit(0)).alias(name) for name, q in p.items()))


# cost


def cost_summary(daily: DataFrame) -> DataFrame:
    cost = dollars(F.col("cost"))
    out = daily.agg(
        F.count_if(F.col("messages") > 0).alias("active_days"),
        dollars(F.coalesce(F.sum("cost"), F.lit(0))).alias("total_cost"),
        median(F.when(cost > 0.01, cost)).alias("median_daily_cost"),
        F.max_by("dt", F.struct("cost", "dt")).alias("peak_day"),
        dollars(F.max("cost")).alias("peak_cost"),
        *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOKENS),
    )
    return out.withColumn("avg_daily_cost", F.when(F.col("active_days") > 0, F.try_divide(F.col("total_cost"), F.col("active_days"))).otherwise(0.0))


def session_cost_stats(sessions: DataFrame) -> DataFrame:
    """Ties of the longest session go to the last one in cost order."""
    longest = F.struct("duration_minutes", "order")
    return sessions.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("duration_minutes"), F.lit(0)).alias("total_minutes"),
        F.coalesce(F.expr("sum(duration_minutes) div nullif(count(1), 0)"), F.lit(0)).alias("avg_minutes"),
        F.max_by("session_id", longest).alias("longest_session_id"),
        F.max_by("project_name", longest).alias("longest_session_project"),
        F.coalesce(F.max("duration_minutes"), F.lit(0)).alias("longest_minutes"),
    )


# cache


def cache_totals(daily: DataFrame) -> DataFrame:
    t = daily.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS))
    tried = F.col("cache_read_tokens") + F.col("cache_creation_tokens") + F.col("input_tokens")
    hit = F.when(tried > 0, F.try_divide(F.col("cache_read_tokens").cast("double"), tried.cast("double")) * 100).otherwise(0.0)
    return t.withColumns({"hit_rate": hit, "efficiency_ratio": rounded_ratio(F.col("cache_read_tokens"), F.col("output_tokens")), "estimated_breaks": F.round(F.col("cache_creation_tokens") / 300000).cast("long")})


def cache_savings(daily_models: DataFrame) -> DataFrame:
    """Dollars saved by reads from the cache, and spent on writes beyond what reads would have cost."""
    m = F.col("model")
    saved = F.sum(F.col("cache_read_tokens") * (input_price(m) - read_price(m)))
    spent = F.sum(F.col("cache_creation_tokens") * (write_price(m) - read_price(m)))
    return daily_models.agg(F.round(dollars(F.coalesce(saved, F.lit(0)))).cast("long").alias("from_caching"), F.round(dollars(F.coalesce(spent, F.lit(0)))).cast("long").alias("wasted_from_breaks"))


def recent_split(daily: DataFrame) -> DataFrame:
    """Days, with `recent` for the last seven rows."""
    return daily.withColumns({"recent": F.row_number().over(Window.orderBy(F.desc("dt"))) <= 7, "days": F.count(F.lit(1)).over(whole())})


def cache_trend(daily: DataFrame) -> DataFrame:
    r = recent_split(daily)
    own = r.agg(F.coalesce(F.max("days"), F.lit(0)).alias("days"), *(F.coalesce(F.sum(F.when(F.col("recent") == x, F.col(c))), F.lit(0)).alias(f"{name}_{c}") for x, name in ((True, "recent"), (False, "older")) for c in ("cache_read_tokens", "output_tokens")))
    out = own.select("days", *(rounded_ratio(F.col(f"{n}_cache_read_tokens"), F.col(f"{n}_output_tokens")).alias(f"{n}_ratio") for n in ("recent", "older")))
    change = F.try_divide(F.col("recent_ratio").cast("double"), F.col("older_ratio").cast("double"))
    score = F.when((F.col("days") < 7) | (F.col("older_ratio") == 0), 70).when(change <= 0.5, 100).when(change <= 0.8, 85).when(change <= 1.2, 70).when(change <= 2.0, 40).otherwise(10)
    return out.withColumn("trend_score", score.cast("long"))


def _steps(x: Column, steps: list[tuple[float, int]], rest: int, up: bool = True) -> Column:
    out = None
    for at, score in steps:
        cond = x >= at if up else x <= at
        out = F.when(cond, score) if out is None else out.when(cond, score)
    return out.otherwise(rest).cast("long")


def cache_grade(daily: DataFrame) -> DataFrame:
    """One row: totals, signals, composite score and letter."""
    t = cache_totals(daily).crossJoin(cache_trend(daily).select("trend_score"))
    t = t.withColumns(
        {
            "hit_score": _steps(F.col("hit_rate"), [(85, 100), (70, 85), (50, 65), (30, 40)], 15),
            "break_score": (100 - F.least(F.col("estimated_breaks"), F.lit(10)) * 10).cast("long"),
            "ratio_score": _steps(F.col("efficiency_ratio"), [(200, 100), (400, 85), (600, 70), (800, 55), (1000, 40), (1500, 25), (2000, 15)], 5, up=False),
        }
    )
    raw = F.round(F.col("hit_score") * 0.60 + F.col("trend_score") * 0.25 + F.col("break_score") * 0.15).cast("long")
    capped = F.when(F.col("efficiency_ratio") > 2000, F.least(raw, F.lit(49))).when(F.col("efficiency_ratio") > 1500, F.least(raw, F.lit(64))).otherwise(raw)
    t = t.withColumn("score", capped.cast("long"))
    s = F.col("score")
    letter = F.when(s >= 80, "A").when(s >= 65, "B").when(s >= 50, "C").when(s >= 35, "D").otherwise("F")
    return t.withColumns(
        {
            "letter": letter,
            "label": F.when(s >= 80, "Excellent").when(s >= 65, "Good").when(s >= 50, "Fair").when(s >= 35, "Poor").otherwise("Critical"),
            "color": F.when(s >= 80, "#7ec49a").when(s >= 65, "#d4c5b0").when(s >= 50, "#c4a96e").when(s >= 35, "#b08060").otherwise("#a07060"),
            "hit_rate": to_places(F.col("hit_rate"), 1),
        }
    )


def break_reasons(totals: DataFrame) -> DataFrame:
    return totals.where("estimated_breaks > 0").select(F.lit("Unknown / Server-side").alias("reason"), F.col("estimated_breaks").alias("n"), F.lit(100).cast("long").alias("percentage"))


# change points


def inflection_frames(daily: DataFrame) -> DataFrame:
    """Each day with output and four such days before and from it on, the ratios of the (up to) seven before and after,
    and the multiplier between them."""
    every = F.count(F.lit(1)).over(whole())
    active = daily.withColumn("_days", every).where("output_tokens > 0").withColumn("_active", every)
    order = Window.orderBy("dt")
    before, after = order.rowsBetween(-7, -1), order.rowsBetween(0, 6)

    def ratio(w) -> Column:
        return rounded_ratio(F.sum("cache_read_tokens").over(w), F.sum("output_tokens").over(w))

    f = active.withColumns({"before_days": F.count(F.lit(1)).over(before), "after_days": F.count(F.lit(1)).over(after), "before_ratio": ratio(before), "after_ratio": ratio(after)})
    f = f.where("_days >= 5 and _active >= 6 and before_days >= 4 and after_days >= 4 and before_ratio > 0 and after_ratio > 0")
    worse = F.col("after_ratio") > F.col("before_ratio")
    multiplier = F.when(worse, F.col("after_ratio") / F.col("before_ratio")).otherwise(F.col("before_ratio") / F.col("after_ratio"))
    return f.select("dt", "before_days", "after_days", "before_ratio", "after_ratio", F.when(worse, "worsened").otherwise("improved").alias("direction"), multiplier.alias("multiplier"))


def inflections(daily: DataFrame) -> DataFrame:
    """At most a row for each direction, the strongest change of at least 1.5 (of equals the earliest); `is_primary` marks the one to report."""
    best = Window.partitionBy("direction").orderBy(F.desc("multiplier"), "dt")
    top = inflection_frames(daily).where("multiplier >= 1.5").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    first = F.row_number().over(Window.orderBy(F.desc("direction"))) == 1
    out = top.withColumns({"is_primary": first, "multiplier": to_places(F.col("multiplier"), 1)})
    times = F.regexp_replace(F.format_string("%.1f", F.col("multiplier")), r"\.0$", "")
    verb = F.when(F.col("direction") == "worsened", "dropped").otherwise("improved")
    text = F.concat(F.lit("Cache efficiency "), verb, F.lit(" "), times, F.lit("x from "), short_date(F.col("dt")), F.lit(" on: "), F.col("before_ratio"), F.lit(":1 before, "), F.col("after_ratio"), F.lit(":1 after."))
    return out.withColumn("summary", text)


# anomalies


def cost_stats(daily: DataFrame) -> DataFrame:
    """Each day that cost something with the mean and deviation of all such days; nothing if there are fewer than three."""
    days = daily.withColumn("_days", F.count(F.lit(1)).over(whole())).withColumn("usd", dollars(F.col("cost"))).where("usd > 0.01")
    days = days.withColumns({"_n": F.count(F.lit(1)).over(whole()), "mean": F.avg("usd").over(whole()), "std_dev": F.stddev_pop("usd").over(whole())})
    return days.where("_days >= 3 and _n >= 3").withColumn("z", F.when(F.col("std_dev") > 0, F.try_divide(F.col("usd") - F.col("mean"), F.col("std_dev"))).otherwise(0.0))


def anomalies(daily: DataFrame) -> DataFrame:
    out = cost_stats(daily).where("abs(z) > 2")
    return out.select(
        F.col("dt").alias("date"),
        F.col("usd").alias("cost"),
        to_places(F.col("z"), 2).alias("z_score"),
        F.when(F.abs("z") > 3, "critical").otherwise("warning").alias("severity"),
        F.when(F.col("z") > 0, "spike").otherwise("dip").alias("anomaly_type"),
        to_places(F.col("mean"), 2).alias("avg_cost"),
        to_places(F.col("usd") - F.col("mean"), 2).alias("deviation"),
        (F.col("cache_output_ratio") > 2000).alias("cache_ratio_anomaly"),
        "cache_output_ratio",
    )


def cost_trend(daily: DataFrame) -> DataFrame:
    r = recent_split(daily).withColumn("usd", dollars(F.col("cost")))
    worth = F.col("usd") > 0.01
    own = r.agg(F.coalesce(F.max("days"), F.lit(0)).alias("days"), *(F.sum(F.when(worth & (F.col("recent") == x), F.col("cost"))).alias(f"{n}_cost") for x, n in ((True, "recent"), (False, "older"))), *(F.count_if(worth & (F.col("recent") == x)).alias(f"{n}_n") for x, n in ((True, "recent"), (False, "older"))))
    mean = {n: F.try_divide(dollars(F.col(f"{n}_cost")), F.col(f"{n}_n")) for n in ("recent", "older")}
    change = F.try_divide(mean["recent"] - mean["older"], mean["older"]) * 100
    trend = F.when((F.col("days") < 7) | change.isNull(), "stable").when(change > 50, "rising_fast").when(change > 20, "rising").when(change < -50, "dropping_fast").when(change < -20, "dropping").otherwise("stable")
    return own.select("days", trend.alias("trend"), to_places(F.when(F.col("days") >= 7, change), 2).alias("change_pct"))


# sessions and hours


def duration_stats(sessions: DataFrame) -> DataFrame:
    """Ties of the longest session go to the first one in cost order."""
    n = F.count(F.lit(1))
    d = F.col("duration_minutes")
    own = sessions.agg(
        n.alias("total_sessions"),
        F.coalesce(F.sum(d), F.lit(0)).alias("total_minutes"),
        F.coalesce(F.max(d), F.lit(0)).alias("max_duration"),
        F.min_by("project_name", F.struct(-d, F.col("order"))).alias("longest_session_project"),
        F.count_if(d > 60).alias("long_sessions"),
        F.coalesce(F.sum("tool_message_count"), F.lit(0)).alias("_tools"),
    )
    return own.crossJoin(index_percentiles(sessions, "duration_minutes", median_duration=0.5, p90_duration=0.9)).select(
        "total_sessions",
        "total_minutes",
        F.coalesce(F.expr("total_minutes div nullif(total_sessions, 0)"), F.lit(0)).alias("avg_duration"),
        "median_duration",
        "p90_duration",
        "max_duration",
        "longest_session_project",
        "long_sessions",
        percent(F.col("long_sessions"), F.col("total_sessions")).alias("long_session_pct"),
        F.coalesce(F.expr("_tools div nullif(total_sessions, 0)"), F.lit(0)).alias("avg_tool_messages"),
    )


def messages_per_session(sessions: DataFrame, entries: DataFrame) -> DataFrame:
    said = entries.groupBy("session_id").agg(F.count(F.lit(1)).alias("said"))
    joined = sessions.join(said, "session_id", "left")
    return joined.agg(F.coalesce(F.expr("sum(prompt_count + tool_message_count + coalesce(said, 0)) div nullif(count(1), 0)"), F.lit(0)).alias("avg_messages"))


def busiest_hour(hours: DataFrame) -> DataFrame:
    """One row, or none without messages; of equal hours the latest."""
    return hours.agg(F.max_by("hour", F.struct("n", "hour")).alias("hour"), F.max("n").alias("n"), F.sum("n").alias("_all")).where("n > 0").select("hour", hour_label(F.col("hour")).alias("label"), "n", percent(F.col("n"), F.col("_all")).alias("share_pct"))


def peak_hours(hours: DataFrame, keep: int = 3) -> DataFrame:
    """Of equal hours the earliest comes first."""
    shares = hours.withColumns({"share_pct": percent(F.col("n"), F.sum("n").over(whole())), "rank": F.row_number().over(Window.orderBy(F.desc("n"), "hour")).cast("long")})
    return shares.where(F.col("rank") <= keep).select("rank", "hour", hour_label(F.col("hour")).alias("label"), "n", "share_pct")


def peak_overlap(hours: DataFrame) -> DataFrame:
    return hours.agg(percent(F.sum(F.when(F.col("hour").between(12, 18), F.col("n")).otherwise(0)), F.sum("n")).alias("peak_overlap_pct"))


# models


def tier_costs(model_costs: DataFrame) -> DataFrame:
    """Four rows: cost of each tier in units."""
    own = model_costs.groupBy(tier(F.col("model")).alias("tier")).agg(F.sum("cost").alias("cost"))
    every = model_costs.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return every.join(own, "tier", "left").select("tier", F.coalesce("cost", F.lit(0)).alias("cost"))


def model_routing(model_costs: DataFrame, entries: DataFrame) -> DataFrame:
    t = F.col("tier")
    own = model_costs.withColumn("tier", tier(F.col("model"))).agg(
        dollars(F.coalesce(F.sum("cost"), F.lit(0))).alias("total_cost"),
        F.count(F.lit(1)).alias("models"),
        *(dollars(F.coalesce(F.sum(F.when(t == x, F.col("cost"))), F.lit(0))).alias(f"{x}_cost") for x in TIERS),
    )
    said = entries.agg(F.count_if("is_subagent").alias("_sub"), F.count(F.lit(1)).alias("_all"))
    own = own.crossJoin(said).withColumn("available", F.col("total_cost") >= 0.01)
    live = F.col("available")
    own = own.withColumns({f"{x}_pct": F.when(live, percent(F.col(f"{x}_cost"), F.col("total_cost"))).otherwise(0).cast("long") for x in TIERS[:3]})
    opus = F.col("opus_pct")
    diversity = F.when(~live, 0).when((F.col("models") >= 3) & (opus < 80), 90).when((F.col("models") >= 2) & (opus < 90), 60).when(opus > 95, 20).otherwise(40)
    saved = F.col("opus_cost") * 0.4 - F.col("opus_cost") * 0.4 * 0.6
    return own.select(
        "available",
        "opus_pct",
        "sonnet_pct",
        "haiku_pct",
        F.when(live, saved).otherwise(0.0).alias("estimated_savings"),
        F.when(live, percent(F.col("_sub"), F.col("_all"))).otherwise(0).cast("long").alias("subagent_pct"),
        diversity.cast("long").alias("diversity_score"),
        "total_cost",
        *(f"{x}_cost" for x in TIERS),
    )


# days


def streaks(days: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of consecutive dates of each key; dates that can't be read are left out."""
    d = days.select(*keys, F.col("dt").try_cast("date").alias("d")).where("d is not null").distinct()
    order = Window.partitionBy(*keys).orderBy("d")
    islands = d.withColumn("island", F.date_sub("d", F.row_number().over(order)))
    return islands.groupBy(*keys, "island").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("longest_streak"))


def favorite_weekday(daily: DataFrame) -> DataFrame:
    """Of equal weekdays the last in the alphabet."""
    named = daily.where("messages > 0").select(weekday(F.col("dt")).alias("label"), F.greatest("messages", F.lit(1)).alias("n")).where("label is not null")
    sums = named.groupBy("label").agg(F.sum("n").alias("n"))
    return sums.agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n")).where("label is not null")


def message_totals(daily: DataFrame) -> DataFrame:
    out = daily.agg(F.coalesce(F.sum("messages"), F.lit(0)).alias("total_messages"), F.expr("count_if(messages > 0)").alias("active_days"))
    return out.withColumn("avg_messages_per_active_day", rounded_ratio(F.col("total_messages"), F.col("active_days")))


def prompt_ratio(sessions: DataFrame) -> DataFrame:
    out = sessions.agg(F.coalesce(F.sum("prompt_count"), F.lit(0)).alias("human"), F.coalesce(F.sum("tool_message_count"), F.lit(0)).alias("tool"))
    return out.select("human", "tool", (F.col("human") + F.col("tool")).alias("total"), percent(F.col("human"), F.col("human") + F.col("tool")).alias("human_pct"))


def top_tool(tools: DataFrame) -> DataFrame:
    """Of equal tools the greatest name."""
    return tools.agg(F.max_by("name", F.struct("n", "name")).alias("name"), F.max("n").alias("n")).where("name is not null")


def sparkline_buckets(daily: DataFrame, width: int = 12) -> DataFrame:
    """(bucket, mean, level): means of up to `width` runs of days, and their level from 0 to 7 relative to the greatest."""
    n = F.count(F.lit(1)).over(whole())
    rows = daily.withColumns({"_i": F.row_number().over(Window.orderBy("dt")) - 1, "_n": n})
    # bucket b covers the rows floor(b * n / width) .. floor((b + 1) * n / width) - 1
    bucket = F.when(F.col("_n") <= width, F.col("_i")).otherwise(F.floor(((F.col("_i") + 1) * width - 1) / F.col("_n")))
    means = rows.groupBy(bucket.cast("long").alias("bucket")).agg((F.sum("cost") / F.count(F.lit(1)) / UNIT).alias("mean"))
    top = F.max("mean").over(whole())
    return means.withColumn("level", F.when(top > 0, F.round(F.try_divide(F.col("mean"), top) * 7)).otherwise(0).cast("long"))


def shares(df: DataFrame, value: str) -> DataFrame:
    """Each row's share of the total and of the greatest, in per cent."""
    return df.withColumns({"share_of_total": percent(F.col(value), F.sum(value).over(whole())), "share_of_max": F.least(percent(F.col(value), F.max(value).over(whole())), F.lit(100))})
