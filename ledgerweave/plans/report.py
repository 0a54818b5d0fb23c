"""The report: one row that holds every analysis of a year."""

from __future__ import annotations

import datetime
import weakref
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.functions.models import UNIT
from ledgerweave.operators import analytics as an
from ledgerweave.operators import entries as en
from ledgerweave.operators import rules
from ledgerweave.operators import sessions as se
from ledgerweave.operators import story
from ledgerweave.operators.ranking import global_rank

#: Bytes of sessions in a part of the JSON; a single session may be longer.
PART = 8 << 20
TOKEN_NAMES = dict(zip(en.TOKENS, ("inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens")))


class Relations:
    """Everything the report derives from one activity relation, each made when it is asked for. The tables that the rest is made of are
    kept until release(): at any size the log is then read and deduplicated once. The one-row analyses are cheaper to make again than to keep."""

    def __init__(self, activity: DataFrame, year: int | None = None):
        self.activity, self.year, self.kept = activity, year, []

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.cache())
        return df

    def release(self) -> None:
        for df in self.kept:
            df.unpersist()

    def released_with(self, df: DataFrame) -> DataFrame:
        """df; what is kept for it is released when df is no longer used."""
        weakref.finalize(df, self.release).atexit = False
        return df

    rows = cached_property(lambda r: se.in_year(r.activity, r.year))
    entries = cached_property(lambda r: r._keep(en.entries(r.activity, r.year)))
    daily_models = cached_property(lambda r: r._keep(en.daily_model(r.entries)))
    daily = cached_property(lambda r: r._keep(en.daily(r.entries)))
    files = cached_property(lambda r: r._keep(se.files(r.rows)))
    sessions = cached_property(lambda r: se.sessions(r.files))
    subagents = cached_property(lambda r: se.subagents(r.files))
    prompts = cached_property(lambda r: se.prompts(r.rows))
    model_totals = cached_property(lambda r: se.model_totals(r.rows))
    projects = cached_property(lambda r: r._keep(en.projects(r.entries)))
    ranked = cached_property(lambda r: en.ranked_projects(r.projects))
    model_costs = cached_property(lambda r: en.model_costs(r.daily_models))
    hours = cached_property(lambda r: r._keep(en.hours(r.entries)))
    tools = cached_property(lambda r: en.tool_counts(r.entries))
    anomalies = cached_property(lambda r: an.anomalies(r.daily))
    inflections = cached_property(lambda r: an.inflections(r.daily))
    cost = cached_property(lambda r: an.cost_summary(r.daily))
    grade = cached_property(lambda r: an.cache_grade(r.daily))
    savings = cached_property(lambda r: an.cache_savings(r.daily_models))
    durations = cached_property(lambda r: an.duration_stats(r.sessions))
    overlap = cached_property(lambda r: an.peak_overlap(r.hours))
    routing = cached_property(lambda r: an.model_routing(r.model_costs, r.entries))
    facts = cached_property(lambda r: rules.facts(r.cost, r.grade, r.savings, r.anomalies, r.inflections, r.durations, r.overlap, r.routing, r.projects, r.ranked))
    recommendations = cached_property(lambda r: rules.recommendations(r.facts))


def one(df: DataFrame, name: str, *columns) -> DataFrame:
    """The only row of df as a struct; null if there is none."""
    return df.select(F.struct(*columns).alias(name)).agg(F.first(name).alias(name))


def _by_key(a, b):
    return F.when(a["_k"] < b["_k"], -1).when(a["_k"] > b["_k"], 1).otherwise(0)


def many(df: DataFrame, name: str, order: list, *columns) -> DataFrame:
    """The rows of df as an array of structs in the given order."""
    keyed = df.select(F.struct(*order).alias("_k"), F.struct(*columns).alias("_v"))
    return keyed.agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v")), _by_key), lambda x: x["_v"]).alias(name))


def usage(prefix: str = ""):
    return [F.col(f"{prefix}{t}").alias(n) for t, n in TOKEN_NAMES.items()]


def story_facts(r: Relations) -> DataFrame:
    session = ["session_id", "project_name", "timestamp_start", "total_tokens", "cost_units", "duration_minutes", "first_prompt"]
    parts = [
        r.cost.select("total_cost", "peak_day", "peak_cost"),
        an.message_totals(r.daily).select("total_messages", "active_days", F.col("avg_messages_per_active_day").alias("average")),
        r.daily.agg(F.coalesce(F.sum(en.usage_total()), F.lit(0)).alias("total_tokens")),
        r.grade.select("efficiency_ratio", "letter"),
        r.routing.select("available", "opus_pct", "sonnet_pct", "haiku_pct"),
        an.prompt_ratio(r.sessions),
        an.streaks(r.daily.where("messages > 0"), []).agg(F.coalesce(F.max("longest_streak"), F.lit(0)).alias("longest_streak")),
        one(an.busiest_hour(r.hours), "power_hour", "hour", "label", "n", "share_pct"),
        one(an.favorite_weekday(r.daily), "favorite_weekday", "label", "n"),
        one(an.top_tool(r.tools), "top_tool", "name", "n"),
        one(r.ranked.where("rank = 1"), "top_project", "name", "path", "share_pct", "sessions", "output_tokens"),
        r.sessions.agg(F.min_by(F.struct(*session), "order").alias("biggest_session")),
        r.sessions.agg(F.min_by(F.struct(*session), F.struct(-F.col("total_tokens"), "order")).alias("biggest_by_tokens")),
        r.subagents.agg(F.min_by(F.struct("session_id", "project_name", "total_tokens", "first_prompt"), "order").alias("biggest_subagent")),
        one(r.recommendations.where("n = 1"), "next_move", "rule", "severity", "title", "savings", "action"),
    ]
    return reduce(DataFrame.crossJoin, parts)


def wrapped_story(facts: DataFrame) -> DataFrame:
    c = F.col
    light = c("sonnet_pct") + c("haiku_pct")
    kind, mood, hour = story.archetype(c("opus_pct"), light, c("average")), story.cache_mood(c("letter")), F.coalesce(c("power_hour.label"), F.lit("Unknown"))
    summary = F.concat(kind, F.lit(". "), mood, F.lit(". Power hour: "), hour, F.lit("."))
    share = F.when(c("top_project.name").isNotNull(), F.concat(summary, F.lit(" "), c("top_project.name"), F.lit(": "), c("top_project.share_pct"), F.lit("% of output."))).otherwise(summary)

    def bucket(name: str):
        return F.when(c(f"{name}.hour").isNotNull(), F.struct(c(f"{name}.hour").alias("hour"), c(f"{name}.label").alias("label"), c(f"{name}.n").alias("count"), c(f"{name}.share_pct").alias("sharePct")))

    def session(name: str):
        return F.when(c(f"{name}.session_id").isNotNull(), F.struct(c(f"{name}.session_id").alias("sessionId"), c(f"{name}.project_name").alias("projectName"), c(f"{name}.timestamp_start").alias("timestampStart"), c(f"{name}.total_tokens").alias("totalTokens"), (c(f"{name}.cost_units") / UNIT).alias("costUsd"), c(f"{name}.duration_minutes").alias("durationMinutes"), c(f"{name}.first_prompt").alias("firstPrompt")))

    return facts.select(
        F.struct(
            summary.alias("summary"),
            story.hero_stats().alias("hero"),
            story.highlights().alias("highlights"),
            F.struct(kind.alias("title"), story.archetype_note(c("opus_pct"), light, c("average")).alias("note")).alias("archetype"),
            F.struct(mood.alias("title"), story.cache_mood_note(c("letter"), c("efficiency_ratio")).alias("note")).alias("cacheMood"),
            F.struct(story.momentum(c("longest_streak"), c("average")).alias("title"), story.momentum_note(c("longest_streak"), c("average")).alias("note")).alias("momentum"),
            bucket("power_hour").alias("powerHour"),
            F.when(c("favorite_weekday.label").isNotNull(), F.struct(c("favorite_weekday.label").alias("label"), c("favorite_weekday.n").alias("count"))).alias("favoriteWeekday"),
            c("total_messages").alias("totalMessages"),
            c("total_tokens").alias("totalTokens"),
            c("average").alias("averageMessagesPerActiveDay"),
            c("longest_streak").alias("longestStreak"),
            F.when(c("top_tool.name").isNotNull(), F.struct(c("top_tool.name").alias("name"), c("top_tool.n").alias("count"))).alias("topTool"),
            F.when(c("top_project.name").isNotNull(), F.struct(c("top_project.name").alias("name"), c("top_project.path").alias("path"), c("top_project.share_pct").alias("sharePct"), c("top_project.sessions").alias("sessionCount"), c("top_project.output_tokens").alias("outputTokens"))).alias("topProject"),
            session("biggest_session").alias("biggestSession"),
            session("biggest_session").alias("biggestSessionByCost"),
            session("biggest_by_tokens").alias("biggestSessionByTokens"),
            F.when(c("biggest_subagent.session_id").isNotNull(), F.struct(c("biggest_subagent.session_id").alias("sessionId"), c("biggest_subagent.project_name").alias("projectName"), c("biggest_subagent.total_tokens").alias("totalTokens"), c("biggest_subagent.first_prompt").alias("firstPrompt"))).alias("biggestSubagent"),
            F.struct("human", "tool", "total", c("human_pct").alias("humanPct")).alias("promptRatio"),
            F.when(c("next_move.title").isNotNull(), F.struct("next_move.severity", "next_move.title", "next_move.savings", "next_move.action")).alias("nextMove"),
            share.alias("shareText"),
        ).alias("wrappedStory")
    )


def _aide() -> list:
    c = F.col
    return [c("session_id").alias("sessionId"), c("timestamp_start").alias("timestampStart"), c("duration_minutes").alias("durationMinutes"), c("total_tokens").alias("totalTokens"), F.struct(*usage()).alias("usage"), c("first_prompt").alias("firstPrompt"), c("project_path").alias("projectPath"), c("project_name").alias("projectName"), c("parent_session_id").alias("parentSessionId")]


def session_rows(r: Relations) -> tuple[DataFrame, list]:
    """One row for each session, with `order`, and the columns of its entry in the report."""
    c, usd = F.col, an.dollars
    prompts = r.prompts.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text", c("ts").alias("timestamp"), "entrypoint"))), lambda x: F.struct(x["text"].alias("text"), x["timestamp"].alias("timestamp"), x["entrypoint"].alias("entrypoint"))).alias("prompts"))
    totals = r.model_totals.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.struct(*usage()))))).alias("modelTotals"))
    aides = r.subagents.groupBy(c("parent_file").alias("file")).agg(F.transform(F.array_sort(F.collect_list(F.struct(c("file_ord").alias("_o"), F.struct(*_aide()).alias("_v")))), lambda x: x["_v"]).alias("subagents"))
    whole = r.sessions.join(prompts, "file", "left").join(totals, "file", "left").join(aides, "file", "left")
    session = [c("session_id").alias("sessionId"), c("project_hash").alias("projectHash"), c("project_path").alias("projectPath"), c("project_name").alias("projectName"), c("timestamp_start").alias("timestampStart"), c("timestamp_end").alias("timestampEnd"), c("duration_minutes").alias("durationMinutes"), F.struct(*usage()).alias("usage"), c("modelTotals"), c("total_tokens").alias("totalTokens"), usd(c("cost_units")).alias("costUsd"), c("prompt_count").alias("promptCount"), c("tool_message_count").alias("toolMessageCount"), c("first_prompt").alias("firstPrompt"), F.coalesce("prompts", F.array()).alias("prompts"), F.coalesce("subagents", F.array()).alias("subagents")]
    return whole, session


def report(activity: DataFrame, year: int, relations: Relations | None = None, listed: bool = True) -> DataFrame:
    """One row: generatedAt, year and the analyses as nested columns, named as in the JSON report. It grows with the number of
    sessions, unless `listed` is false; the list of sessions is then left to session_rows()."""
    r = relations or Relations(activity, year)
    c, usd = F.col, an.dollars
    models = r.daily_models.groupBy("dt").agg(F.array_sort(F.collect_list(F.struct(c("model"), usd(c("cost")).alias("cost"), F.struct(c("input_tokens").alias("input"), c("output_tokens").alias("output"), c("cache_read_tokens").alias("cacheRead"), c("cache_creation_tokens").alias("cacheWrite")).alias("tokens")))).alias("models"))
    day = [c("dt").alias("date"), usd(c("cost")).alias("cost"), c("output_tokens").alias("outputTokens"), c("cache_read_tokens").alias("cacheReadTokens"), c("cache_output_ratio").alias("cacheOutputRatio"), c("messages").alias("messageCount"), c("sessions").alias("sessionCount"), "models"]
    days = r.daily.join(models, "dt")
    stats = an.session_cost_stats(r.sessions)
    cost = reduce(
        DataFrame.crossJoin,
        [
            r.cost,
            many(days, "_days", ["dt"], *day),
            one(stats, "_sessions", c("total"), c("total_minutes").alias("totalDurationMinutes"), c("avg_minutes").alias("avgDurationMinutes"), c("longest_session_id").alias("longestSessionId"), c("longest_session_project").alias("longestSessionProject"), c("longest_minutes").alias("longestSessionMinutes")),
            r.model_costs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", usd(c("cost")))))).alias("_models")),
        ],
    ).select(
        F.struct(F.lit(year).alias("year"), c("active_days").alias("activeDays"), c("total_cost").alias("totalCost"), c("avg_daily_cost").alias("avgDailyCost"), c("median_daily_cost").alias("medianDailyCost"), F.get(F.filter("_days", lambda d: d["date"] == c("peak_day")), 0).alias("peakDay"), c("_days").alias("dailyCosts"), c("_models").alias("modelCosts"), c("_sessions").alias("sessions"), F.struct(*usage()).alias("totals")).alias("costAnalysis")
    )
    cache = (
        r.grade.crossJoin(r.savings)
        .crossJoin(many(an.break_reasons(r.grade), "_reasons", ["reason"], "reason", c("n").alias("count"), "percentage"))
        .select(
            F.struct(
                c("estimated_breaks").alias("estimatedBreaks"),
                c("_reasons").alias("reasonsRanked"),
                c("hit_rate").alias("cacheHitRate"),
                c("efficiency_ratio").alias("efficiencyRatio"),
                F.struct("letter", "color", "label", "score", F.struct(c("hit_score").alias("hitRate"), c("ratio_score").alias("ratio"), c("trend_score").alias("trend"), c("break_score").alias("breaks")).alias("signals")).alias("grade"),
                F.struct(c("from_caching").alias("fromCaching"), c("wasted_from_breaks").alias("wastedFromBreaks")).alias("savings"),
                F.struct(*usage()).alias("totals"),
            ).alias("cacheHealth")
        )
    )
    odd = [c("date"), c("cost"), c("z_score").alias("zScore"), c("severity"), c("anomaly_type").alias("anomalyType"), c("avg_cost").alias("avgCost"), c("deviation"), c("cache_ratio_anomaly").alias("cacheRatioAnomaly"), c("cache_output_ratio").alias("cacheOutputRatio")]
    basis = an.cost_stats(r.daily).agg(F.coalesce(an.to_places(F.first("mean"), 2), F.lit(0.0)).alias("mean"), F.coalesce(an.to_places(F.first("std_dev"), 2), F.lit(0.0)).alias("stdDev"), F.count(F.lit(1)).alias("_n"))
    anomalies = basis.crossJoin(many(r.anomalies, "_list", [-c("cost"), c("date")], *odd)).crossJoin(an.cost_trend(r.daily).select("trend"))
    anomalies = anomalies.select(F.struct(c("_list").alias("anomalies"), (F.size("_list") > 0).alias("hasAnomalies"), F.struct("mean", "stdDev").alias("stats"), F.when(c("_n") > 0, c("trend")).otherwise("stable").alias("trend")).alias("anomalies"))
    point = [c("dt").alias("date"), c("before_ratio").alias("beforeRatio"), c("after_ratio").alias("afterRatio"), "multiplier", "direction", c("before_days").alias("beforeDays"), c("after_days").alias("afterDays"), "summary"]
    turn = one(r.inflections.where("is_primary"), "_a", *point).crossJoin(one(r.inflections.where("not is_primary"), "_b", *point)).select(F.when(c("_a").isNotNull(), F.struct("_a.*", c("_b").alias("secondary"))).alias("inflection"))
    busiest = one(an.busiest_hour(r.hours), "busiestHour", "hour", "label", c("n").alias("count"), c("share_pct").alias("sharePct"))
    intel = reduce(
        DataFrame.crossJoin,
        [
            r.durations,
            an.messages_per_session(r.sessions, r.entries),
            many(r.tools, "_tools", [-c("n"), c("name")], "name", c("n").alias("count")),
            many(an.peak_hours(r.hours), "_peaks", ["rank"], "hour", "label", c("n").alias("count"), c("share_pct").alias("sharePct")),
            r.overlap,
            r.hours.agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "n"))), lambda x: x["n"]).alias("_hours")),
        ],
    )
    live = c("total_sessions") > 0
    intel = intel.select(
        F.struct(
            live.alias("available"),
            c("total_sessions").alias("totalSessions"),
            c("total_minutes").alias("totalMinutes"),
            c("avg_duration").alias("avgDuration"),
            c("median_duration").alias("medianDuration"),
            c("p90_duration").alias("p90Duration"),
            c("max_duration").alias("maxDuration"),
            c("longest_session_project").alias("longestSessionProject"),
            c("long_sessions").alias("longSessions"),
            c("long_session_pct").alias("longSessionPct"),
            c("avg_tool_messages").alias("avgToolMessagesPerSession"),
            c("avg_messages").alias("avgMessagesPerSession"),
            F.when(live, F.slice("_tools", 1, 8)).otherwise(F.slice("_tools", 1, 0)).alias("topTools"),
            F.when(live, c("_peaks")).otherwise(F.slice("_peaks", 1, 0)).alias("peakHours"),
            F.when(live, c("peak_overlap_pct")).otherwise(0).alias("peakOverlapPct"),
            F.when(live, c("_hours")).otherwise(F.slice("_hours", 1, 0)).alias("hourDistribution"),
        ).alias("sessionIntel")
    )
    breakdown = many(r.subagents.orderBy("order").limit(20), "_top", ["order"], *_aide()).crossJoin(r.subagents.agg(F.count(F.lit(1)).alias("_n"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("_t")))
    around = [c("_top").alias("costlySubagents"), c("_n").alias("totalSubagentSessions"), c("_t").alias("totalSubagentTokens")]
    if listed:
        whole, session = session_rows(r)
        breakdown, around = many(whole, "_s", ["order"], *session).crossJoin(breakdown), [c("_s").alias("sessions"), *around]
    breakdown = breakdown.select(F.struct(*around).alias("sessionBreakdown"))
    tiers = an.tier_costs(r.model_costs).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tier", usd(c("cost")))))).alias("_tiers"))
    routing = r.routing.crossJoin(tiers).crossJoin(busiest).select(F.struct("available", c("opus_pct").alias("opusPct"), c("sonnet_pct").alias("sonnetPct"), c("haiku_pct").alias("haikuPct"), c("estimated_savings").alias("estimatedSavings"), c("subagent_pct").alias("subagentPct"), c("diversity_score").alias("diversityScore"), c("_tiers").alias("tierCosts"), c("total_cost").alias("totalCost"), "busiestHour").alias("modelRouting"))
    projects = many(r.projects, "projectBreakdown", [-c("output_tokens"), c("hash")], "hash", "path", "name", *usage(), c("messages").alias("messageCount"), c("sessions").alias("sessionCount"), c("subagent_sessions").alias("subagentSessionCount"), c("first_seen").alias("firstSeen"), c("last_seen").alias("lastSeen"))
    advice = many(r.recommendations, "recommendations", ["n"], "severity", "title", "savings", "action")
    sections = [cost, cache, anomalies, turn, intel, breakdown, routing, projects, advice, wrapped_story(story_facts(r))]
    now = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z")
    out = reduce(DataFrame.crossJoin, sections).select(F.lit(now).alias("generatedAt"), F.lit(year).alias("year"), "*")
    return out if relations else r.released_with(out)


def report_json(activity: DataFrame, year: int, part: int = PART) -> DataFrame:
    """(json, part): the report as JSON, in parts from 0 that make one text when they are joined in their order. Up to `part` bytes of
    sessions are one row; beyond that the sessions, whose list grows with the log, are spread over as many rows as they need."""
    r, c = Relations(activity, year), F.col

    def text(x):
        return F.to_json(x, {"ignoreNullFields": "false"})

    full = report(activity, year, r, listed=False)
    k = full.columns.index("sessionBreakdown")
    before, after = text(F.struct(*full.columns[:k])), text(F.struct(*full.columns[k + 1 :]))
    frame = full.select(
        F.concat(F.left(before, F.length(before) - 1), F.lit(',"sessionBreakdown":{"sessions":[')).alias("_head"),
        F.concat(F.lit("],"), F.substring(text(c("sessionBreakdown")), 2, 1 << 30), F.lit(","), F.substring(after, 2, 1 << 30)).alias("_tail"),
    )
    whole, session = session_rows(r)
    ranked = global_rank(whole.select("order", text(F.struct(*session)).alias("_text")).withColumn("_size", F.octet_length("_text")), "order")
    n, longest = ranked.agg(F.count(F.lit(1)), F.max("_size")).first()
    each = max(part // (longest + 1), 1) if n else 1
    parts = max(-(-n // each), 1)
    # a partition for each part: by the size of their compressed rows too many parts would come to one task
    lists = ranked.select(F.floor((c("rank") - 1) / each).alias("part"), "rank", "_text").repartition(parts, "part").groupBy("part").agg(F.array_sort(F.collect_list(F.struct("rank", "_text"))).alias("_list"))
    texts = lists.select("part", F.array_join(F.col("_list._text"), ",").alias("_texts"))
    every = activity.sparkSession.range(parts).withColumnRenamed("id", "part").join(texts, "part", "left").crossJoin(F.broadcast(frame))
    json = F.concat(F.when(c("part") == 0, c("_head")).otherwise(","), F.coalesce("_texts", F.lit("")), F.when(c("part") == parts - 1, c("_tail")).otherwise(""))
    return r.released_with(every.select(json.alias("json"), "part"))
