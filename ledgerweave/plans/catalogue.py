"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerweave.functions import models as fm
from ledgerweave.functions import text as ft
from ledgerweave.functions import time as fti
from ledgerweave.operators import analytics as an
from ledgerweave.operators import entries as en
from ledgerweave.operators import rules, story
from ledgerweave.operators import sessions as se
from ledgerweave.operators.ranking import global_rank
from ledgerweave.plans import report
from ledgerweave.sources import logs, tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOKENS = ", ".join(en.TOKENS)
SUMS = ", ".join(f"CAST(sum({t}) AS BIGINT) AS {t}" for t in en.TOKENS)


def _price(k: int) -> str:
    p = fm.PRICES
    return f"(CASE WHEN lower(model) LIKE '%haiku%' THEN {p['haiku'][k]} WHEN lower(model) LIKE '%sonnet%' THEN {p['sonnet'][k]} ELSE {p['opus'][k]} END)"


PRICED = " + ".join(f"{t} * {_price(i)}" for i, t in enumerate(en.TOKENS))
RATIO = "CAST(CASE WHEN {b} = 0 THEN 0 ELSE round(CAST({a} AS DOUBLE) / {b}) END AS BIGINT)"


def ratio_sql(a: str, b: str) -> str:
    return RATIO.format(a=a, b=b)


def percent_sql(a: str, b: str) -> str:
    return f"CAST(CASE WHEN {b} > 0 THEN round(CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) * 100) ELSE 0 END AS BIGINT)"


NAME = """CASE WHEN {p} = '' THEN 'Unknown'
 WHEN (rtrim({p}, '/') LIKE '/home/%' OR rtrim({p}, '/') LIKE '/Users/%') AND len([x FOR x IN string_split(rtrim({p}, '/'), '/') IF x <> '']) = 2 THEN 'workspace root'
 ELSE coalesce([x FOR x IN string_split(rtrim({p}, '/'), '/') IF x <> ''][-1], {p}) END"""
PATH = """CASE WHEN {h} IS NULL OR {h} IN ('', 'unknown') THEN NULL
 WHEN {h} LIKE '-%' THEN '/' || replace(replace(replace(substr({h}, 2), '--', chr(1)), '-', '/'), chr(1), '-')
 WHEN regexp_matches({h}, '^[A-Za-z]--') THEN left({h}, 1) || ':/' || replace(replace(replace(substr({h}, 4), '--', chr(1)), '-', '/'), chr(1), '-')
 ELSE replace(replace(replace({h}, '--', chr(1)), '-', '/'), chr(1), '-') END"""
CLEAN = """(SELECT CASE WHEN s = '' THEN 'Unknown' WHEN s LIKE 'opus-%' THEN 'Opus ' || replace(substr(s, 6), '-', '.') WHEN s LIKE 'sonnet-%' THEN 'Sonnet ' || replace(substr(s, 8), '-', '.') WHEN s LIKE 'haiku-%' THEN 'Haiku ' || replace(substr(s, 7), '-', '.') ELSE upper(left(s, 1)) || substr(s, 2) END
 FROM (SELECT CASE WHEN len(p) >= 3 AND regexp_full_match(p[-1], '[0-9]{{8}}') THEN array_to_string(p[:-2], '-') ELSE array_to_string(p, '-') END AS s
 FROM (SELECT [x FOR x IN string_split(regexp_replace(regexp_replace(regexp_replace(trim({m}), '^anthropic/', ''), '^claude/', ''), '^claude-', ''), '-') IF x <> ''] AS p)))"""
HOUR = "CASE WHEN {h} = 0 THEN '12am' WHEN {h} < 12 THEN {h} || 'am' WHEN {h} = 12 THEN '12pm' ELSE ({h} - 12) || 'pm' END"


def ctes(step: bool = False, *more: str) -> str:
    parts = [
        tables.sql(step),
        f"ent AS (SELECT *, file AS session_id, CASE WHEN cost_units > 0 THEN cost_units ELSE {PRICED} END AS cost FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ord) AS rn FROM act WHERE type = 'assistant') WHERE rn = 1 OR message_id IS NULL)",
        f"dm AS (SELECT dt, model, {SUMS}, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS messages FROM ent GROUP BY dt, model)",
        f"dy AS (SELECT *, {ratio_sql('cache_read_tokens', 'output_tokens')} AS cache_output_ratio FROM (SELECT dt, {SUMS}, CAST(sum(cost) AS BIGINT) AS cost, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM ent GROUP BY dt))",
        f"mc AS (SELECT {CLEAN.format(m='model')} AS model, CAST(sum(cost) AS BIGINT) AS cost FROM dm GROUP BY 1)",
        "said AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, message_id ORDER BY ord) AS rn FROM act WHERE type = 'assistant') WHERE rn = 1 OR message_id IS NULL)",
        f"tok AS (SELECT file, {SUMS}, CAST(sum(cost_units) AS BIGINT) AS cost_units FROM said GROUP BY file)",
        """fl AS (SELECT a.*, t.* EXCLUDE (file), t.input_tokens + t.output_tokens + t.cache_creation_tokens + t.cache_read_tokens AS total_tokens FROM (
            SELECT file, min(role) AS role, min(parent_file) AS parent_file, min(project_hash) AS project_hash, arg_min(cwd, ord) FILTER (WHERE cwd IS NOT NULL) AS cwd, min(moment) AS start_at, max(moment) AS end_at,
            count(*) FILTER (WHERE type = 'user' AND NOT is_tool_result AND NOT is_sidechain) AS prompt_count, count(*) FILTER (WHERE type = 'user' AND is_tool_result) AS tool_message_count,
            min(ord) FILTER (WHERE type = 'user' AND NOT is_tool_result AND NOT is_sidechain) AS first_ord
            FROM act GROUP BY file) a JOIN tok t USING (file))""",
        f"""ses AS (SELECT *, row_number() OVER (ORDER BY cost_units DESC, file) AS rank FROM (
            SELECT file AS session_id, file, project_hash, coalesce(cwd, {PATH.format(h='project_hash')}) AS project_path, {NAME.format(p=f"coalesce(cwd, {PATH.format(h='project_hash')}, '')")} AS project_name,
            greatest((epoch_us(end_at) - epoch_us(start_at)) // 60000000, 0) AS duration_minutes, {TOKENS}, total_tokens, cost_units, prompt_count, tool_message_count, CASE WHEN first_ord IS NOT NULL THEN 'do ' || first_ord END AS first_prompt, role, parent_file
            FROM fl WHERE total_tokens > 0) WHERE role = 'session')""",
        f"""sub AS (SELECT *, row_number() OVER (ORDER BY total_tokens DESC, parent_rank, session_id) AS rank FROM (
            SELECT f.file AS session_id, s.session_id AS parent_session_id, s.rank AS parent_rank, f.total_tokens, {NAME.format(p=f"coalesce(f.cwd, {PATH.format(h='f.project_hash')}, '')")} AS project_name
            FROM fl f JOIN ses s ON f.parent_file = s.file WHERE f.role = 'subagent' AND f.total_tokens > 0))""",
        "hr AS (SELECT h.hour, coalesce(n, 0) AS n FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN (SELECT hour, count(*) AS n FROM ent GROUP BY hour) e ON h.hour = e.hour)",
        "cwds AS (SELECT project_hash, arg_max(cwd, (n, cwd)) AS cwd FROM (SELECT project_hash, cwd, count(*) AS n FROM ent WHERE cwd IS NOT NULL GROUP BY ALL) GROUP BY project_hash)",
        f"""pr AS (SELECT e.project_hash AS hash, coalesce(any_value(c.cwd), {PATH.format(h='e.project_hash')}) AS path, {NAME.format(p=f"coalesce(any_value(c.cwd), {PATH.format(h='e.project_hash')})")} AS name, {SUMS}, count(*) AS messages,
            CASE WHEN count(DISTINCT session_id) FILTER (WHERE NOT is_subagent) > 0 THEN count(DISTINCT session_id) FILTER (WHERE NOT is_subagent) ELSE count(DISTINCT session_id) END AS sessions, count(DISTINCT session_id) FILTER (WHERE is_subagent) AS subagent_sessions
            FROM ent e LEFT JOIN cwds c ON e.project_hash = c.project_hash GROUP BY e.project_hash)""",
        f"rk AS (SELECT *, row_number() OVER (ORDER BY output_tokens DESC, hash) AS rank, {percent_sql('output_tokens', 'sum(output_tokens) OVER ()')} AS share_pct FROM pr WHERE name NOT IN ('', 'workspace root') OR NOT (SELECT bool_or(name NOT IN ('', 'workspace root')) FROM pr))",
        f"""rt AS (SELECT total_cost >= 0.01 AS available, {', '.join(f"CASE WHEN total_cost >= 0.01 THEN {percent_sql(f'{t}_cost', 'total_cost')} ELSE 0 END AS {t}_pct" for t in ('opus', 'sonnet', 'haiku'))}, * FROM (
            SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) / 1e8 AS total_cost, count(*) AS models, {', '.join(f"CAST(coalesce(sum(cost) FILTER (WHERE tier = '{t}'), 0) AS DOUBLE) / 1e8 AS {t}_cost" for t in fm.TIERS)}
            FROM (SELECT *, CASE WHEN lower(model) LIKE '%opus%' THEN 'opus' WHEN lower(model) LIKE '%sonnet%' THEN 'sonnet' WHEN lower(model) LIKE '%haiku%' THEN 'haiku' ELSE 'other' END AS tier FROM mc)))""",
        f"ct AS (SELECT {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in en.TOKENS)} FROM dy)",
        f"""tr AS (SELECT days, {ratio_sql('rr', 'ro')} AS recent_ratio, {ratio_sql('orr', 'oo')} AS older_ratio FROM (SELECT max(days) AS days, sum(cache_read_tokens) FILTER (WHERE r <= 7) AS rr, sum(output_tokens) FILTER (WHERE r <= 7) AS ro,
            coalesce(sum(cache_read_tokens) FILTER (WHERE r > 7), 0) AS orr, coalesce(sum(output_tokens) FILTER (WHERE r > 7), 0) AS oo FROM (SELECT *, row_number() OVER (ORDER BY dt DESC) AS r, count(*) OVER () AS days FROM dy)))""",
        """ts AS (SELECT *, CASE WHEN days < 7 OR older_ratio = 0 THEN 70 WHEN recent_ratio / older_ratio <= 0.5 THEN 100 WHEN recent_ratio / older_ratio <= 0.8 THEN 85 WHEN recent_ratio / older_ratio <= 1.2 THEN 70 WHEN recent_ratio / older_ratio <= 2.0 THEN 40 ELSE 10 END AS trend_score FROM tr)""",
        f"""g0 AS (SELECT ct.*, ts.trend_score, CAST(cache_read_tokens AS DOUBLE) / (cache_read_tokens + cache_creation_tokens + input_tokens) * 100 AS hr, {ratio_sql('cache_read_tokens', 'output_tokens')} AS efficiency_ratio, CAST(round(cache_creation_tokens / 300000) AS BIGINT) AS estimated_breaks FROM ct, ts)""",
        """g1 AS (SELECT *, CASE WHEN hr >= 85 THEN 100 WHEN hr >= 70 THEN 85 WHEN hr >= 50 THEN 65 WHEN hr >= 30 THEN 40 ELSE 15 END AS hit_score, 100 - least(estimated_breaks, 10) * 10 AS break_score,
            CASE WHEN efficiency_ratio <= 200 THEN 100 WHEN efficiency_ratio <= 400 THEN 85 WHEN efficiency_ratio <= 600 THEN 70 WHEN efficiency_ratio <= 800 THEN 55 WHEN efficiency_ratio <= 1000 THEN 40 WHEN efficiency_ratio <= 1500 THEN 25 WHEN efficiency_ratio <= 2000 THEN 15 ELSE 5 END AS ratio_score FROM g0)""",
        """g2 AS (SELECT *, CAST(CASE WHEN efficiency_ratio > 2000 THEN least(round(CAST(hit_score AS DOUBLE) * 0.60 + CAST(trend_score AS DOUBLE) * 0.25 + CAST(break_score AS DOUBLE) * 0.15), 49) WHEN efficiency_ratio > 1500 THEN least(round(CAST(hit_score AS DOUBLE) * 0.60 + CAST(trend_score AS DOUBLE) * 0.25 + CAST(break_score AS DOUBLE) * 0.15), 64) ELSE round(CAST(hit_score AS DOUBLE) * 0.60 + CAST(trend_score AS DOUBLE) * 0.25 + CAST(break_score AS DOUBLE) * 0.15) END AS BIGINT) AS score FROM g1)""",
        "gr AS (SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' WHEN score >= 35 THEN 'D' ELSE 'F' END AS letter, round(hr * 10) / 10 AS hit_rate FROM g2)",
        f"""fr AS (SELECT dt, before_days, after_days, before_ratio, after_ratio, CASE WHEN after_ratio > before_ratio THEN 'worsened' ELSE 'improved' END AS direction, CASE WHEN after_ratio > before_ratio THEN after_ratio / before_ratio ELSE before_ratio / after_ratio END AS multiplier FROM (
            SELECT dt, count(*) OVER b AS before_days, count(*) OVER a AS after_days, {ratio_sql('sum(cache_read_tokens) OVER b', 'sum(output_tokens) OVER b')} AS before_ratio, {ratio_sql('sum(cache_read_tokens) OVER a', 'sum(output_tokens) OVER a')} AS after_ratio, count(*) OVER () AS active
            FROM dy WHERE output_tokens > 0 WINDOW b AS (ORDER BY dt ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS (ORDER BY dt ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) WHERE (SELECT count(*) FROM dy) >= 5 AND active >= 6 AND before_days >= 4 AND after_days >= 4 AND before_ratio > 0 AND after_ratio > 0)""",
        "ip AS (SELECT dt, before_days, after_days, before_ratio, after_ratio, direction, round(multiplier * 10) / 10 AS multiplier, row_number() OVER (ORDER BY direction DESC) = 1 AS is_primary FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY multiplier DESC, dt) AS n FROM fr WHERE multiplier >= 1.5) WHERE n = 1)",
        "cs AS (SELECT *, CASE WHEN std_dev > 0 THEN (usd - mean) / std_dev ELSE 0.0 END AS z FROM (SELECT *, count(*) OVER () AS n, avg(usd) OVER () AS mean, stddev_pop(usd) OVER () AS std_dev FROM (SELECT *, count(*) OVER () AS days, CAST(cost AS DOUBLE) / 1e8 AS usd FROM dy) WHERE usd > 0.01) WHERE days >= 3 AND n >= 3)",
        """ano AS (SELECT dt AS date, usd AS cost, round(z * 100) / 100 AS z_score, CASE WHEN abs(z) > 3 THEN 'critical' ELSE 'warning' END AS severity, CASE WHEN z > 0 THEN 'spike' ELSE 'dip' END AS anomaly_type, round(mean * 100) / 100 AS avg_cost, round((usd - mean) * 100) / 100 AS deviation, cache_output_ratio > 2000 AS cache_ratio_anomaly, cache_output_ratio FROM cs WHERE abs(z) > 2)""",
        f"""du AS (SELECT count(*) AS total_sessions, CAST(sum(duration_minutes) AS BIGINT) AS total_minutes, CAST(sum(duration_minutes) // count(*) AS BIGINT) AS avg_duration, list_sort(list(duration_minutes))[least(CAST(floor(count(*) * 0.5) AS BIGINT), count(*) - 1) + 1] AS median_duration, list_sort(list(duration_minutes))[least(CAST(floor(count(*) * 0.9) AS BIGINT), count(*) - 1) + 1] AS p90_duration,
            max(duration_minutes) AS max_duration, arg_max(project_name, (duration_minutes, -rank)) AS longest_session_project, count(*) FILTER (WHERE duration_minutes > 60) AS long_sessions, {percent_sql('count(*) FILTER (WHERE duration_minutes > 60)', 'count(*)')} AS long_session_pct, CAST(sum(tool_message_count) // count(*) AS BIGINT) AS avg_tool_messages FROM ses)""",
        f"po AS (SELECT {percent_sql('sum(n) FILTER (WHERE hour BETWEEN 12 AND 18)', 'sum(n)')} AS peak_overlap_pct FROM hr)",
        f"sv AS (SELECT CAST(round(CAST(sum(cache_read_tokens * ({_price(0)} - {_price(3)})) AS DOUBLE) / 1e8) AS BIGINT) AS from_caching, CAST(round(CAST(sum(cache_creation_tokens * ({_price(2)} - {_price(3)})) AS DOUBLE) / 1e8) AS BIGINT) AS wasted_from_breaks FROM dm)",
        f"mt AS (SELECT CAST(sum(messages) AS BIGINT) AS total_messages, count(*) FILTER (WHERE messages > 0) AS active_days, {ratio_sql('sum(messages)', 'count(*) FILTER (WHERE messages > 0)')} AS avg_messages_per_active_day FROM dy)",
        f"pt AS (SELECT CAST(sum(prompt_count) AS BIGINT) AS human, CAST(sum(tool_message_count) AS BIGINT) AS tool, CAST(sum(prompt_count) + sum(tool_message_count) AS BIGINT) AS total, {percent_sql('sum(prompt_count)', 'sum(prompt_count) + sum(tool_message_count)')} AS human_pct FROM ses)",
        "sk AS (SELECT max(n) AS longest_streak FROM (SELECT count(*) AS n FROM (SELECT CAST(dt AS DATE) - CAST(row_number() OVER (ORDER BY dt) AS INTEGER) AS island FROM dy WHERE messages > 0) GROUP BY island))",
        *more,
    ]
    return "WITH " + ",\n".join(parts) + "\n"


def query(name: str, sql: str | None = None, step: bool = False, more: tuple[str, ...] = (), plain: bool = False):
    def wrap(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql if plain else ctes(step, *more) + sql
        return f

    return wrap


def _act(spark: SparkSession, d: str, step: bool = False) -> DataFrame:
    return tables.activity(spark, d, step)


def _ent(spark: SparkSession, d: str, step: bool = False) -> DataFrame:
    return en.entries(_act(spark, d, step))


def _day(spark: SparkSession, d: str, step: bool = False) -> DataFrame:
    return en.daily(_ent(spark, d, step))


def _dm(spark: SparkSession, d: str, step: bool = False) -> DataFrame:
    return en.daily_model(_ent(spark, d, step))


def _ses(spark: SparkSession, d: str) -> DataFrame:
    return se.sessions(se.files(_act(spark, d)))


usd = an.dollars
C = F.col
USD = "CAST({} AS DOUBLE) / 1e8"


# entries


@query("activity", f"SELECT ord, message_id, type, is_tool_result, is_sidechain, dt, hour, file, parent_file, is_subagent, role, project_hash, cwd, model, {TOKENS}, cost_units FROM act")
def activity(spark, d):
    return _act(spark, d).select("ord", "message_id", "type", "is_tool_result", "is_sidechain", "dt", "hour", "file", "parent_file", "is_subagent", "role", "project_hash", "cwd", "model", *en.TOKENS, "cost_units")


@query("entries_dedup", f"SELECT ord, message_id, session_id, model, {TOKENS}, cost FROM ent")
def entries_dedup(spark, d):
    return _ent(spark, d).select("ord", "message_id", "session_id", "model", *en.TOKENS, "cost")


@query("entries_of_year", f"SELECT ord, dt, {USD.format('cost')} AS usd FROM ent WHERE substr(dt, 1, 4) = '2024'")
def entries_of_year(spark, d):
    return en.entries(_act(spark, d), 2024).select("ord", "dt", usd(C("cost")).alias("usd"))


@query("session_dedup", f"SELECT ord, file, message_id, {TOKENS} FROM said")
def session_dedup(spark, d):
    return se.session_messages(_act(spark, d)).select("ord", "file", "message_id", *en.TOKENS)


@query("tool_explode_top8", "SELECT tool AS name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tool) AS rank FROM ent GROUP BY tool QUALIFY rank <= 8")
def tool_explode_top8(spark, d):
    counts = en.tool_counts(_ent(spark, d))
    return counts.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "name")).cast("long")).where("rank <= 8")


@query("top_tool", "SELECT arg_max(tool, (n, tool)) AS name, max(n) AS n FROM (SELECT tool, count(*) AS n FROM ent GROUP BY tool)")
def top_tool(spark, d):
    return an.top_tool(en.tool_counts(_ent(spark, d)))


@query("daily_cost", f"SELECT dt, {TOKENS}, {USD.format('cost')} AS cost, messages, sessions, cache_output_ratio FROM dy")
def daily_cost(spark, d):
    return _day(spark, d).select("dt", *en.TOKENS, usd(C("cost")).alias("cost"), "messages", "sessions", "cache_output_ratio")


@query("daily_model_cost", f"SELECT dt, model, {TOKENS}, {USD.format('cost')} AS cost, messages FROM dm")
def daily_model_cost(spark, d):
    return _dm(spark, d).select("dt", "model", *en.TOKENS, usd(C("cost")).alias("cost"), "messages")


@query("model_cost_clean_name", f"SELECT model, {USD.format('cost')} AS cost FROM mc")
def model_cost_clean_name(spark, d):
    return en.model_costs(_dm(spark, d)).select("model", usd(C("cost")).alias("cost"))


@query("model_shares", f"SELECT model, cost, {percent_sql('cost', 'sum(cost) OVER ()')} AS share_of_total, least({percent_sql('cost', 'max(cost) OVER ()')}, 100) AS share_of_max FROM mc")
def model_shares(spark, d):
    return an.shares(en.model_costs(_dm(spark, d)), "cost")


# cost

MEDIAN = "(SELECT coalesce(quantile_cont(CAST(cost AS DOUBLE) / 1e8, 0.5) FILTER (WHERE CAST(cost AS DOUBLE) / 1e8 > 0.01), 0.0) FROM dy)"


@query("cost_summary", f"SELECT count(*) FILTER (WHERE messages > 0) AS active_days, {USD.format('sum(cost)')} AS total_cost, {USD.format('sum(cost)')} / count(*) FILTER (WHERE messages > 0) AS avg_daily_cost, {MEDIAN} AS median_daily_cost, arg_max(dt, (cost, dt)) AS peak_day, {USD.format('max(cost)')} AS peak_cost, {SUMS} FROM dy")
def cost_summary(spark, d):
    return an.cost_summary(_day(spark, d))


@query("median_daily_cost", f"SELECT {MEDIAN} AS median_daily_cost")
def median_daily_cost(spark, d):
    return an.cost_summary(_day(spark, d)).select("median_daily_cost")


@query("peak_day", f"SELECT arg_max(dt, (cost, dt)) AS dt, {USD.format('max(cost)')} AS cost FROM dy")
def peak_day(spark, d):
    return an.cost_summary(_day(spark, d)).select(C("peak_day").alias("dt"), C("peak_cost").alias("cost"))


@query("session_cost_stats", "SELECT count(*) AS total, CAST(sum(duration_minutes) AS BIGINT) AS total_minutes, CAST(sum(duration_minutes) // count(*) AS BIGINT) AS avg_minutes, arg_max(session_id, (duration_minutes, rank)) AS longest_session_id, arg_max(project_name, (duration_minutes, rank)) AS longest_session_project, max(duration_minutes) AS longest_minutes FROM ses")
def session_cost_stats(spark, d):
    return an.session_cost_stats(_ses(spark, d))


# projects


@query("project_summary", f"SELECT hash, path, name, {TOKENS}, messages, sessions, subagent_sessions FROM pr")
def project_summary(spark, d):
    return en.projects(_ent(spark, d)).drop("first_seen", "last_seen")


@query("project_first_last_seen", "SELECT project_hash AS hash, strftime(min(moment), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(moment), '%Y-%m-%d %H:%M:%S') AS last_seen FROM ent GROUP BY project_hash")
def project_first_last_seen(spark, d):
    return en.projects(_ent(spark, d)).select("hash", F.substring("first_seen", 1, 19).alias("first_seen"), F.substring("last_seen", 1, 19).alias("last_seen"))


@query("project_cwd_mode", "SELECT project_hash AS hash, cwd AS path FROM cwds")
def project_cwd_mode(spark, d):
    return en.projects(_ent(spark, d)).select("hash", "path")


@query("ranked_projects_share", "SELECT rank, hash, name, output_tokens, share_pct FROM rk")
def ranked_projects_share(spark, d):
    return en.ranked_projects(en.projects(_ent(spark, d))).select("rank", "hash", "name", "output_tokens", "share_pct")


@query("top_project", "SELECT name, path, share_pct, sessions, output_tokens FROM rk WHERE rank = 1")
def top_project(spark, d):
    return en.ranked_projects(en.projects(_ent(spark, d))).where("rank = 1").select("name", "path", "share_pct", "sessions", "output_tokens")


# sessions


@query("session_summary", f"SELECT rank, session_id, project_hash, project_path, project_name, duration_minutes, {TOKENS}, total_tokens, {USD.format('cost_units')} AS cost_usd, prompt_count, tool_message_count, first_prompt FROM ses")
def session_summary(spark, d):
    return global_rank(_ses(spark, d), "order").select("rank", "session_id", "project_hash", "project_path", "project_name", "duration_minutes", *en.TOKENS, "total_tokens", usd(C("cost_units")).alias("cost_usd"), "prompt_count", "tool_message_count", "first_prompt")


@query("session_model_totals", f"SELECT file, model, {SUMS} FROM said GROUP BY file, model")
def session_model_totals(spark, d):
    return se.model_totals(_act(spark, d))


@query("session_duration", "SELECT session_id, duration_minutes FROM ses")
def session_duration(spark, d):
    return _ses(spark, d).select("session_id", "duration_minutes")


@query("session_first_last", "SELECT s.session_id, strftime(f.start_at, '%Y-%m-%d %H:%M:%S') AS timestamp_start, strftime(f.end_at, '%Y-%m-%d %H:%M:%S') AS timestamp_end FROM ses s JOIN fl f USING (file)")
def session_first_last(spark, d):
    return _ses(spark, d).select("session_id", F.substring("timestamp_start", 1, 19).alias("timestamp_start"), F.substring("timestamp_end", 1, 19).alias("timestamp_end"))


@query("session_subagents", "SELECT session_id, parent_session_id, total_tokens, project_name FROM sub")
def session_subagents(spark, d):
    a = _act(spark, d)
    return se.subagents(se.files(a)).select("session_id", "parent_session_id", "total_tokens", "project_name")


@query("costly_subagents_top20", "SELECT rank, session_id, total_tokens, (SELECT count(*) FROM sub) AS all_subagents, (SELECT CAST(sum(total_tokens) AS BIGINT) FROM sub) AS all_tokens FROM sub WHERE rank <= 20")
def costly_subagents_top20(spark, d):
    a = _act(spark, d)
    every = se.subagents(se.files(a))
    top = every.orderBy("order").limit(20).withColumn("rank", F.row_number().over(Window.orderBy("order")).cast("long"))
    return top.select("rank", "session_id", "total_tokens").crossJoin(every.agg(F.count(F.lit(1)).alias("all_subagents"), F.sum("total_tokens").alias("all_tokens")))


@query("biggest_session_by_tokens", "SELECT arg_min(session_id, (-total_tokens, rank)) AS session_id, max(total_tokens) AS total_tokens FROM ses")
def biggest_session_by_tokens(spark, d):
    return _ses(spark, d).agg(F.min_by("session_id", F.struct(-C("total_tokens"), "order")).alias("session_id"), F.max("total_tokens").alias("total_tokens"))


@query("prompt_counts", "SELECT file, prompt_count, tool_message_count FROM fl WHERE total_tokens > 0")
def prompt_counts(spark, d):
    return se.files(_act(spark, d)).select("file", "prompt_count", "tool_message_count")


@query("prompt_ratio", "SELECT human, tool, total, human_pct FROM pt")
def prompt_ratio(spark, d):
    return an.prompt_ratio(_ses(spark, d))


@query("prompts_first5", "SELECT conv_id, n, turn, text FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user' AND trim(text) <> '') WHERE n <= 5", plain=True)
def prompts_first5(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").where("role = 'user'").select(C("conv_id").alias("file"), C("turn").alias("ord"), C("role").alias("type"), F.lit(False).alias("is_tool_result"), F.lit(False).alias("is_sidechain"), "text", C("turn").alias("ts"), F.lit(None).cast("string").alias("entrypoint"))
    return se.prompts(rows).select(C("file").alias("conv_id"), "n", C("ts").alias("turn"), "text")


@query("prompt_archive", "SELECT project_hash, n, text FROM (SELECT s.project_hash, 'do ' || p.ord AS text, row_number() OVER (PARTITION BY s.project_hash ORDER BY s.rank, p.k) AS n FROM ses s JOIN (SELECT file, ord, row_number() OVER (PARTITION BY file ORDER BY ord) AS k FROM act WHERE type = 'user' AND NOT is_tool_result AND NOT is_sidechain) p USING (file) WHERE p.k <= 5) WHERE n <= 5")
def prompt_archive(spark, d):
    a = _act(spark, d)
    own = se.sessions(se.files(a)).select("file", "project_hash", "order").join(se.prompts(a), "file")
    return own.withColumn("k", F.row_number().over(Window.partitionBy("project_hash").orderBy("order", "n")).cast("long")).where("k <= 5").select("project_hash", C("k").alias("n"), "text")


@query("session_duration_stats", "SELECT * FROM du")
def session_duration_stats(spark, d):
    return an.duration_stats(_ses(spark, d))


@query("session_percentiles", "SELECT median_duration, p90_duration, max_duration FROM du")
def session_percentiles(spark, d):
    return an.duration_stats(_ses(spark, d)).select("median_duration", "p90_duration", "max_duration")


@query("avg_messages_per_session", "SELECT CAST(sum(prompt_count + tool_message_count + coalesce(n, 0)) // count(*) AS BIGINT) AS avg_messages FROM ses LEFT JOIN (SELECT session_id, count(*) AS n FROM ent GROUP BY session_id) USING (session_id)")
def avg_messages_per_session(spark, d):
    return an.messages_per_session(_ses(spark, d), _ent(spark, d))


# hours and days


@query("hour_histogram", "SELECT hour, n FROM hr")
def hour_histogram(spark, d):
    return en.hours(_ent(spark, d))


@query("busiest_hour", f"SELECT hour, {HOUR.format(h='hour')} AS label, n, share_pct FROM (SELECT hour, n, {percent_sql('n', 'sum(n) OVER ()')} AS share_pct FROM hr) ORDER BY n DESC, hour DESC LIMIT 1")
def busiest_hour(spark, d):
    return an.busiest_hour(en.hours(_ent(spark, d)))


@query("peak_hours_top3", f"SELECT rank, hour, {HOUR.format(h='hour')} AS label, n, share_pct FROM (SELECT *, row_number() OVER (ORDER BY n DESC, hour) AS rank, {percent_sql('n', 'sum(n) OVER ()')} AS share_pct FROM hr) WHERE rank <= 3")
def peak_hours_top3(spark, d):
    return an.peak_hours(en.hours(_ent(spark, d)))


@query("peak_overlap", "SELECT peak_overlap_pct FROM po")
def peak_overlap(spark, d):
    return an.peak_overlap(en.hours(_ent(spark, d)))


@query("longest_streak", "SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, count(*) AS n FROM (SELECT user_id, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS island FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)) GROUP BY user_id, island) GROUP BY user_id", plain=True)
def longest_streak(spark, d):
    days = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.substring(C("ts").cast("string"), 1, 10).alias("dt"))
    return an.streaks(days, ["user_id"])


@query("order_streaks", "SELECT o_custkey, max(n) AS longest_streak FROM (SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, d - CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS INTEGER) AS island FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)) GROUP BY o_custkey, island) GROUP BY o_custkey", plain=True)
def order_streaks(spark, d):
    return an.streaks(spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.substring(C("o_orderdate").cast("string"), 1, 10).alias("dt")), ["o_custkey"])


@query("active_streak", "SELECT longest_streak FROM sk")
def active_streak(spark, d):
    return an.streaks(_day(spark, d).where("messages > 0"), [])


@query("favorite_weekday", "SELECT arg_max(label, (n, label)) AS label, max(n) AS n FROM (SELECT dayname(CAST(dt AS DATE)) AS label, CAST(sum(greatest(messages, 1)) AS BIGINT) AS n FROM dy WHERE messages > 0 GROUP BY 1)")
def favorite_weekday(spark, d):
    return an.favorite_weekday(_day(spark, d))


@query("message_totals", "SELECT * FROM mt")
def message_totals(spark, d):
    return an.message_totals(_day(spark, d))


@query("daily_sparkline_buckets", "SELECT bucket, mean, CAST(CASE WHEN max(mean) OVER () > 0 THEN round(mean / max(mean) OVER () * 7) ELSE 0 END AS BIGINT) AS level FROM (SELECT bucket, CAST(sum(cost) AS DOUBLE) / count(*) / 1e8 AS mean FROM (SELECT cost, CASE WHEN n <= 12 THEN i ELSE ((i + 1) * 12 - 1) // n END AS bucket FROM (SELECT cost, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM dy)) GROUP BY bucket)")
def daily_sparkline_buckets(spark, d):
    return an.sparkline_buckets(_day(spark, d))


@query("activity_bars", f"SELECT dt, cost, {percent_sql('cost', 'sum(cost) OVER ()')} AS share_of_total, least({percent_sql('cost', 'max(cost) OVER ()')}, 100) AS share_of_max FROM dy")
def activity_bars(spark, d):
    return an.shares(_day(spark, d).select("dt", "cost"), "cost")


# cache


@query("cache_health", f"SELECT {TOKENS}, hit_rate, efficiency_ratio, estimated_breaks FROM gr")
def cache_health(spark, d):
    return an.cache_totals(_day(spark, d)).withColumn("hit_rate", an.to_places(C("hit_rate"), 1))


@query("cache_break_reasons", "SELECT 'Unknown / Server-side' AS reason, estimated_breaks AS n, CAST(100 AS BIGINT) AS percentage FROM gr WHERE estimated_breaks > 0")
def cache_break_reasons(spark, d):
    return an.break_reasons(an.cache_totals(_day(spark, d)))


@query("cache_savings", "SELECT * FROM sv")
def cache_savings(spark, d):
    return an.cache_savings(_dm(spark, d))


@query("cache_trend", "SELECT days, recent_ratio, older_ratio, CAST(trend_score AS BIGINT) AS trend_score FROM ts", step=True)
def cache_trend(spark, d):
    return an.cache_trend(_day(spark, d, True))


@query("cache_grade", "SELECT hit_rate, efficiency_ratio, estimated_breaks, CAST(hit_score AS BIGINT) AS hit_score, CAST(trend_score AS BIGINT) AS trend_score, CAST(break_score AS BIGINT) AS break_score, CAST(ratio_score AS BIGINT) AS ratio_score, score, letter FROM gr")
def cache_grade(spark, d):
    return an.cache_grade(_day(spark, d)).select("hit_rate", "efficiency_ratio", "estimated_breaks", "hit_score", "trend_score", "break_score", "ratio_score", "score", "letter")


@query("cache_mood", "SELECT letter, CASE WHEN letter IN ('A', 'B') THEN 'Cache under control' WHEN letter = 'C' THEN 'Cache needs tuning' ELSE 'Cache chaos energy' END AS mood FROM gr")
def cache_mood(spark, d):
    return an.cache_grade(_day(spark, d)).select("letter", story.cache_mood(C("letter")).alias("mood"))


# change points, anomalies, trends


@query("inflection_frames", "SELECT * FROM fr", step=True)
def inflection_frames(spark, d):
    return an.inflection_frames(_day(spark, d, True))


@query("inflection_point", "SELECT * FROM ip", step=True)
def inflection_point(spark, d):
    return an.inflections(_day(spark, d, True)).drop("summary")


@query("cost_anomalies", "SELECT * FROM ano", step=True)
def cost_anomalies(spark, d):
    return an.anomalies(_day(spark, d, True))


@query("cost_trend", f"""SELECT days, CASE WHEN days < 7 OR change IS NULL THEN 'stable' WHEN change > 50 THEN 'rising_fast' WHEN change > 20 THEN 'rising' WHEN change < -50 THEN 'dropping_fast' WHEN change < -20 THEN 'dropping' ELSE 'stable' END AS trend, CASE WHEN days >= 7 THEN round(change * 100) / 100 END AS change_pct
FROM (SELECT days, (r - o) / nullif(o, 0) * 100 AS change FROM (SELECT max(days) AS days, {USD.format("sum(cost) FILTER (WHERE k <= 7 AND cost > 1000000)")} / nullif(count(*) FILTER (WHERE k <= 7 AND cost > 1000000), 0) AS r, {USD.format("sum(cost) FILTER (WHERE k > 7 AND cost > 1000000)")} / nullif(count(*) FILTER (WHERE k > 7 AND cost > 1000000), 0) AS o FROM (SELECT *, row_number() OVER (ORDER BY dt DESC) AS k, count(*) OVER () AS days FROM dy)))""", step=True)
def cost_trend(spark, d):
    return an.cost_trend(_day(spark, d, True))


# models


def _routing(spark, d):
    e = _ent(spark, d)
    return an.model_routing(en.model_costs(en.daily_model(e)), e)


SUBAGENT = f"(SELECT {percent_sql('count(*) FILTER (WHERE is_subagent)', 'count(*)')} FROM ent)"
DIVERSITY = "CAST(CASE WHEN NOT available THEN 0 WHEN models >= 3 AND opus_pct < 80 THEN 90 WHEN models >= 2 AND opus_pct < 90 THEN 60 WHEN opus_pct > 95 THEN 20 ELSE 40 END AS BIGINT)"


@query("model_routing", f"SELECT available, opus_pct, sonnet_pct, haiku_pct, CASE WHEN available THEN opus_cost * CAST(0.4 AS DOUBLE) - opus_cost * CAST(0.4 AS DOUBLE) * CAST(0.6 AS DOUBLE) ELSE 0.0 END AS estimated_savings, {SUBAGENT} AS subagent_pct, {DIVERSITY} AS diversity_score, total_cost, opus_cost, sonnet_cost, haiku_cost, other_cost FROM rt")
def model_routing(spark, d):
    return _routing(spark, d)


@query("tier_costs", "SELECT tier, cost FROM (SELECT unnest([('opus', opus_cost), ('sonnet', sonnet_cost), ('haiku', haiku_cost), ('other', other_cost)]) AS t, t[1] AS tier, t[2] AS cost FROM rt)")
def tier_costs(spark, d):
    return an.tier_costs(en.model_costs(_dm(spark, d))).select("tier", usd(C("cost")).alias("cost"))


@query("diversity_score", f"SELECT models, opus_pct, {DIVERSITY} AS diversity_score FROM rt")
def diversity_score(spark, d):
    costs = en.model_costs(_dm(spark, d))
    return an.model_routing(costs, _ent(spark, d)).select("opus_pct", "diversity_score").crossJoin(costs.agg(F.count(F.lit(1)).alias("models")))


# story and rules


@query("archetype_card", "SELECT opus_pct, CASE WHEN opus_pct >= 75 THEN 'Precision Maximalist' WHEN sonnet_pct + haiku_pct >= 45 THEN 'Delegation Director' WHEN avg_messages_per_active_day >= 120 THEN 'Flow-State Builder' ELSE 'Balanced Operator' END AS archetype FROM rt, mt")
def archetype_card(spark, d):
    both = _routing(spark, d).crossJoin(an.message_totals(_day(spark, d)))
    return both.select("opus_pct", story.archetype(C("opus_pct"), C("sonnet_pct") + C("haiku_pct"), C("avg_messages_per_active_day")).alias("archetype"))


@query("momentum", "SELECT longest_streak, CASE WHEN longest_streak >= 5 THEN longest_streak || '-day streak' WHEN avg_messages_per_active_day >= 120 THEN 'Burst-mode operator' ELSE 'Measured tempo' END AS momentum FROM sk, mt")
def momentum(spark, d):
    day = _day(spark, d)
    both = an.streaks(day.where("messages > 0"), []).crossJoin(an.message_totals(day))
    return both.select("longest_streak", story.momentum(C("longest_streak"), C("avg_messages_per_active_day")).alias("momentum"))


CURRENCY = "CASE WHEN {v} >= 1000 THEN '$' || format('{{:,}}', CAST(round({v}) AS BIGINT)) WHEN {v} >= 100 THEN '$' || printf('%.0f', {v}) ELSE '$' || printf('%.2f', {v}) END"
RATIO_LABEL = "CASE WHEN {v} = 0 THEN 'N/A' ELSE format('{{:,}}', {v}) || ':1' END"


@query(
    "hero_stats",
    f"""SELECT n, label, value, note FROM (SELECT unnest([
 (1, 'Equivalent spend', {CURRENCY.format(v='total_cost')}, active_days || CASE WHEN active_days = 1 THEN ' active day' ELSE ' active days' END),
 (2, 'Messages', format('{{:,}}', total_messages), format('{{:,}}', avg_messages_per_active_day) || '/active day'),
 (3, 'Cache ratio', {RATIO_LABEL.format(v='efficiency_ratio')}, 'Grade ' || letter),
 (4, 'Model mix', CASE WHEN NOT available THEN 'Model mix warming up' WHEN opus_pct >= 75 THEN opus_pct || '% Opus' WHEN sonnet_pct >= opus_pct THEN sonnet_pct || '% Sonnet' ELSE opus_pct || '% Opus / ' || sonnet_pct || '% Sonnet' END, CASE WHEN letter IN ('A', 'B') THEN 'Cache under control' WHEN letter = 'C' THEN 'Cache needs tuning' ELSE 'Cache chaos energy' END),
 (5, 'Human prompts', human_pct || '%', format('{{:,}}', human) || ' human / ' || format('{{:,}}', tool) || ' tool')]) AS t, CAST(t[1] AS BIGINT) AS n, t[2] AS label, t[3] AS value, t[4] AS note FROM rt, mt, gr, pt)""",
)
def hero_stats(spark, d):
    r = report.Relations(_act(spark, d))
    return r.released_with(report.story_facts(r).select(F.posexplode(story.hero_stats()).alias("n", "h")).select((C("n") + 1).cast("long").alias("n"), "h.*"))


FACTS = """facts AS (SELECT total_cost, available, opus_pct, opus_pct * 21 // 100 AS opus_saving, total_sessions, avg_duration, p90_duration, efficiency_ratio, peak_overlap_pct, from_caching, i.*, s.*, printf('%.0f', spike_cost) AS spike_dollars, spikes || CASE WHEN spikes = 1 THEN ' cost spike' ELSE ' cost spikes' END AS spikes_label, t.*, (SELECT count(*) FROM pr) AS projects
 FROM rt, gr, du, po, sv, (SELECT max(direction) AS direction, max(multiplier) AS multiplier, printf('%.1f', max(multiplier)) AS times, max(dt) AS change_date FROM ip WHERE is_primary) i,
 (SELECT count(*) AS spikes, arg_max(severity, row(cost, -epoch(CAST(date AS TIMESTAMP)))) AS spike_severity, max(cost) AS spike_cost, arg_max(date, row(cost, -epoch(CAST(date AS TIMESTAMP)))) AS spike_date FROM ano WHERE anomaly_type = 'spike') s,
 (SELECT max(name) AS top_name, max(share_pct) AS top_share FROM rk WHERE rank = 1) t)"""


def _rule_sql(rule: tuple[str, ...]) -> str:
    cond, *texts = rule
    return f"CASE WHEN {cond} THEN struct_pack({', '.join(f'{n} := {rules.filled(t, chr(39) * 2)}' for n, t in zip(rules.NAMES, texts))}) END"


def _rules_sql(*own: tuple[str, ...]) -> str:
    return f"[x FOR x IN [{', '.join(map(_rule_sql, own))}] IF x IS NOT NULL]"


ADVICE = f"adv AS (SELECT CAST(n AS BIGINT) AS n, r.* FROM (SELECT unnest(range(1, len(a) + 1)) AS n, unnest(a) AS r FROM (SELECT (CASE WHEN len(f) > 0 THEN list_concat(f, h) ELSE b END)[1:{rules.MOST}] AS a FROM (SELECT {_rules_sql(*rules.SIGNALS)} AS f, {_rules_sql(*rules.HYGIENE)} AS h, {_rules_sql(rules.FALLBACK)} AS b FROM facts))))"


@query("recommendations", "SELECT * FROM adv", step=True, more=(FACTS, ADVICE))
def recommendations(spark, d):
    r = report.Relations(_act(spark, d, True))
    return r.released_with(r.recommendations.select("*"))


@query("recommendations_of_even_use", "SELECT * FROM adv", more=(FACTS, ADVICE))
def recommendations_of_even_use(spark, d):
    """Without the change and the spike that the step variant has, so that other rules fire."""
    r = report.Relations(_act(spark, d))
    return r.released_with(r.recommendations.select("*"))


TOKENS_LABEL = "CASE WHEN {v} >= 1000000000 THEN printf('%.1f', {v} / 1e9) || 'B' WHEN {v} >= 1000000 THEN printf('%.1f', {v} / 1e6) || 'M' WHEN {v} >= 1000 THEN printf('%.1f', {v} / 1e3) || 'K' ELSE CAST({v} AS VARCHAR) END"


def _preview(t: str, most: int) -> str:
    c = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN {c} = '' THEN 'No prompt preview available.' WHEN length({c}) <= {most} THEN {c} ELSE rtrim(left({c}, {most - 1}), ' ') || '…' END"


STORY = f"""sto AS (SELECT *, sonnet_pct + haiku_pct AS light, (SELECT hour FROM hr WHERE n > 0 ORDER BY n DESC, hour LIMIT 1) AS ph, (SELECT sum(n) FROM hr) AS answers, (SELECT max(n) FROM hr) AS ph_n FROM rt, gr, mt, sk),
big AS (SELECT * FROM ses WHERE rank = 1),
hel AS (SELECT s.*, CASE WHEN f.first_ord IS NOT NULL THEN 'do ' || f.first_ord END AS first_prompt FROM sub s JOIN fl f ON f.file = s.session_id WHERE s.rank = 1),
hl AS (SELECT unnest([
 (1, 'Archetype', CASE WHEN opus_pct >= 75 THEN 'Precision Maximalist' WHEN light >= 45 THEN 'Delegation Director' WHEN avg_messages_per_active_day >= 120 THEN 'Flow-State Builder' ELSE 'Balanced Operator' END,
  CASE WHEN opus_pct >= 75 THEN opus_pct || '% of spend is Opus: few swings, but heavy ones.' WHEN light >= 45 THEN light || '% of spend is on lighter models: work gets routed, not forced.' WHEN avg_messages_per_active_day >= 120 THEN 'A steady stream of messages, momentum first.' ELSE 'Exploring and executing in equal measure.' END),
 (2, 'Power hour', {HOUR.format(h='ph')}, {percent_sql('ph_n', 'answers')} || '% of answers come around ' || {HOUR.format(h='ph')} || '. ' || CASE WHEN ph < 6 THEN 'Night shift mode.' WHEN ph < 12 THEN 'Morning shipping energy.' WHEN ph < 18 THEN 'Afternoon builder hours.' ELSE 'Evening closer energy.' END),
 (3, 'Main project', k.name, k.share_pct || '% of output in ' || k.sessions || CASE WHEN k.sessions = 1 THEN ' session' ELSE ' sessions' END),
 (4, 'Biggest session', {TOKENS_LABEL.format(v='b.total_tokens')}, concat_ws(' · ', CASE WHEN b.project_name <> '' THEN b.project_name END, left(CAST(f.start_at AS VARCHAR), 10), CASE WHEN b.first_prompt IS NOT NULL THEN {_preview('b.first_prompt', 86)} END)),
 (5, 'Subagent cameo', {TOKENS_LABEL.format(v='h.total_tokens')}, coalesce(h.project_name, 'A project') || ' had help. ' || {_preview("coalesce(h.first_prompt, '')", 92)}),
 (6, 'Next season', v.title, v.action)]) AS t FROM sto, big b, fl f, hel h, rk k, adv v WHERE f.file = b.file AND k.rank = 1 AND v.n = 1)"""


@query("highlights", "SELECT CAST(t[1] AS BIGINT) AS n, t[2] AS eyebrow, t[3] AS title, t[4] AS note FROM hl", more=(FACTS, ADVICE, STORY))
def highlights(spark, d):
    r = report.Relations(_act(spark, d))
    return r.released_with(report.story_facts(r).select(F.posexplode(story.highlights()).alias("n", "h")).select((C("n") + 1).cast("long").alias("n"), "h.*"))


# scalar functions



@query("fmt_currency", f"SELECT o_orderkey, {CURRENCY.format(v='v')} AS label FROM (SELECT o_orderkey, o_totalprice / (CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1000 ELSE 100000 END) AS v FROM orders)", plain=True)
def fmt_currency(spark, d):
    v = C("o_totalprice") / F.when(C("o_orderkey") % 3 == 0, 1).when(C("o_orderkey") % 3 == 1, 1000).otherwise(100000)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", ft.currency(v).alias("label"))


@query("fmt_tokens", f"SELECT ord, {TOKENS_LABEL.format(v='v')} AS label FROM (SELECT ord, CASE WHEN ord % 4 = 3 THEN input_tokens * 100000000 WHEN ord % 4 = 2 THEN input_tokens * 100000 WHEN ord % 4 = 1 THEN input_tokens * 100 ELSE input_tokens END AS v FROM act)")
def fmt_tokens(spark, d):
    v = F.when(C("ord") % 4 == 3, C("input_tokens") * 100000000).when(C("ord") % 4 == 2, C("input_tokens") * 100000).when(C("ord") % 4 == 1, C("input_tokens") * 100).otherwise(C("input_tokens"))
    return _act(spark, d).select("ord", ft.tokens_label(v).alias("label"))


@query("fmt_ratio", f"SELECT dt, {RATIO_LABEL.format(v='cache_output_ratio')} AS label, {RATIO_LABEL.format(v='messages * 1000')} AS large FROM dy")
def fmt_ratio(spark, d):
    return _day(spark, d).select("dt", ft.ratio_label(C("cache_output_ratio")).alias("label"), ft.ratio_label(C("messages") * 1000).alias("large"))


@query("fmt_hour", f"SELECT hour, {HOUR.format(h='hour')} AS label FROM (SELECT unnest(range(24)) AS hour)", plain=True)
def fmt_hour(spark, d):
    return spark.range(24).select(C("id").alias("hour"), fti.hour_label(C("id")).alias("label"))


@query("trim_text", "SELECT doc_id, CASE WHEN c = '' THEN 'No prompt preview available.' WHEN length(c) <= 86 THEN c ELSE rtrim(left(c, 85), ' ') || '…' END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g')) AS c FROM documents)", plain=True)
def trim_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", ft.preview(C("text"), 86).alias("preview"))


@query("project_slug", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_type || ')'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part", plain=True)
def project_slug(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", ft.slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"))


@query("escape_html", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages", plain=True)
def escape_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", ft.html(C("html")).alias("escaped"))


HASHES = ("-work-demo-app", "-home-me", "-Users-me-my--lib", "c--Users-me-x", "plain-path", "", "unknown", "-", "--", "a---b", "-work-proj--5")


@query("decode_project_hash", f"SELECT h AS hash, {PATH.format(h='h')} AS path, coalesce({NAME.format(p='(' + PATH.format(h='h') + ')')}, 'Unknown') AS name FROM (SELECT DISTINCT project_hash AS h FROM act UNION SELECT unnest({list(HASHES)!r}))")
def decode_project_hash(spark, d):
    rows = _act(spark, d).select(C("project_hash").alias("hash")).union(spark.createDataFrame([(h,) for h in HASHES], "hash string")).distinct()
    return rows.select("hash", ft.decoded_path(C("hash")).alias("path"), ft.decoded_name(C("hash")).alias("name"))


@query("derive_project_name", f"SELECT DISTINCT cwd, {NAME.format(p='cwd')} AS name FROM act WHERE cwd IS NOT NULL")
def derive_project_name(spark, d):
    return _act(spark, d).where("cwd is not null").select("cwd", ft.project_name(C("cwd")).alias("name")).distinct()


@query("weekday_of_orders", "SELECT o_orderkey, dayname(o_orderdate) AS weekday, strftime(o_orderdate, '%b %-d') AS short_date FROM orders", plain=True)
def weekday_of_orders(spark, d):
    key = F.substring(C("o_orderdate").cast("string"), 1, 10)
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", fti.weekday(key).alias("weekday"), fti.short_date(key).alias("short_date"))


# logs


#: The sample tree has a file for each user, a user's events in their order, and before them a summary, a malformed and a blank line.
LOG = """usr AS (SELECT *, CAST(regexp_extract(file, 's(\\d+)-', 1) AS BIGINT) AS user_id FROM act),
log AS (SELECT *, '-work-proj--' || (main % 7) || '/user-' || main || CASE WHEN is_subagent THEN '/subagents/user-' || user_id ELSE '' END || '.jsonl' AS path FROM (SELECT *, CASE WHEN is_subagent THEN user_id - 1 ELSE user_id END AS main FROM usr))"""


@query("jsonl_parse_quality", "SELECT count(DISTINCT path) AS files, CAST(0 AS BIGINT) AS skipped_files, count(*) + count(DISTINCT path) AS lines, count(DISTINCT path) AS skipped_lines FROM log", more=(LOG,))
def jsonl_parse_quality(spark, d):
    return logs.quality(logs.parsed_lines(spark, logs.write_sample(spark, d)))


@query(
    "jsonl_daily_cost",
    f"""SELECT *, {ratio_sql('cache_read_tokens', 'output_tokens')} AS cache_output_ratio FROM (
    SELECT dt, {SUMS}, CAST(sum(CASE WHEN cost_units > 0 THEN cost_units ELSE {PRICED} END) AS DOUBLE) / 1e8 AS cost, count(*) AS messages, count(DISTINCT user_id) AS sessions
    FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY string_split(path, '/'), ord) AS rn FROM log WHERE type = 'assistant') WHERE rn = 1 OR message_id IS NULL GROUP BY dt)""",
    more=(LOG,),
)
def jsonl_daily_cost(spark, d):
    act = logs.activity(logs.parsed_lines(spark, logs.write_sample(spark, d)))
    return en.daily(en.entries(act)).select("dt", *en.TOKENS, usd(C("cost")).alias("cost"), "messages", "sessions", "cache_output_ratio")


@query("report_json")
def report_json(spark, d):
    return report.report_json(_act(spark, d), 2024)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
