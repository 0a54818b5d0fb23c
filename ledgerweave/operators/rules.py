"""Recommendations: rules over one row of facts, in a fixed order."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 10


def _one(df: DataFrame, *columns) -> DataFrame:
    """One row, with nulls if df has none."""
    return df.agg(*(F.first(c).alias(c) for c in columns))


def facts(cost: DataFrame, grade: DataFrame, savings: DataFrame, anomalies: DataFrame, inflections: DataFrame, durations: DataFrame, overlap: DataFrame, routing: DataFrame, projects: DataFrame, ranked: DataFrame) -> DataFrame:
    """The one row that the rules look at."""
    worst = F.struct("cost", F.expr("-unix_date(try_cast(date AS date))").alias("d"))
    spikes = anomalies.where("anomaly_type = 'spike'").agg(F.count(F.lit(1)).alias("spikes"), F.max_by("severity", worst).alias("spike_severity"), F.max("cost").alias("spike_cost"), F.max_by("date", worst).alias("spike_date"))
    parts = [
        cost.select("total_cost"),
        grade.select("efficiency_ratio"),
        savings.select("from_caching"),
        spikes,
        _one(inflections.where("is_primary").select(F.col("direction"), F.col("multiplier"), F.col("dt").alias("change_date")), "direction", "multiplier", "change_date"),
        durations.select("total_sessions", "avg_duration", "p90_duration"),
        overlap,
        routing.select("available", "opus_pct"),
        projects.agg(F.count(F.lit(1)).alias("projects")),
        _one(ranked.where("rank = 1").select(F.col("name").alias("top_name"), F.col("share_pct").alias("top_share")), "top_name", "top_share"),
    ]
    return reduce(DataFrame.crossJoin, parts)


#: (condition, rule, severity, title, savings, action). Conditions are SQL over the facts; in the texts {x} stands for fact x. The
#: severity of a rule may be a fact as well.
SIGNALS = (
    ("direction = 'worsened' AND multiplier >= 2", "inflection_worsened", "critical", "Cache efficiency dropped {times}x on {change_date}", "about half of usage once fixed", "Look at what changed that day: stale sessions brought back to life, missing compaction, or a client update."),
    ("direction = 'improved' AND multiplier >= 2", "inflection_improved", "positive", "Efficiency improved {times}x on {change_date}", "already earned", "Whatever changed in the workflow then pays off; keep doing it."),
    ("available AND opus_pct > 80", "opus_heavy", "warning", "Opus takes {opus_pct}% of spend", "about {opus_saving}% of usage", "Leave searching, bulk edits and other routine to a lighter model and keep the largest for synthesis."),
    ("total_sessions > 0 AND avg_duration > 60", "long_sessions", "warning", "Sessions last {avg_duration} minutes on average", "15 to 25% of usage", "Context grows with every turn: compact, or begin anew, before minute {p90_duration}."),
    ("efficiency_ratio > 1500", "cache_ratio_severe", "critical", "A cache ratio of {efficiency_ratio}:1 is severe", "about half of usage", "Restart old threads, leave the project notes unchanged during a run, and avoid pauses that outlive the cache."),
    ("efficiency_ratio > 800 AND efficiency_ratio <= 1500", "cache_ratio_elevated", "info", "A cache ratio of {efficiency_ratio}:1 is elevated", "5 to 10% of usage", "Compact sooner and repeat less boilerplate in prompts."),
    ("spikes > 0", "cost_spikes", "{spike_severity}", "{spikes_label}, the worst of ${spike_dollars} on {spike_date}", "avoidable if watched", "If spend jumps in the first turns before anything useful appears, stop and restart."),
    ("projects > 1 AND top_share > 30", "dominant_project", "info", "{top_name} makes {top_share}% of output", "the first place to look", "Check whether {top_name} needs its models and its session lengths."),
    ("efficiency_ratio > 500", "prompt_cache_idle_gaps", "info", "Idle gaps rebuild the prompt cache", "10 to 30% of usage", "Cached context expires within minutes; after a break a fresh task is often cheaper."),
    ("total_sessions > 0 AND peak_overlap_pct > 40", "throttled_hours", "info", "{peak_overlap_pct}% of work falls into throttled hours", "longer windows for heavy work", "Move heavy work to quieter hours where possible."),
    ("from_caching > 100", "cache_savings", "positive", "Caching saved about ${from_caching}", "working as it should", "Prompts, tool schemas and session shapes that stay stable keep it that way."),
)
HYGIENE = (
    ("TRUE", "claudeignore", "info", "Keep build artefacts out of context", "5 to 10% of each load", "List generated files, dependencies and lock files in an ignore file."),
    ("TRUE", "scoped_prompts", "info", "Ask narrow questions", "20 to 40% of usage", "Name the file, the function and the failure, so that nothing has to be explored."),
)
FALLBACK = ("total_cost > 0", "no_dominant_inefficiency", "positive", "Nothing stands out", "steady", "Go on as before, and watch the cache ratio and the length of sessions.")
NAMES = ("rule", "severity", "title", "savings", "action")


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a fact, literal text or name) of each part of a text."""
    return [(i % 2 == 1, x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]


def filled(template: str, quote: str) -> str:
    """A text as an SQL expression; quote: how a quotation mark in a literal is written."""
    return " || ".join(f"cast({x} AS {'string' if quote != chr(39) * 2 else 'varchar'})" if fact else "'" + x.replace("'", quote) + "'" for fact, x in pieces(template))


def _rows(*own: tuple[str, ...]) -> str:
    """An array of structs of the rules that fire, in Spark's SQL."""
    made = (f"CASE WHEN {cond} THEN named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {filled(t, chr(92) + chr(39))}' for n, t in zip(NAMES, texts))}) END" for cond, *texts in own)
    return f"filter(array({', '.join(made)}), x -> x IS NOT NULL)"


def recommendations(facts: DataFrame) -> DataFrame:
    """(n, rule, severity, title, savings, action); n from 1. Hygiene follows if any signal fires, else a fallback stands alone."""
    facts = facts.withColumns(
        {
            "times": F.format_string("%.1f", "multiplier"),
            "opus_saving": F.floor(F.col("opus_pct") * 21 / 100),
            "spikes_label": F.concat(F.col("spikes").cast("string"), F.when(F.col("spikes") == 1, " cost spike").otherwise(" cost spikes")),
            "spike_dollars": F.format_string("%.0f", "spike_cost"),
        }
    )
    both = F.expr(f"CASE WHEN size({_rows(*SIGNALS)}) > 0 THEN concat({_rows(*SIGNALS)}, {_rows(*HYGIENE)}) ELSE {_rows(FALLBACK)} END")
    return facts.select(F.posexplode(F.slice(both, 1, MOST)).alias("n", "r")).select((F.col("n") + 1).cast("long").alias("n"), "r.*")
