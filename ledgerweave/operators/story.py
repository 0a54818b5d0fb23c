"""The story of a year: labels and moods derived from the analyses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerweave.functions.text import currency, grouped, preview, ratio_label, tokens_label


def archetype(opus_pct: Column, light_pct: Column, average: Column) -> Column:
    return F.when(opus_pct >= 75, "Precision Maximalist").when(light_pct >= 45, "Delegation Director").when(average >= 120, "Flow-State Builder").otherwise("Balanced Operator")


def archetype_note(opus_pct: Column, light_pct: Column, average: Column) -> Column:
    return (
        F.when(opus_pct >= 75, F.concat(opus_pct, F.lit("% of spend is Opus: few swings, but heavy ones.")))
        .when(light_pct >= 45, F.concat(light_pct, F.lit("% of spend is on lighter models: work gets routed, not forced.")))
        .when(average >= 120, F.lit("A steady stream of messages, momentum first."))
        .otherwise(F.lit("Exploring and executing in equal measure."))
    )


def cache_mood(letter: Column) -> Column:
    return F.when(letter.isin("A", "B"), "Cache under control").when(letter == "C", "Cache needs tuning").otherwise("Cache chaos energy")


def cache_mood_note(letter: Column, ratio: Column) -> Column:
    return F.when(letter.isin("A", "B"), F.concat(F.lit("At "), ratio_label(ratio), F.lit(" the cache works in your favour."))).when(letter == "C", F.lit("It serves, with slack left in sessions and routing.")).otherwise(F.lit("Efficiency leaks: compact more, revive less."))


def momentum(streak: Column, average: Column) -> Column:
    return F.when(streak >= 5, F.concat(streak, F.lit("-day streak"))).when(average >= 120, "Burst-mode operator").otherwise("Measured tempo")


def momentum_note(streak: Column, average: Column) -> Column:
    return F.when(streak >= 5, "Day after day without a gap.").when(average >= 120, "Much work packed into the active days.").otherwise("Used when it matters, quiet otherwise.")


def hour_mood(hour: Column) -> Column:
    return F.when(hour < 6, "Night shift mode.").when(hour < 12, "Morning shipping energy.").when(hour < 18, "Afternoon builder hours.").otherwise("Evening closer energy.")


def model_mix(available: Column, opus_pct: Column, sonnet_pct: Column) -> Column:
    opus, sonnet = F.concat(opus_pct, F.lit("% Opus")), F.concat(sonnet_pct, F.lit("% Sonnet"))
    return F.when(~available, "Model mix warming up").when(opus_pct >= 75, opus).when(sonnet_pct >= opus_pct, sonnet).otherwise(F.concat_ws(" / ", opus, sonnet))


def session_note(name: Column, start: Column, prompt: Column) -> Column:
    """Name, date and preview, as far as there are any."""
    return F.concat_ws(" · ", F.when(name != "", name), F.when(F.octet_length(start) >= 10, F.substring(start, 1, 10)), F.when(prompt.isNotNull(), preview(prompt, 86)))


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {word}")).otherwise(F.lit(f" {word}s")))


def hero_stats() -> Column:
    """Five (label, value, note), from the columns of a row of story facts."""
    c = F.col
    average = F.when(c("average") > 0, F.concat(grouped(c("average")), F.lit("/active day"))).otherwise(F.lit("Across all sessions"))
    rows = (
        ("Equivalent spend", currency(c("total_cost")), plural(c("active_days"), "active day")),
        ("Messages", grouped(c("total_messages")), average),
        ("Cache ratio", ratio_label(c("efficiency_ratio")), F.concat(F.lit("Grade "), c("letter"))),
        ("Model mix", model_mix(c("available"), c("opus_pct"), c("sonnet_pct")), cache_mood(c("letter"))),
        ("Human prompts", F.concat(c("human_pct"), F.lit("%")), F.concat(grouped(c("human")), F.lit(" human / "), grouped(c("tool")), F.lit(" tool"))),
    )
    return F.array(*(F.struct(F.lit(a).alias("label"), b.alias("value"), d.alias("note")) for a, b, d in rows))


def highlights() -> Column:
    """Six (eyebrow, title, note), from the columns of a row of story facts."""
    c = F.col
    light = c("sonnet_pct") + c("haiku_pct")
    big = c("biggest_session.total_tokens").isNotNull()
    aide = c("biggest_subagent.total_tokens").isNotNull()
    rows = (
        (F.lit("Archetype"), archetype(c("opus_pct"), light, c("average")), archetype_note(c("opus_pct"), light, c("average"))),
        (
            F.lit("Power hour"),
            F.coalesce(c("power_hour.label"), F.lit("Not enough times yet")),
            F.when(c("power_hour.label").isNotNull(), F.concat(c("power_hour.share_pct"), F.lit("% of answers come around "), c("power_hour.label"), F.lit(". "), hour_mood(c("power_hour.hour")))).otherwise("A few more sessions will tell."),
        ),
        (
            F.lit("Main project"),
            F.coalesce(c("top_project.name"), F.lit("No project leads yet")),
            F.when(c("top_project.name").isNotNull(), F.concat(c("top_project.share_pct"), F.lit("% of output in "), plural(c("top_project.sessions"), "session"))).otherwise("More sessions will show one."),
        ),
        (
            F.when(big, "Biggest session").otherwise("Peak day"),
            F.when(big, tokens_label(c("biggest_session.total_tokens"))).otherwise(currency(F.coalesce(c("peak_cost"), F.lit(0.0)))),
            F.when(big, session_note(c("biggest_session.project_name"), c("biggest_session.timestamp_start"), c("biggest_session.first_prompt"))).when(c("peak_day").isNotNull(), F.concat(c("peak_day"), F.lit(" cost the most."))).otherwise("Too little history for a peak day."),
        ),
        (
            F.when(aide, "Subagent cameo").otherwise("Rhythm"),
            F.when(aide, tokens_label(c("biggest_subagent.total_tokens"))).otherwise(momentum(c("longest_streak"), c("average"))),
            F.when(aide, F.concat(F.coalesce(c("biggest_subagent.project_name"), F.lit("A project")), F.lit(" had help. "), preview(F.coalesce(c("biggest_subagent.first_prompt"), F.lit("")), 92))).otherwise(momentum_note(c("longest_streak"), c("average"))),
        ),
        (F.lit("Next season"), F.coalesce(c("next_move.title"), F.lit("Nothing obvious to fix")), F.coalesce(c("next_move.action"), F.lit("Clean sessions and a warm cache will do."))),
    )
    return F.array(*(F.struct(a.alias("eyebrow"), b.alias("title"), d.alias("note")) for a, b, d in rows))
