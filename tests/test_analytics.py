import pytest
from pyspark.sql import functions as F

from ledgerweave.functions.models import UNIT
from ledgerweave.operators import analytics as an
from ledgerweave.operators import entries as en
from ledgerweave.operators import rules, story

DAY = "dt string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost long, messages long, sessions long, cache_output_ratio long"


def days(spark, rows, cost=None):
    """rows: (input, output, creation, read) of consecutive days from 2026-01-01."""
    made = [(f"2026-01-{i + 1:02d}", *r, int((cost[i] if cost else 1) * UNIT), 1, 1, r[3] // r[1] if r[1] else 0) for i, r in enumerate(rows)]
    return spark.createDataFrame(made, DAY)


def test_cache_grades(spark):
    g = an.cache_grade(days(spark, [(50, 40, 0, 450), (50, 60, 0, 450)])).first()
    assert (g["hit_rate"], g["efficiency_ratio"], g["letter"]) == (90.0, 9, "A")
    g = an.cache_grade(days(spark, [(800, 100, 0, 200)])).first()
    assert (g["hit_rate"], g["letter"]) == (20.0, "D")


@pytest.mark.parametrize("read, score, letter", [(1500, 93, "A"), (1501, 64, "C"), (2000, 64, "C"), (2001, 49, "D")])
def test_grade_caps(spark, read, score, letter):
    g = an.cache_grade(days(spark, [(0, 1, 0, read)])).first()
    assert (g["score"], g["letter"]) == (score, letter)


def test_no_change_point_in_few_days(spark):
    assert an.inflections(days(spark, [(10, 10, 0, 10)] * 5)).count() == 0


def test_change_points(spark):
    (p,) = an.inflections(days(spark, [(1, 10, 0, 10)] * 4 + [(1, 10, 0, 30)] * 4)).collect()
    assert (p["dt"], p["direction"], p["before_days"], p["after_days"], p["multiplier"], p["is_primary"]) == ("2026-01-05", "worsened", 4, 4, 3.0, True)
    assert "3x" in p["summary"] and "Jan 5" in p["summary"]
    both = an.inflections(days(spark, [(1, 10, 0, 100)] * 5 + [(1, 10, 0, 30)] * 8 + [(1, 10, 0, 90)] * 5)).orderBy("direction").collect()
    assert [(r["direction"], r["is_primary"]) for r in both] == [("improved", False), ("worsened", True)]
    assert an.inflections(days(spark, [(1, 10, 0, 14)] * 5 + [(1, 10, 0, 10)] * 5)).count() == 0


def test_anomalies(spark):
    odd = an.anomalies(days(spark, [(1, 1, 1, 1)] * 12, [1.0] * 11 + [50.0])).collect()
    assert [(r["date"], r["anomaly_type"], r["severity"]) for r in odd] == [("2026-01-12", "spike", "critical")]
    assert an.anomalies(days(spark, [(1, 1, 1, 1)] * 12, [1.0] * 12)).count() == 0
    assert an.anomalies(days(spark, [(1, 1, 1, 1)] * 2, [1.0, 50.0])).count() == 0


@pytest.mark.parametrize("older, recent, trend", [(1, 2, "rising_fast"), (1, 1.3, "rising"), (1, 0.4, "dropping_fast"), (1, 0.7, "dropping"), (1, 1, "stable"), (0, 1, "stable")])
def test_cost_trend(spark, older, recent, trend):
    assert an.cost_trend(days(spark, [(1, 1, 1, 1)] * 10, [older] * 3 + [recent] * 7)).first()["trend"] == trend
    assert an.cost_trend(days(spark, [(1, 1, 1, 1)] * 7, [recent] * 7)).first()["trend"] == "stable"


def test_cache_trend(spark):
    for read, score in ((5, 100), (8, 85), (12, 70), (20, 40), (30, 10)):
        assert an.cache_trend(days(spark, [(1, 1, 0, 10)] * 3 + [(1, 1, 0, read)] * 7)).first()["trend_score"] == score
    assert an.cache_trend(days(spark, [(1, 1, 0, 10)] * 7)).first()["trend_score"] == 70


def test_median_and_percentile(spark):
    df = spark.createDataFrame([(float(i), i) for i in (3, 1, 2, 4)], "a double, b long")
    assert df.agg(an.median(F.col("a"))).first()[0] == 2.5 and df.where("a > 9").agg(an.median(F.col("a"))).first()[0] == 0.0
    assert an.index_percentiles(df, "b", p50=0.5, p90=0.9, p100=1.0).first()[:] == (3, 4, 4)
    assert an.index_percentiles(df.unionAll(df), "b", p50=0.5).first()[0] == 3 and an.index_percentiles(df.where("a > 9"), "b", p50=0.5).first()[0] == 0


def test_ties(spark):
    hours = spark.createDataFrame([(h, 5 if h in (3, 9) else 0) for h in range(24)], "hour long, n long")
    assert an.busiest_hour(hours).first()["hour"] == 9
    assert [r["hour"] for r in an.peak_hours(hours).orderBy("rank").collect()] == [3, 9, 0]
    assert an.busiest_hour(hours.withColumn("n", F.lit(0).cast("long"))).count() == 0
    assert an.top_tool(spark.createDataFrame([("a", 2), ("b", 2)], "name string, n long")).first()["name"] == "b"
    d = days(spark, [(1, 1, 1, 1)] * 2, [1.0, 1.0])
    assert an.cost_summary(d).first()["peak_day"] == "2026-01-02"
    s = spark.createDataFrame([("x", "px", 5, (0, ["a"]), 0), ("y", "py", 5, (0, ["b"]), 0)], "session_id string, project_name string, duration_minutes long, order struct<c:long,f:array<string>>, tool_message_count long")
    assert an.session_cost_stats(s).first()["longest_session_id"] == "y" and an.duration_stats(s).first()["longest_session_project"] == "px"


def test_streaks(spark):
    df = spark.createDataFrame([("2026-01-31",), ("2026-02-01",), ("2026-02-02",), ("2026-02-04",), ("bad",), ("2026-02-01",)], "dt string")
    assert an.streaks(df, []).first()[0] == 3
    assert an.streaks(df.where("dt = 'x'"), []).agg(F.coalesce(F.max("longest_streak"), F.lit(0))).first()[0] == 0


def test_routing(spark):
    costs = spark.createDataFrame([("Opus 4.6", int(4 * UNIT)), ("Sonnet 4.6", int(1 * UNIT))], "model string, cost long")
    said = spark.createDataFrame([(True,), (False,), (False,)], "is_subagent boolean")
    r = an.model_routing(costs, said).first()
    assert (r["opus_pct"], r["sonnet_pct"], r["haiku_pct"], r["subagent_pct"]) == (80, 20, 0, 33) and r["estimated_savings"] == pytest.approx(0.64)
    r = an.model_routing(costs.where("false"), said).first()
    assert (r["available"], r["opus_pct"], r["diversity_score"]) == (False, 0, 0)


@pytest.mark.parametrize("opus, light, average, title", [(75, 0, 0, "Precision Maximalist"), (74, 45, 0, "Delegation Director"), (0, 44, 120, "Flow-State Builder"), (0, 0, 0, "Balanced Operator")])
def test_archetypes(spark, opus, light, average, title):
    assert spark.range(1).select(story.archetype(F.lit(opus), F.lit(light), F.lit(average))).first()[0] == title


FACTS = "total_cost double, efficiency_ratio long, from_caching long, spikes long, spike_severity string, spike_cost double, spike_date string, direction string, multiplier double, change_date string, total_sessions long, avg_duration long, p90_duration long, peak_overlap_pct long, available boolean, opus_pct long, projects long, top_name string, top_share long"
QUIET = dict(total_cost=10.0, efficiency_ratio=0, from_caching=0, spikes=0, spike_severity=None, spike_cost=None, spike_date=None, direction=None, multiplier=None, change_date=None, total_sessions=0, avg_duration=0, p90_duration=0, peak_overlap_pct=0, available=False, opus_pct=0, projects=0, top_name=None, top_share=None)


def advice(spark, **more):
    row = spark.createDataFrame([tuple((QUIET | more).values())], FACTS)
    return rules.recommendations(row).orderBy("n").collect()


def test_rules(spark):
    assert [r["rule"] for r in advice(spark)] == ["no_dominant_inefficiency"]
    assert advice(spark, total_cost=0.0) == []
    worse = advice(spark, direction="worsened", multiplier=2.5, change_date="2026-01-05")
    assert "dropped 2.5x" in worse[0]["title"] and [r["rule"] for r in worse[1:]] == ["claudeignore", "scoped_prompts"]
    assert advice(spark, direction="worsened", multiplier=1.9)[0]["rule"] == "no_dominant_inefficiency"
    every = advice(spark, direction="improved", multiplier=2.0, change_date="d", available=True, opus_pct=81, total_sessions=1, avg_duration=61, efficiency_ratio=1501, spikes=2, spike_severity="critical", spike_cost=7.0, spike_date="d", projects=2, top_name="x", top_share=31, peak_overlap_pct=41, from_caching=101)
    assert len(every) == 10 and every[-1]["rule"] == "claudeignore" and every[0]["rule"] == "inflection_improved"
    assert [r["rule"] for r in advice(spark, efficiency_ratio=800)] == ["prompt_cache_idle_gaps", "claudeignore", "scoped_prompts"]
    assert advice(spark, efficiency_ratio=801)[0]["rule"] == "cache_ratio_elevated"


def test_empty_activity(spark):
    from ledgerweave.plans import report
    from ledgerweave.sources import tables

    empty = tables.activity(spark, "/root/testdata/sf0.001").where("false")
    r = report.report(empty, 2024).first()
    assert r["costAnalysis"]["totalCost"] == 0.0 and r["inflection"] is None and r["sessionIntel"]["available"] is False and r["recommendations"] == []


def test_sparkline_buckets(spark):
    rows = an.sparkline_buckets(days(spark, [(1, 1, 1, 1)] * 30, list(range(30))), 12).orderBy("bucket").collect()
    from ledgerweave.render.helpers import GLYPHS, sparkline

    assert "".join(GLYPHS[r["level"]] for r in rows) == sparkline([float(x) for x in range(30)], 12)


def test_daily_ignores_rows_without_date(spark):
    e = spark.createDataFrame([(None, "m", 1, 1, 1, 1, 5, "s")], "dt string, model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long, cost long, session_id string")
    assert en.daily(e).count() == 0
