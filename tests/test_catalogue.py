import pytest

from ledgerweave.plans import catalogue
from tests.compare import both, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    ours, theirs = both(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name], con)
    assert ours == theirs


def test_report_json_holds_what_the_queries_give(spark):
    """The sections of the report against the queries that have SQL of their own."""
    import json

    q = catalogue.queries()
    r = json.loads(q["report_json"](spark, SF).first()[0])
    days = {x["dt"]: x for x in q["daily_cost"](spark, SF).collect()}
    assert [d["date"] for d in r["costAnalysis"]["dailyCosts"]] == sorted(days)
    for d in r["costAnalysis"]["dailyCosts"]:
        assert d["cost"] == pytest.approx(days[d["date"]]["cost"]) and d["messageCount"] == days[d["date"]]["messages"] and d["sessionCount"] == days[d["date"]]["sessions"]
    assert r["cacheHealth"]["grade"]["letter"] == q["cache_grade"](spark, SF).first()["letter"]
    assert len(r["sessionBreakdown"]["sessions"]) == q["session_summary"](spark, SF).count()
    assert r["sessionBreakdown"]["totalSubagentSessions"] == q["session_subagents"](spark, SF).count()
    assert len(r["projectBreakdown"]) == q["project_summary"](spark, SF).count()
    advice = q["recommendations_of_even_use"](spark, SF).orderBy("n").collect()
    assert r["recommendations"] == [{c: x[c] for c in ("severity", "title", "savings", "action")} for x in advice]
    told = q["highlights"](spark, SF).orderBy("n").collect()
    assert r["wrappedStory"]["highlights"] == [{c: x[c] for c in ("eyebrow", "title", "note")} for x in told]
    assert r["sessionIntel"]["hourDistribution"] == [x["n"] for x in q["hour_histogram"](spark, SF).orderBy("hour").collect()]


def test_report_json_in_parts_is_the_same_text(spark):
    """No row of the report grows with the number of sessions, and the parts make the JSON of the report's row."""
    import re

    from pyspark.sql import functions as F

    from ledgerweave.plans import report
    from ledgerweave.sources import tables

    def undated(text):
        return re.sub('"generatedAt":"[^"]*"', "", text)

    act = tables.activity(spark, SF)
    for some in (act, act.where("false")):
        whole = report.report(some, 2024)
        text = undated(whole.select(F.to_json(F.struct(*whole.columns), {"ignoreNullFields": "false"})).first()[0])
        rows = sorted(report.report_json(some, 2024, part=50_000).collect(), key=lambda r: r["part"])
        assert [r["part"] for r in rows] == list(range(len(rows))) and undated("".join(r["json"] for r in rows)) == text
        assert all(len(r["json"]) <= 50_000 for r in rows[1:-1])
        assert len(rows) > 2 if len(text) > 200_000 else len(rows) == 1


def test_what_a_query_keeps_is_released_with_it(spark):
    import gc

    spark.catalog.clearCache()
    df = catalogue.queries()["recommendations"](spark, SF)
    assert df.count() > 0 and not spark.sparkContext._jsc.sc().getPersistentRDDs().isEmpty()
    del df
    gc.collect()
    assert spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_no_python_in_the_plans(spark):
    for name in ("daily_cost", "session_summary", "cache_grade", "inflection_point", "recommendations"):
        plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalogue.queries()["prompts_first5"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan
    plan = catalogue.queries()["longest_streak"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_entry():
    import __spark_entry__ as e

    assert set(catalogue.queries()) <= set(e.queries())


def test_jsonl_gives_the_same_messages_as_the_table(spark):
    by_table = {r["dt"]: r for r in catalogue.queries()["daily_cost"](spark, SF).collect()}
    by_log = {r["dt"]: r for r in catalogue.queries()["jsonl_daily_cost"](spark, SF).collect()}
    assert by_table.keys() == by_log.keys()
    # duplicates are resolved in scan order, which differs between the two sources, so that only all of them together agree by day or not
    assert sum(r["messages"] for r in by_table.values()) == sum(r["messages"] for r in by_log.values())
