import json

import pytest
from pyspark.sql import functions as F

from ledgerweave import cli
from ledgerweave.operators import entries as en
from ledgerweave.operators import sessions as se
from ledgerweave.render import archive, card, html, markdown, terminal
from ledgerweave.sources import logs


def line(kind, ts, **more):
    return json.dumps({"type": kind, "isSidechain": False, "timestamp": ts, "userType": "external"} | more)


def said(ts, id_, model, tokens, tool=None, **more):
    usage = dict(zip(logs.COUNTS, tokens))
    content = [{"type": "tool_use", "name": tool}] if tool else []
    return line("assistant", ts, message={"id": id_, "model": model, "usage": usage, "content": content}, **more)


def put(root, path, *lines):
    file = root / path
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_bytes(b"\n".join(x if isinstance(x, bytes) else x.encode() for x in lines) + b"\n")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "projects"
    put(
        root,
        "-work-demo-app/session-1.jsonl",
        line("user", "2026-04-05T09:00:00Z", message={"content": "Please fix the <build> | now"}),
        line("user", "2026-04-05T09:01:00Z", message={"content": [{"type": "tool_result", "content": "ok"}]}),
        said("2026-04-05T17:00:00Z", "msg_1", "claude-opus-4-6", (1000, 1800, 500, 4000), "Bash", cwd="/work/demo-app"),
        said("2026-04-06T17:20:00Z", "msg_2", "claude-sonnet-4-6", (500, 600, 0, 700), "Read", cwd="/work/demo-app"),
    )
    put(
        root,
        "-work-demo-app/session-1/subagents/sub-1.jsonl",
        line("user", "2026-04-05T10:00:00Z", message={"content": "look around"}),
        said("2026-04-05T11:00:00Z", "msg_sub", "claude-sonnet-4-6", (300, 400, 0, 200), "Bash", cwd="/work/demo-app"),
    )
    return root


@pytest.fixture
def report(spark, tree):
    return cli.collect(spark, str(tree), 2026)[0]


def test_report(report):
    cost, cache, story, intel, routing = (report[k] for k in ("costAnalysis", "cacheHealth", "wrappedStory", "sessionIntel", "modelRouting"))
    assert [round(d["cost"], 9) for d in cost["dailyCosts"]] == [0.062085, 0.01071]
    assert cost["totalCost"] == pytest.approx(0.072795) and cost["medianDailyCost"] == pytest.approx(0.0363975)
    assert cost["peakDay"]["date"] == "2026-04-05"
    assert cost["modelCosts"] == pytest.approx({"Opus 4.6": 0.055125, "Sonnet 4.6": 0.01767})
    assert (routing["opusPct"], routing["sonnetPct"], routing["haikuPct"], routing["diversityScore"], routing["subagentPct"]) == (76, 24, 0, 60, 33)
    assert cache["cacheHitRate"] == 68.1 and cache["efficiencyRatio"] == 2
    assert cache["grade"]["letter"] == "B" and cache["grade"]["score"] == 72
    assert (cache["grade"]["signals"]["hitRate"], cache["grade"]["signals"]["trend"], cache["grade"]["signals"]["breaks"]) == (65, 70, 100)
    assert cache["estimatedBreaks"] == 0 and cache["reasonsRanked"] == [] and cache["savings"] == {"fromCaching": 0, "wastedFromBreaks": 0}
    (session,) = report["sessionBreakdown"]["sessions"]
    assert (session["durationMinutes"], session["totalTokens"], session["costUsd"]) == (1940, 9100, 0.0)
    assert session["modelTotals"]["claude-opus-4-6"]["outputTokens"] == 1800
    (aide,) = session["subagents"]
    assert (aide["sessionId"], aide["durationMinutes"], aide["totalTokens"], aide["parentSessionId"]) == ("sub-1", 60, 900, "session-1")
    assert intel["avgMessagesPerSession"] == 4 and intel["peakOverlapPct"] == 67 and len(intel["hourDistribution"]) == 24
    assert story["powerHour"] == {"hour": 17, "label": "5pm", "count": 2, "sharePct": 67}
    assert story["favoriteWeekday"] == {"label": "Sunday", "count": 2}
    assert story["longestStreak"] == 2 and story["averageMessagesPerActiveDay"] == 2
    assert story["archetype"]["title"] == "Precision Maximalist" and story["topTool"]["name"] == "Bash" and story["topProject"]["name"] == "demo-app"
    assert (story["promptRatio"]["human"], story["promptRatio"]["tool"], len(story["hero"]), len(story["highlights"])) == (1, 1, 5, 6)
    assert report["anomalies"]["anomalies"] == [] and report["anomalies"]["trend"] == "stable" and report["inflection"] is None
    assert len(report["recommendations"]) == 4 and report["recommendations"][0]["severity"] == "warning"


def test_renderers(report):
    page = html.render(report)
    assert page.count("<section>") == 13 and "&lt;build&gt;" in page and "<build>" not in page
    text = terminal.render(report, width=80)
    assert "demo-app" in text and "\033" not in text and "\033" in terminal.render(report, True)
    assert "| demo-app |" in markdown.render(report) and markdown.cell("a|b\nc") == "a\\|b c" and markdown.paragraph("## x\ny") == "x\ny"
    shared = card.render(report)
    assert "demo-app" not in shared and "Grade B" in shared and "5pm" in shared
    assert list(archive.render(report)) == ["demo-app.md"]


def test_archive_names():
    def session(hash_, name, *texts):
        return {"projectHash": hash_, "projectName": name, "prompts": [{"text": t, "timestamp": None, "entrypoint": None} for t in texts]}

    made = archive.render({"sessionBreakdown": {"sessions": [session("1", "a", "x" * 501), session("2", "a", "y"), session("3", "a-2", "z"), session("4", "!!", "w"), session("5", "none")]}})
    assert list(made) == ["a.md", "a-2.md", "a-2-2.md", "unknown.md"]
    assert "x" * 500 + "... [truncated]" in made["a.md"]


def test_cli(spark, tree, tmp_path, capsys):
    out = tmp_path / "out"
    out.mkdir()
    assert cli.main(["2026", "--input", str(tree), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["wrappedStory"]["promptRatio"]["humanPct"] == 50
    assert cli.main(["2026", "--input", str(tree), "--all", "--archive", "--plain", "--output", str(out)], spark) == 0
    assert sorted(p.name for p in out.iterdir()) == ["prompt-archive", "review-card.html", "review.html", "review.md"]
    assert "3 entries, 2 days, 1 sessions (2026)" in capsys.readouterr().out
    assert cli.main(["2020", "--input", str(tree), "--json"], spark) == 1
    assert json.loads(capsys.readouterr().out) == {"error": "no records found", "year": 2020}
    assert cli.main(["--input", str(tmp_path / "nowhere")], spark) == 1


def test_lines_that_are_no_records(spark, tmp_path):
    root = tmp_path / "p"
    good = said("2026-01-02T00:00:00Z", "a", "m", (1, 1, 1, 1))
    bad = [
        "{not json",
        "  {\"type\": 5}",
        '[{"type": "user"}]',
        '{"type": "user", "isSidechain": null}',
        '{"type": "user", "timestamp": 5}',
        '{"type": "user"} trailing',
        '{"type": "user", "type": "user"}',
        '{"type": "assistant", "message": {"usage": {"input_tokens": -5}}}',
        '{"type": "assistant", "message": {"usage": {"input_tokens": 1.5}}}',
        '{"type": "assistant", "message": "text"}',
    ]
    put(root, "one/a.jsonl", good, *bad, "", "   ", "plain words", '{"type": "other", "unknown": [1]}\r')
    put(root, "one/b.jsonl", b"\xff\xfe", good.encode())
    put(root, "top.jsonl", good)
    put(root, "one/c.txt", good)
    q = logs.quality(logs.parsed_lines(spark, str(root))).first()
    assert (q["files"], q["skipped_files"], q["lines"], q["skipped_lines"]) == (2, 1, 2, len(bad))


def test_texts_that_look_like_other_values(spark, tmp_path):
    root = tmp_path / "p"
    fields = ("type", "timestamp", "sessionId", "cwd", "entrypoint")
    texts = ["5", "-1.5e3", "true", "false", "{x", '{"a": 1}', "[1]", "NaN", "Infinity", "", "null", "2026", "5\n6"]
    values = [5, -1.5e3, True, False, {"a": 1}, [1], 0, 12345678901234567890]

    def lines(each):
        return [json.dumps(x) for v in each for x in (*({f: v} for f in fields), {"message": {"id": v}}, {"message": {"model": v}})]

    put(root, "one/texts.jsonl", *lines(texts), *lines([None]), *('{"cwd": "a"}' + end for end in ("\r", "\r\r")))
    put(root, "one/values.jsonl", *lines(values), *('{"isSidechain": %s}' % v for v in ("null", "5", '""', '"true"', "{}")), "\t\r", " \f\v")
    got = {r["name"]: (r["good"], r["bad"]) for r in logs.parsed_lines(spark, str(root)).groupBy(F.get("parts", 1).alias("name")).agg(F.count_if("ok").alias("good"), F.count_if("broken").alias("bad")).collect()}
    assert got == {"texts.jsonl": (7 * (len(texts) + 1) + 2, 0), "values.jsonl": (0, 7 * len(values) + 5)}


def test_a_line_is_read_and_parsed_once(spark, tree):
    parsed = logs.parsed_lines(spark, str(tree))
    for df in (en.daily(en.entries(logs.activity(parsed))), logs.quality(parsed)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") == plan.count("parseJson(") == plan.count("Relation [") == 1


def test_small_files_are_read_by_few_tasks_and_counted_by_number(spark, tmp_path):
    root = tmp_path / "p"
    for k in range(1000):
        put(root, f"proj-{k % 3}/s{k}.jsonl", line("user", "2026-01-01T00:00:00Z"), "{no")
    assert logs.files(spark, str(root)).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
    df = logs.quality(logs.parsed_lines(spark, str(root)))
    assert "distinct file_no" in df._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(df.first()) == (1000, 0, 1000, 1000)


def test_sample_holds_each_event_once_in_its_order(spark):
    """Also where a file's lines come in several batches."""
    from pathlib import Path

    from ledgerweave.sources import tables

    sf, key = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        root = Path(logs.write_sample(spark, sf).removeprefix("file://"))
    finally:
        spark.conf.set(key, before)
    want = {}
    for r in tables.activity(spark, sf).orderBy("ord").collect():
        user = int(r["file"].split("-")[0][1:])
        main = user - r["is_subagent"]
        want.setdefault(f"-work-proj--{main % 7}/user-{main}" + f"/subagents/user-{user}" * r["is_subagent"] + ".jsonl", []).append((r["type"], r["moment"].strftime("%Y-%m-%dT%H:%M:%SZ")))
    assert want.keys() == {str(p.relative_to(root)) for p in root.rglob("*.jsonl")}
    for p, records in want.items():
        summary, broken, blank, *rest = (root / p).read_text().splitlines()
        assert (summary, broken, blank) == ('{"type": "summary"}', "{not json", "") and [(x["type"], x["timestamp"]) for x in map(json.loads, rest)] == records


def test_both_passes_keep_their_own_rules(spark, tmp_path):
    root = tmp_path / "p"
    no_usage = line("assistant", "2026-01-02T00:00:00Z", message={"id": "x"})
    dup = said("2026-01-02T00:01:00Z", "x", "m", (5, 0, 0, 0), costUSD=2.0)
    put(root, "proj/s1.jsonl", no_usage, dup, said("2025-12-31T23:30:00-05:00", "y", "m", (7, 0, 0, 0)), said("2026-01-03T00:00:00Z", None, "m", (1, 0, 0, 0)), said("2026-01-03T00:00:00Z", None, "m", (1, 0, 0, 0)))
    put(root, "proj/s1/subagents/deep/er/z.jsonl", said("2026-01-02T09:00:00Z", "x", "m", (100, 0, 0, 0)))
    put(root, "proj/s1/else/w.jsonl", said("2026-01-02T09:00:00Z", "w", "m", (1000, 0, 0, 0)))
    act = logs.read(spark, str(root)).cache()
    flat = en.entries(act, 2026)
    # the subagent's file is scanned before its parent's and claims the id; 2025 is a year of its own, by the written offset
    assert sorted(r["input_tokens"] for r in flat.collect()) == [1, 1, 100, 1000]
    (session,) = se.sessions(se.files(se.in_year(act, 2026))).collect()
    # within the file the row without usage has claimed the id, and with it the cost
    assert (session["total_tokens"], session["cost_units"]) == (2, 0)
    (aide,) = se.subagents(se.files(se.in_year(act, 2026))).collect()
    assert aide["total_tokens"] == 100 and aide["parent_session_id"] == "s1"
    act.unpersist()


def test_prompts(spark, tmp_path):
    root = tmp_path / "p"
    mixed = [{"type": "tool_result", "content": "no"}, "first", {"type": "text", "text": " second "}, {"type": "x", "content": "third"}, {"text": 5, "content": "fourth"}, {"text": " ", "content": "not this"}, 7]
    put(
        root,
        "proj/s.jsonl",
        line("user", "2026-01-01T00:00:00Z", message={"content": mixed}, entrypoint="cli"),
        line("user", "2026-01-01T00:00:00Z", message={"content": []}),
        line("user", "2026-01-01T00:00:00Z", message={"content": "  "}),
        line("user", "2026-01-01T00:00:00Z", message={"content": "side"}) .replace("false", "true"),
        line("user", "2026-01-01T00:00:00Z", message={"content": [{"type": "tool_result"}, {"type": "tool_result"}]}).replace("false", "true"),
        line("user", "2026-01-01T00:00:00Z"),
        *(line("user", "2026-01-01T00:00:00Z", message={"content": f"p{i}"}) for i in range(6)),
        said("2026-01-01T00:00:00Z", "a", "m", (1, 0, 0, 0)),
    )
    act = logs.read(spark, str(root))
    (s,) = se.sessions(se.files(act)).collect()
    assert (s["prompt_count"], s["tool_message_count"], s["first_prompt"]) == (7, 1, "first\n second \nthird\nfourth")
    assert [r["text"] for r in se.prompts(act).orderBy("n").collect()][1:] == ["p0", "p1", "p2", "p3"]


def test_first_and_last_seen_and_names(spark, tmp_path):
    root = tmp_path / "p"
    put(root, "-home-user/top-1.jsonl", said("2026-01-01T00:00:00.9Z", "a", "m", (1, 10, 0, 0), cwd="/home/user", sessionId="other"), said("2026-01-01T01:00:00+01:00", "b", "m", (1, 0, 0, 0), cwd="/home/user"), said("bad time", "c", "m", (1, 0, 0, 0)))
    put(root, "-home-user/top-1/subagents/sub-1.jsonl", said("2026-01-01T00:00:00Z", "d", "m", (1, 20, 0, 0), cwd="/home/user"))
    act = logs.read(spark, str(root))
    (p,) = en.projects(en.entries(act)).collect()
    assert (p["name"], p["path"], p["subagent_sessions"], p["output_tokens"]) == ("workspace root", "/home/user", 1, 30)
    assert p["sessions"] == 2 and p["first_seen"] == "2026-01-01T00:00:00Z"
    assert [r["name"] for r in en.ranked_projects(en.projects(en.entries(act))).collect()] == ["workspace root"]


def test_follow(spark, tree, tmp_path):
    from ledgerweave.streaming.follow import follow

    out = str(tmp_path / "days")
    follow(spark, str(tree), out, str(tmp_path / "state"), 2026).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("messages")).first()[0] == 3
