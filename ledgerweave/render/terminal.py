"""The report in a terminal: nine sections in a fixed order."""

from __future__ import annotations

import os

from ledgerweave.render import helpers as h


def wants_colour(plain: bool) -> bool:
    return not plain and "NO_COLOR" not in os.environ


def render(report: dict, colour: bool = False, width: int | None = None) -> str:
    width = width or h.terminal_width()

    def paint(text: str, code: str) -> str:
        return f"\033[{code}m{text}\033[0m" if colour else text

    story, cost, cache = report["wrappedStory"], report["costAnalysis"], report["cacheHealth"]
    out: list[str] = ["", paint(f"{report['year']} in review", "1"), f"Grade {cache['grade']['letter']} · {story['archetype']['title']}", story["summary"], ""]
    out += [h.label_value(s["label"], f"{s['value']} ({s['note']})", width) for s in story["hero"]]

    days = cost["dailyCosts"]
    if days:
        out += ["", h.section("Activity", width), h.sparkline([d["cost"] for d in days], min(width - 4, len(days))), h.label_value(days[0]["date"][5:], days[-1]["date"][5:], min(width, max(len(days), 12)))]
        if cost["peakDay"]:
            out.append(f"Peak {cost['peakDay']['date']} at {h.currency(cost['peakDay']['cost'])}")

    out += ["", h.section("Cache", width)]
    for label, value in (("Grade", f"{cache['grade']['letter']} ({cache['grade']['label']}, {cache['grade']['score']})"), ("Hit rate", f"{cache['cacheHitRate']:.1f}%"), ("Reads per output token", h.ratio(cache["efficiencyRatio"])), ("Saved by caching", f"${h.grouped(cache['savings']['fromCaching'])}"), ("Overhead of breaks", f"${h.grouped(cache['savings']['wastedFromBreaks'])}")):
        out.append(h.label_value(label, value, width))

    out += ["", h.section("Models and projects", width)]
    whole = sum(cost["modelCosts"].values())
    for name, value in sorted(cost["modelCosts"].items()):
        pct = h.share(value, whole)
        out.append(f"{h.pad(name, 22)} {h.bar(pct, 20)} {pct:3d}% {h.currency(value)}")
    pool = h.ranked_projects(report["projectBreakdown"])[:8]
    top = max((p["outputTokens"] for p in pool), default=0)
    out += [f"{h.pad(p['name'], 22)} {h.bar(h.share(p['outputTokens'], top), 20)} {h.tokens(p['outputTokens'])}" for p in pool]

    sessions = report["sessionBreakdown"]
    out += ["", h.section("Sessions and subagents", width)]
    out += [f"{h.pad(s['projectName'], 22)} {h.tokens(s['totalTokens']):>8} {(s['timestampStart'] or '-')[:10]}" for s in sessions["sessions"][:6]]
    out += [f"  + {h.tokens(s['totalTokens']):>8} {h.preview(s['firstPrompt'], 60)}" for s in sessions["costlySubagents"][:5]]

    mix = story["promptRatio"]
    if mix["total"]:
        left, right = h.split_bar(mix["humanPct"], 30)
        out += ["", h.section("Human and tool", width), f"{paint(left, '36')}{paint(right, '35')} {mix['humanPct']}% human, {mix['human']} of {mix['total']}"]

    out += ["", h.section("Highlights", width)]
    out += [f"{x['eyebrow']}: {x['title']} — {x['note']}" for x in story["highlights"][:6]]
    if story["favoriteWeekday"]:
        out.append(f"Favourite day: {story['favoriteWeekday']['label']}")
    if story["topTool"]:
        out.append(f"Favourite tool: {story['topTool']['name']} ({h.grouped(story['topTool']['count'])})")
    if story["longestStreak"] > 1:
        out.append(f"Longest streak: {story['longestStreak']} days")
    if sessions["totalSubagentSessions"]:
        out.append(f"Subagent sessions: {h.grouped(sessions['totalSubagentSessions'])}")

    out += ["", h.section("Recommendations", width)]
    out += [paint(f"[{r['severity']}] {r['title']}", h.SEVERITY.get(r["severity"], "0")) + f"\n    {r['action']} ({r['savings']})" for r in report["recommendations"][:5]]
    if report["inflection"]:
        out += ["", h.section("Trend", width), report["inflection"]["summary"]]
    return "\n".join(out) + "\n"
