"""The report as Markdown."""

from __future__ import annotations

from ledgerweave.render import helpers as h


def cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\r", "").replace("\n", " ")


def paragraph(text: str) -> str:
    return "\n".join(line.lstrip("#").lstrip() if line.startswith("#") else line for line in text.split("\n"))


def table(head: tuple[str, ...], rows: list[tuple]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *("| " + " | ".join(map(cell, r)) + " |" for r in rows), ""]


def render(report: dict) -> str:
    story, cost, cache, routing = report["wrappedStory"], report["costAnalysis"], report["cacheHealth"], report["modelRouting"]
    out = [f"# {report['year']} in review", "", f"> {paragraph(story['summary'])}", "", "## Summary", ""]
    out += [f"- Spend: {h.currency(cost['totalCost'])}", f"- Days at work: {cost['activeDays']}", f"- Cache: grade {cache['grade']['letter']}, {h.ratio(cache['efficiencyRatio'])}", ""]
    out += table(("Figure", "Value", "Note"), [(s["label"], s["value"], s["note"]) for s in story["hero"]])
    out += ["## Highlights", ""]
    for x in story["highlights"]:
        out += [f"**{cell(x['eyebrow'])}: {cell(x['title'])}**", "", paragraph(x["note"]), ""]
    if routing["available"]:
        tiers = [(name, f"{routing[key]}%") for name, key in (("Opus", "opusPct"), ("Sonnet", "sonnetPct"), ("Haiku", "haikuPct")) if routing[key]]
        out += ["## Models", "", *table(("Tier", "Share of spend"), tiers)]
    if report["projectBreakdown"]:
        out += ["## Projects", "", *table(("Name", "Output", "Sessions"), [(p["name"], h.tokens(p["outputTokens"]), p["sessionCount"]) for p in report["projectBreakdown"][:10]])]
    sessions = report["sessionBreakdown"]["sessions"][:5]
    if sessions:
        out += ["## Sessions", "", *table(("Project", "Tokens", "Day"), [(s["projectName"], h.tokens(s["totalTokens"]), (s["timestampStart"] or "-")[:10]) for s in sessions])]
    mix = story["promptRatio"]
    if mix["total"]:
        out += ["## Who typed", "", f"People: {mix['human']} ({mix['humanPct']}%). Tools: {mix['tool']}.", ""]
    if report["recommendations"]:
        out += ["## What to try", ""]
        for r in report["recommendations"][:3]:
            out += [f"**{cell(r['title'])}**", "", paragraph(r["action"]), ""]
    out += [f"Made on {report['generatedAt']}.", ""]
    return "\n".join(out)
