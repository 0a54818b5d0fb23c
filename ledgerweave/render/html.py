"""The report as a page of thirteen slides; every text in it is escaped."""

from __future__ import annotations

from ledgerweave.render import helpers as h

CSS = """body{margin:0;font:17px/1.5 system-ui,sans-serif;background:#14161b;color:#e8e6e1}
section{min-height:90vh;padding:8vh 8vw;border-bottom:1px solid #2c3038;box-sizing:border-box}
h2{font-size:15px;letter-spacing:.08em;text-transform:uppercase;color:#93a1b5;font-weight:600}
.big{font-size:64px;font-weight:700;line-height:1.1}.note{color:#aab}.warn{color:#e0a36c}.good{color:#8fc9a3}
.row{display:flex;gap:16px;align-items:center;padding:6px 0}.row b{min-width:220px}.track{flex:1;height:8px;background:#2c3038}
.track i{display:block;height:8px;background:#6f9bd8}.bars{display:flex;align-items:flex-end;gap:3px;height:200px}.bars i{flex:1;background:#6f9bd8;min-height:1px}
.card{border:1px solid #2c3038;border-radius:8px;padding:16px 20px;margin:10px 0}"""


def slide(title: str, *parts: str) -> str:
    return f"<section><h2>{h.html(title)}</h2>{''.join(parts)}</section>"


def big(text: object, note: object = "") -> str:
    return f'<div class="big">{h.html(text)}</div><p class="note">{h.html(note)}</p>'


def row(name: object, pct: float, value: object) -> str:
    return f'<div class="row"><b>{h.html(name)}</b><span class="track"><i style="width:{min(100, max(0, int(pct)))}%"></i></span><span>{h.html(value)}</span></div>'


def card(title: object, *notes: object) -> str:
    return f'<div class="card"><strong>{h.html(title)}</strong>' + "".join(f"<p>{h.html(n)}</p>" for n in notes if n not in (None, "")) + "</div>"


def _session(s: dict, title: str) -> str:
    return card(f"{title}: {h.tokens(s['totalTokens'])} tokens", s["projectName"], (s["timestampStart"] or "-")[:10], h.preview(s["firstPrompt"], 120))


def render(report: dict) -> str:
    story, cost, cache = report["wrappedStory"], report["costAnalysis"], report["cacheHealth"]
    days, turn, mix = cost["dailyCosts"], report["inflection"], story["promptRatio"]
    hour, project, tool = story["powerHour"], story["topProject"], story["topTool"]
    top = max((d["cost"] for d in days), default=0)
    note = f'<p class="{"warn" if turn["direction"] == "worsened" else "good"}">{h.html(turn["summary"])}</p>' if turn else ""
    dear, long_ = story["biggestSessionByCost"], story["biggestSessionByTokens"]
    if dear and long_ and dear["sessionId"] != long_["sessionId"]:
        largest = _session(dear, "Dearest") + _session(long_, "Most tokens")
    else:
        largest = _session(dear or long_, "Biggest") if dear or long_ else big("None yet")
    whole = sum(cost["modelCosts"].values())
    pool = h.ranked_projects(report["projectBreakdown"])[:8]
    most = max((p["outputTokens"] for p in pool), default=0)
    breakdown = report["sessionBreakdown"]
    slides = [
        slide(f"{report['year']} in review", big(story["archetype"]["title"], story["summary"]), *(card(f"{s['label']}: {s['value']}", s["note"]) for s in story["hero"])),
        slide("Spend", big(h.cents(cost["totalCost"]), f"over {cost['activeDays']} days at work")),
        slide("Power hour", big(hour["label"], f"{hour['sharePct']}% of answers") if hour else big("–", "not enough times yet")),
        slide("Main project", big(project["name"], f"{project['sharePct']}% of output") if project else big("–", "no project leads yet")),
        slide("Cache", big(cache["grade"]["letter"], f"{cache['grade']['label']} · hit rate {cache['cacheHitRate']:.1f}% · {h.ratio(cache['efficiencyRatio'])} · saved ${h.grouped(cache['savings']['fromCaching'])}"), note),
        slide("Favourite tool", big(tool["name"], f"{h.grouped(tool['count'])} calls") if tool else big("–", "no tool calls yet")),
        slide("Biggest session", largest),
        slide("Activity", '<div class="bars">' + "".join(f'<i title="{h.html(d["date"])} {h.html(h.currency(d["cost"]))}" style="height:{h.share(d["cost"], top)}%"></i>' for d in days) + "</div>" if days else big("–", "no days yet")),
        slide("Models and projects", *(row(n, h.share(v, whole), h.currency(v)) for n, v in sorted(cost["modelCosts"].items())), *(row(p["name"], p["outputTokens"] * 100 // most if most else 0, h.tokens(p["outputTokens"])) for p in pool)),
        slide("Sessions", *(card(f"{s['projectName']}: {h.tokens(s['totalTokens'])}", h.preview(s["firstPrompt"], 80)) for s in breakdown["sessions"][:6]), *(card(f"Subagent: {h.tokens(s['totalTokens'])}", h.preview(s["firstPrompt"], 80)) for s in breakdown["costlySubagents"][:6])),
        slide("Prompts and savings", row("Human", mix["humanPct"], f"{mix['humanPct']}%"), row("Tool", 100 - mix["humanPct"], f"{100 - mix['humanPct']}%"), card(f"Caching saved ${h.grouped(cache['savings']['fromCaching'])}", f"Breaks cost ${h.grouped(cache['savings']['wastedFromBreaks'])}")),
        slide("Highlights", *(card(f"{x['eyebrow']}: {x['title']}", x["note"]) for x in story["highlights"])),
        slide("What to try", *(card(f"{r['title']} ({r['severity']})", r["action"], r["savings"]) for r in report["recommendations"][:6])),
    ]
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{report["year"]} in review</title><style>{CSS}</style></head><body>{"".join(slides)}</body></html>'
