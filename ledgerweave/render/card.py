"""A card to share: five figures and no names of projects."""

from __future__ import annotations

from ledgerweave.render import helpers as h

CSS = "body{margin:0;display:grid;place-items:center;min-height:100vh;background:#14161b;font:16px system-ui,sans-serif;color:#e8e6e1}main{width:420px;padding:32px;border:1px solid #39404c;border-radius:14px}dl{display:grid;grid-template-columns:1fr auto;gap:10px}dd{margin:0;font-weight:700}"


def render(report: dict) -> str:
    story, cost = report["wrappedStory"], report["costAnalysis"]
    figures = (
        ("Spend", h.currency(cost["totalCost"])),
        ("Messages", h.grouped(story["totalMessages"]) if story["totalMessages"] else "-"),
        ("Typed by people", f"{story['promptRatio']['humanPct']}%"),
        ("Cache", f"Grade {report['cacheHealth']['grade']['letter']}"),
        ("Power hour", story["powerHour"]["label"] if story["powerHour"] else "Unknown"),
    )
    rows = "".join(f"<dt>{h.html(a)}</dt><dd>{h.html(b)}</dd>" for a, b in figures)
    return f'<!doctype html><html lang="en"><head><meta charset="utf-8"><title>{report["year"]}</title><style>{CSS}</style></head><body><main><h1>{h.html(story["archetype"]["title"])}</h1><p>{report["year"]} · {cost["activeDays"]} active days</p><dl>{rows}</dl></main></body></html>'
