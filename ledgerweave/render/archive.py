"""A Markdown file with the first prompts of each project."""

from __future__ import annotations

from pathlib import Path

from ledgerweave.render.helpers import slug

KEEP, LONGEST = 5, 500


def render(report: dict) -> dict[str, str]:
    """Text by file name. Projects are told apart by their hash; a name that is taken gets the next free number."""
    by_hash: dict[str, tuple[str, list[dict]]] = {}
    for s in report["sessionBreakdown"]["sessions"]:
        by_hash.setdefault(s["projectHash"], (s["projectName"], []))[1].extend(s["prompts"])
    out: dict[str, str] = {}
    for _, (name, prompts) in sorted(by_hash.items()):
        if not prompts:
            continue
        base = slug(name) or "unknown"
        file, n = f"{base}.md", 1
        while file in out:
            n += 1
            file = f"{base}-{n}.md"
        lines = [f"# {name}", "", f"First prompts: {min(KEEP, len(prompts))}", ""]
        for p in prompts[:KEEP]:
            text = p["text"] if len(p["text"]) <= LONGEST else p["text"][:LONGEST] + "... [truncated]"
            lines += ["---", "", *([f"**{p['timestamp'][:10]}**", ""] if p["timestamp"] else []), text, ""]
        out[file] = "\n".join(lines)
    return out


def write(report: dict, folder: Path) -> int:
    folder.mkdir(parents=True, exist_ok=True)
    files = render(report)
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    return len(files)
