"""Numbers and widgets for the renderers, which run on the driver over the report's one row."""

from __future__ import annotations

import math
import os
from html import escape

GLYPHS = "▁▂▃▄▅▆▇█"
FULL, EMPTY = "█", "░"
SEVERITY = {"critical": "31", "warning": "33", "positive": "32", "info": "36"}


def half_up(x: float) -> int:
    """To the nearest whole number, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def grouped(n: float) -> str:
    return f"{int(n):,}"


def currency(v: float) -> str:
    return f"${grouped(half_up(v))}" if v >= 1000 else f"${v:.0f}" if v >= 100 else f"${v:.2f}"


def cents(v: float) -> str:
    """Keeps the cents above a thousand, too."""
    if v < 1000:
        return f"${v:.2f}"
    whole, rest = divmod(half_up(v * 100), 100)
    return f"${grouped(whole)}.{rest:02d}"


def ratio(n: int) -> str:
    return f"{grouped(n)}:1" if n else "N/A"


def tokens(n: int) -> str:
    for unit, mark in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
        if n >= unit:
            return f"{n / unit:.1f}{mark}"
    return str(n)


def preview(text: str | None, most: int) -> str:
    clean = " ".join((text or "").split())
    if not clean:
        return "No prompt preview available."
    return clean if len(clean) <= most else clean[: most - 1].rstrip() + "…"


def html(text: object) -> str:
    return escape(str(text), quote=True).replace("&#x27;", "&#39;")


def slug(name: str) -> str:
    out = "".join(c if c.isascii() and c.isalnum() else "-" for c in name.lower())
    return "-".join(x for x in out.split("-") if x)


def share(part: float, whole: float) -> int:
    return half_up(part / whole * 100) if whole > 0 else 0


def sparkline(values: list[float], width: int) -> str:
    """One glyph for each value, or for the mean of each of `width` runs of values."""
    if not values or width <= 0:
        return ""
    if len(values) > width:
        size = len(values) / width
        runs = [values[int(i * size) : int((i + 1) * size)] for i in range(width)]
        values = [sum(r) / len(r) if r else 0.0 for r in runs]
    top = max(values)
    return "".join(GLYPHS[min(7, max(0, half_up(v / top * 7)))] if top > 0 else GLYPHS[0] for v in values)


def bar(pct: float, width: int) -> str:
    left, right = split_bar(pct, width)
    return left + right


def split_bar(pct: float, width: int) -> tuple[str, str]:
    """Both parts of a bar of which the first takes pct per cent."""
    if width <= 0:
        return "", ""
    n = half_up(min(100.0, max(0.0, pct)) / 100 * width)
    return FULL * n, EMPTY * (width - n)


def label_value(label: str, value: str, width: int) -> str:
    gap = width - len(label.encode()) - len(value.encode())
    return f"{label}{' ' * gap}{value}" if gap > 0 else f"{label}  {value}"


def section(title: str, width: int) -> str:
    return f"-- {title} {'-' * max(0, width - len(title) - 3)}".rstrip() if width <= len(title) + 3 else f"-- {title} {'-' * (width - len(title) - 3)}"


def pad(text: str, width: int) -> str:
    return text[:width].ljust(width)


def terminal_width() -> int:
    try:
        return max(40, int(os.environ.get("COLUMNS", "80")))
    except ValueError:
        return 80


def ranked_projects(projects: list[dict]) -> list[dict]:
    """By output; unnamed ones only if there are no others."""
    ordered = sorted(projects, key=lambda p: -p["outputTokens"])
    named = [p for p in ordered if p["name"] not in ("", "workspace root")]
    return named or ordered
