"""Models: readable names, tiers and prices. Prices are in units of 1e-8 dollars per token, so that sums of them are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 1e8
PRICES = {"haiku": (100, 500, 125, 10), "sonnet": (300, 1500, 375, 30), "opus": (500, 2500, 625, 50)}
TIERS = ("opus", "sonnet", "haiku", "other")


def _priced(model: Column, column: int) -> Column:
    low = F.lower(F.coalesce(model, F.lit("")))
    return F.when(low.contains("haiku"), PRICES["haiku"][column]).when(low.contains("sonnet"), PRICES["sonnet"][column]).otherwise(PRICES["opus"][column]).cast("long")


def input_price(model: Column) -> Column:
    return _priced(model, 0)


def output_price(model: Column) -> Column:
    return _priced(model, 1)


def write_price(model: Column) -> Column:
    return _priced(model, 2)


def read_price(model: Column) -> Column:
    return _priced(model, 3)


def priced_units(model: Column, tokens: tuple[str, str, str, str] = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")) -> Column:
    """What the tokens cost at list price."""
    return sum((F.col(t) * _priced(model, i) for i, t in enumerate(tokens)), F.lit(0).cast("long"))


def tier(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("opus"), "opus").when(low.contains("sonnet"), "sonnet").when(low.contains("haiku"), "haiku").otherwise("other")


def clean_name(model: Column) -> Column:
    """A model's name without vendor, date and hyphens: "Opus 4.6"."""
    s = F.btrim(model, F.lit(" \t\r\n"))
    for prefix in ("anthropic/", "claude/", "claude-"):
        s = F.regexp_replace(s, f"^{prefix}", "")
    s = F.btrim(F.regexp_replace(s, "-+", "-"), F.lit("-"))
    s = F.regexp_replace(s, r"^([^-]+-.*[^-]+|[^-]+-[^-]+)-[0-9]{8}$", "$1")
    known = s
    out = F.when(s == "", "Unknown")
    for t in ("opus", "sonnet", "haiku"):
        out = out.when(known.startswith(f"{t}-"), F.concat(F.lit(t.capitalize() + " "), F.replace(F.substring(known, len(t) + 2, 1 << 30), F.lit("-"), F.lit("."))))
    return out.otherwise(F.concat(F.upper(F.left(s, F.lit(1))), F.substring(s, 2, 1 << 30)))
