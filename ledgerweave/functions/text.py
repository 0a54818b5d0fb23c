"""Text: names, slugs, previews and numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PREVIEW = "No prompt preview available."
SPACES = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def currency(v: Column) -> Column:
    return F.when(v >= 1000, F.concat(F.lit("$"), grouped(F.round(v)))).when(v >= 100, F.concat(F.lit("$"), F.replace(F.format_number(v, 0), F.lit(","), F.lit("")))).otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))


def ratio_label(n: Column) -> Column:
    return F.when(n == 0, "N/A").otherwise(F.concat(grouped(n), F.lit(":1")))


def rounded_ratio(a: Column, b: Column) -> Column:
    """a / b to the nearest whole number, halves away from zero; 0 if b is 0."""
    return F.when(b == 0, 0).otherwise(F.round(F.try_divide(a.cast("double"), b.cast("double")))).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, rounded to a whole number; 0 of nothing."""
    return F.when(whole > 0, F.round(F.try_divide(part.cast("double"), whole.cast("double")) * 100)).otherwise(0).cast("long")


def tokens_label(n: Column) -> Column:
    def scaled(unit: float, mark: str) -> Column:
        return F.concat(F.replace(F.format_number(n / F.lit(unit), 1), F.lit(","), F.lit("")), F.lit(mark))

    return F.when(n >= 10**9, scaled(1e9, "B")).when(n >= 10**6, scaled(1e6, "M")).when(n >= 1000, scaled(1e3, "K")).otherwise(n.cast("string"))


def preview(text: Column, most: int) -> Column:
    """Text with single spaces, cut to `most` characters; a fixed phrase if it's blank."""
    clean = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(clean == "", NO_PREVIEW).when(F.char_length(clean) <= most, clean).otherwise(F.concat(F.rtrim(F.left(clean, F.lit(max(0, most - 1)))), F.lit("…")))


def html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def slug(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def project_name(path: Column) -> Column:
    """Last part of a path; a home directory is the workspace root."""
    trimmed = F.rtrim(path, F.lit("/"))
    parts = F.filter(F.split(trimmed, "/"), lambda x: x != "")
    home = (trimmed.startswith("/home/") | trimmed.startswith("/Users/")) & (F.size(parts) == 2)
    return F.when(path == "", "Unknown").when(home, "workspace root").otherwise(F.coalesce(F.try_element_at(parts, F.lit(-1)), path))


def decoded_path(hash_: Column) -> Column:
    """Path that a project hash stands for: "-" parts it, "--" is a hyphen; null for an empty or unknown hash."""

    def decoded(s: Column) -> Column:
        marked = F.replace(s, F.lit("--"), F.lit("\0"))
        return F.replace(F.replace(marked, F.lit("-"), F.lit("/")), F.lit("\0"), F.lit("-"))

    drive = hash_.rlike("^[A-Za-z]--")
    rest = F.when(hash_.startswith("-"), F.concat(F.lit("/"), decoded(F.substring(hash_, 2, 1 << 30)))).when(drive, F.concat(F.left(hash_, F.lit(1)), F.lit(":/"), decoded(F.substring(hash_, 4, 1 << 30)))).otherwise(decoded(hash_))
    return F.when((hash_ == "") | (hash_ == "unknown") | hash_.isNull(), None).otherwise(rest)


def decoded_name(hash_: Column) -> Column:
    return F.coalesce(project_name(decoded_path(hash_)), F.lit("Unknown"))
