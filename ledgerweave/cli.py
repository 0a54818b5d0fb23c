"""Command line: the year's report from a tree of session logs."""

from __future__ import annotations

import argparse
import datetime
import json
import sys
import webbrowser
from pathlib import Path

from pyspark.sql import SparkSession

from ledgerweave.plans import report as plan
from ledgerweave.render import archive, card, html, markdown, terminal
from ledgerweave.sources import logs

NAMES = {"html": "review.html", "markdown": "review.md", "card": "review-card.html"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerweave", description=__doc__)
    p.add_argument("year", nargs="?", type=int, default=None)
    p.add_argument("--input", default=str(Path.home() / ".claude" / "projects"), help="root of the logs")
    p.add_argument("--timezone", default=None, help="time zone of the hours; the session's by default")
    p.add_argument("--output", default=".", help="folder for files")
    for flag, text in (("html", "write a page of slides"), ("markdown", "write Markdown"), ("card", "write a card to share"), ("archive", "write the first prompts of each project"), ("all", "write page, Markdown and card"), ("open", "show what was written in a browser"), ("json", "print JSON and nothing else"), ("plain", "no colours")):
        p.add_argument(f"--{flag}", action="store_true", help=text)
    return p


def collect(spark: SparkSession, root: str, year: int) -> tuple[dict | None, int]:
    """The report's row as a dictionary, and the number of entries; None without any."""
    relations = plan.Relations(logs.read(spark, root), year)
    try:
        n = relations.entries.count()
        if not n:
            return None, 0
        full = plan.report(relations.entries, year, relations)
        return full.first().asDict(recursive=True), n
    finally:
        relations.release()


def fail(as_json: bool, year: int, error: str, text: str) -> int:
    if as_json:
        print(json.dumps({"error": error, "year": year}))
    else:
        print(text, file=sys.stderr)
    return 1


def write_outputs(report: dict, args: argparse.Namespace, folder: Path) -> list[Path]:
    written = []
    for name, module in (("html", html), ("markdown", markdown), ("card", card)):
        if getattr(args, name) or args.all:
            path = folder / NAMES[name]
            path.write_text(module.render(report), encoding="utf-8")
            written.append(path)
            if args.open and name != "markdown":
                webbrowser.open(path.resolve().as_uri())
    if args.archive:
        n = archive.write(report, folder / "prompt-archive")
        print(f"  prompts of {n} project{'' if n == 1 else 's'} in {folder / 'prompt-archive'}")
    return written


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    year = args.year or datetime.datetime.now(datetime.timezone.utc).year
    if "://" not in args.input and not Path(args.input).is_dir():
        return fail(args.json, year, "input not found", f"There are no logs at {args.input}.")
    spark = spark or SparkSession.builder.appName("ledgerweave").getOrCreate()
    if args.timezone:
        spark.conf.set("spark.sql.session.timeZone", args.timezone)
    report, n = collect(spark, args.input, year)
    if report is None:
        return fail(args.json, year, "no records found", f"No assistant records of {year} at {args.input}.")
    if args.json:
        print(json.dumps(report, ensure_ascii=False, indent=2))
        return 0
    print(f"  {n} entries, {len(report['costAnalysis']['dailyCosts'])} days, {len(report['sessionBreakdown']['sessions'])} sessions ({year})")
    print(terminal.render(report, terminal.wants_colour(args.plain)))
    for path in write_outputs(report, args, Path(args.output)):
        print(f"  wrote {path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
