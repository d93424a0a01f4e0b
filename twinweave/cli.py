"""Command line: scan a directory and report."""

from __future__ import annotations

import argparse
import sys

from twinweave.config import DEFAULT_IGNORE, ScanConfig
from twinweave.plans import report
from twinweave.plans.scan import run, scan
from twinweave.session import local_session
from twinweave.sources.files import read_directory


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="twinweave", description="Find duplicated code.")
    p.add_argument("directory", nargs="?", default=".")
    p.add_argument("--min-tokens", type=int, default=50)
    p.add_argument("--format", choices=("console", "json", "markdown", "html"), default="console")
    p.add_argument("--fail-threshold", type=float)
    p.add_argument("--languages", action="append", default=[], help="names as in the registry; may be repeated or separated by commas")
    p.add_argument("--ignore", action="append", default=[], help="replaces the default patterns")
    p.add_argument("--exact", action="store_true", help="names and literals must be equal")
    p.add_argument("--no-self", action="store_true")
    p.add_argument("--git-blame", action="store_true", help="name the authors of both sides")
    p.add_argument("-o", "--output")
    return p.parse_args(argv)


def main(argv: list[str] | None = None, spark=None) -> int:
    """1 if more is duplicated than the threshold allows, else 0."""
    a = arguments(sys.argv[1:] if argv is None else argv)
    # a name that no language has keeps no file
    names = tuple(n.strip() for x in a.languages for n in x.split(",") if n.strip())
    config = ScanConfig(a.directory, a.min_tokens, names, tuple(a.ignore) or DEFAULT_IGNORE, not a.exact, not a.no_self, a.git_blame)
    spark = spark or local_session()
    said = (lambda name, share, text: print(f"[{name}] {int(share * 100)}% - {text}", file=sys.stderr)) if a.format == "console" else None
    done = run(scan(spark, read_directory(spark, a.directory), config), said)
    text = {"console": report.console, "json": report.json_document, "markdown": report.markdown, "html": report.html_report}[a.format](done)
    if a.output:
        with open(a.output, "w", encoding="utf-8") as f:
            f.write(text + "\n")
    else:
        print(text)
    return int(a.fail_threshold is not None and report.exceeds(done, a.fail_threshold))


if __name__ == "__main__":
    sys.exit(main())
