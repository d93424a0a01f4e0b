"""Authors of lines, from git."""

from __future__ import annotations

import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def blame(directory: str, path: str) -> list[tuple[str, int, str, str]]:
    """(path, line, author, date) of every line of a file in a git work tree; nothing for files git doesn't know."""
    run = subprocess.run(["git", "-C", directory, "blame", "--line-porcelain", "--", path], capture_output=True, text=True, errors="replace")
    out, line, author, date = [], 0, "", ""
    if run.returncode:
        return out
    for x in run.stdout.split("\n"):
        if x.startswith("\t"):
            out.append((path, line, author, date))
        elif x.startswith("author "):
            author = x[7:]
        elif x.startswith("author-time "):
            date = datetime.fromtimestamp(int(x[12:]), UTC).strftime("%Y-%m-%d")
        elif len(p := x.split(" ")) >= 3 and len(p[0]) == 40:
            line = int(p[2])
    return out


def line_authors(spark: SparkSession, directory: str, paths: DataFrame) -> DataFrame:
    """(path, line, author, date) of the files of a table with a path column; each file is blamed where its row is."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [r for p in b["path"] for r in blame(directory, p)]
            yield pd.DataFrame(rows, columns=["path", "line", "author", "date"])

    return paths.select("path").mapInPandas(run, "path string, line int, author string, date string")


def with_authors(pairs: DataFrame, authors: DataFrame) -> DataFrame:
    """Clone pairs with author_a and author_b: who last changed the first line of each side."""
    for s in "ab":
        text = F.format_string("%s (line %d, %s)", "author", "line", "date")
        side = authors.select(F.col("path").alias(f"file_{s}"), F.col("line").alias(f"start_line_{s}"), text.alias(f"author_{s}"))
        pairs = pairs.drop(f"author_{s}").join(side, [f"file_{s}", f"start_line_{s}"], "left")
    return pairs
