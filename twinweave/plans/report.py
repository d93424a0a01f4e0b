"""Reports of a scan: console text, Markdown, HTML, JSON."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.functions.scalar import one_decimal
from twinweave.operators.pairs import in_order
from twinweave.plans.scan import Scan

#: Pairs that the console shows.
CONSOLE_PAIRS = 25


def _place(s: str) -> F.Column:
    return F.format_string("%s:%d-%d", f"file_{s}", f"start_line_{s}", f"end_line_{s}")


def markdown_lines(pairs: DataFrame) -> DataFrame:
    """(line) of a Markdown table of all pairs, in order when sorted by ``token_count`` as it is here."""
    row = F.format_string("| `%s` | `%s` | %d | %s%% |", _place("a"), _place("b"), "token_count", one_decimal(F.col("similarity") * 100))
    return in_order(pairs).select(row.alias("line"))


def json_lines(pairs: DataFrame) -> DataFrame:
    """(json) of each pair."""
    return pairs.select(F.to_json(F.struct(*pairs.columns), {"ignoreNullFields": "false"}).alias("json"))


def console(scan: Scan) -> str:
    """Seven figures and the first pairs."""
    m = scan.metrics.crossJoin(scan.total_files).first()
    out = [
        f"Scan ID:          {scan.scan_id}", f"Total files:      {m.total_files}", f"Total tokens:     {m.total_tokens}", f"Clone pairs:      {m.total_clones}",
        f"Duplication:      {m.duplication_percentage:.2f}%", f"DRY health score: {m.dry_health_score:.1f}/100", f"Min tokens:       {scan.config.min_tokens}",
    ]
    if not m.total_clones:
        return "\n".join([*out, "No duplication found."])
    for i, p in enumerate(in_order(scan.pairs).limit(CONSOLE_PAIRS).collect(), 1):
        out.append(f"{i:4d}. {p.file_a}:{p.start_line_a}-{p.end_line_a}  {p.file_b}:{p.start_line_b}-{p.end_line_b}  {p.token_count} tokens  {p.similarity * 100:.1f}%")
    if m.total_clones > CONSOLE_PAIRS:
        out.append(f"... and {m.total_clones - CONSOLE_PAIRS} more")
    return "\n".join(out)


def markdown(scan: Scan) -> str:
    """The whole report; for results that the driver can hold. Write markdown_lines() otherwise."""
    m = scan.metrics.crossJoin(scan.total_files).first()
    head = ["# Duplication report", "", f"- Files: {m.total_files}", f"- Tokens: {m.total_tokens}", f"- Clone pairs: {m.total_clones}", f"- Duplication: {m.duplication_percentage:.2f}%", f"- DRY health score: {m.dry_health_score:.1f}/100", ""]
    return "\n".join([*head, "| A | B | Tokens | Similarity |", "|---|---|---|---|", *(r.line for r in markdown_lines(scan.pairs).toLocalIterator())])


def html_report(scan: Scan) -> str:
    rows = "".join(f"<tr><td>{html.escape(p.file_a)}:{p.start_line_a}-{p.end_line_a}</td><td>{html.escape(p.file_b)}:{p.start_line_b}-{p.end_line_b}</td><td>{p.token_count}</td></tr>" for p in in_order(scan.pairs).toLocalIterator())
    m = scan.metrics.first()
    return f"<!doctype html><title>Duplication</title><h1>{m.duplication_percentage:.2f}% duplicated</h1><table><tr><th>A<th>B<th>Tokens</tr>{rows}</table>"


def json_document(scan: Scan) -> str:
    """The result as indented JSON."""
    return scan.result().select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json")).first().json


def exceeds(scan: Scan, threshold: float) -> bool:
    """Whether more than threshold per cent are duplicated."""
    return scan.metrics.first().duplication_percentage > threshold
