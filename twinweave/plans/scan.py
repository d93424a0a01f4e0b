"""A whole scan as one lazily composed plan."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.operators import lexer, metrics, pairs
from twinweave.session import cut
from twinweave.sources import git

Progress = Callable[[str, float, str], None]


class Cancelled(RuntimeError):
    """The scan was told to stop."""


@dataclass
class Scan:
    """The tables of a scan, lazy until run() has been over them; started is when it was composed, in seconds."""

    scan_id: str
    config: ScanConfig
    source_files: DataFrame
    parsed: DataFrame
    fingerprints: DataFrame
    pairs: DataFrame
    breakdown: DataFrame
    total_files: DataFrame
    metrics: DataFrame
    started: float = field(default_factory=time.time)

    def result(self) -> DataFrame:
        """The result as one row, with its pairs and languages nested; for results that fit one row."""
        pair = pairs.in_order(self.pairs)
        cols = self.pairs.columns
        # the order inside the array is that of the struct
        nested = pair.select(F.struct((-F.col("token_count")).alias("k"), *cols).alias("p")).agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(*[p[c].alias(c) for c in cols])).alias("clone_pairs"))
        langs = self.breakdown.agg(F.array_sort(F.collect_list(F.struct("language", "files", "tokens", "clones"))).alias("language_breakdown"))
        # asked for when the row is made, so after all it is made of
        took = F.reflect(F.lit("java.lang.System"), F.lit("currentTimeMillis")).cast("bigint") - F.lit(int(self.started * 1000))
        one = self.total_files.crossJoin(self.metrics).crossJoin(nested).crossJoin(langs)
        return one.select(
            F.lit(self.scan_id).alias("scan_id"), "total_files", "total_tokens", "total_clones", "duplication_percentage", "dry_health_score", "clone_pairs", took.alias("duration_ms"), "language_breakdown"
        )


def scan(spark: SparkSession, source_files: DataFrame, config: ScanConfig = ScanConfig(), progress: Progress | None = None, cancelled: Callable[[], bool] = lambda: False) -> Scan:
    """Compose a scan of a table with file_idx, path and content.

    With enable_git_blame, authors are those of the git work tree in the configuration's directory.
    total_files counts the files that match the configuration, with or without readable content;
    progress hears of each phase as its part of the plan is made. Raises Cancelled when told to.
    """

    def phase(name: str, share: float, message: str) -> None:
        if cancelled():
            raise Cancelled("Scan cancelled")
        if progress:
            progress(name, share, message)

    phase("Discovery", 0.0, "Discovering files")
    named = source_files.withColumn("content", F.coalesce("content", F.lit("")))
    total_files = lexer.parseable(named, config).agg(F.count(F.lit(1)).alias("total_files"))
    phase("Tokenization", 0.1, "Tokenizing files")
    parsed = lexer.parsed_files(source_files, config)
    prints = lexer.fingerprints(source_files, config)
    phase("Indexing", 0.5, "Matching fingerprints")
    found = pairs.clone_pairs(source_files, lexer.counted_fingerprints(source_files, config), config)
    if config.enable_git_blame:
        paths = found.select(F.explode(F.array("file_a", "file_b")).alias("path")).distinct()
        found = git.with_authors(found, git.line_authors(spark, config.directory, paths)).select(found.columns)
    phase("Merging", 0.8, "Merging matches")
    figures = metrics.duplication(found, parsed.agg(F.sum("token_count").alias("total_tokens")))
    out = Scan(str(uuid.uuid4()), config, source_files, parsed, prints, found, metrics.language_breakdown(parsed), total_files, figures)
    phase("Complete", 1.0, "Scan complete")
    return out


def run(scan: Scan, progress: Progress | None = None, cancelled: Callable[[], bool] = lambda: False) -> Scan:
    """The scan with its files, pairs and figures computed and kept, each once, whatever is asked of it afterwards.

    progress hears of each phase when its jobs are done; as soon as cancelled() is true the jobs under way are stopped and Cancelled is raised.
    """
    sc = scan.pairs.sparkSession.sparkContext
    group, over, stopped = f"scan {scan.scan_id}", threading.Event(), threading.Event()

    def watch() -> None:
        while not over.wait(0.1):
            if cancelled():
                stopped.set()
                sc.cancelJobGroup(group)

    def phase(name: str, share: float, message: str) -> None:
        if stopped.is_set() or cancelled():
            raise Cancelled("Scan cancelled")
        if progress:
            progress(name, share, message)

    before = {k: sc.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    sc.setJobGroup(group, "scan", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        phase("Discovery", 0.0, "Discovering files")
        total_files = cut(scan.total_files)
        phase("Tokenization", 0.1, f"Tokenizing {total_files.first()[0]} files")
        parsed = cut(scan.parsed)
        phase("Indexing", 0.5, "Matching fingerprints")
        found = cut(scan.pairs)
        phase("Merging", 0.8, f"Merged to {found.count()} pairs")
        figures = cut(metrics.duplication(found, parsed.agg(F.sum("token_count").alias("total_tokens"))))
        phase("Complete", 1.0, "Scan complete")
        return replace(scan, parsed=parsed, pairs=found, total_files=total_files, metrics=figures, breakdown=metrics.language_breakdown(parsed))
    except Cancelled:
        raise
    except Exception as e:
        if stopped.is_set():
            raise Cancelled("Scan cancelled") from e
        raise
    finally:
        over.set()
        watcher.join()
        for k, v in before.items():
            sc.setLocalProperty(k, v)
