"""Rescans of what has changed, by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest(source_files: DataFrame) -> DataFrame:
    """(path, sha256) of every file with content."""
    return source_files.where(F.col("content").isNotNull()).select("path", F.sha2("content", 256).alias("sha256"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified, unchanged or deleted, of two manifests of unique paths."""
    o, n = old.select("path", F.col("sha256").alias("before")), new.select("path", F.col("sha256").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(F.col("before") == F.col("after"), "unchanged").otherwise("modified")
    return o.join(n, "path", "full").select("path", kind.alias("change"))


def changed_files(source_files: DataFrame, old: DataFrame) -> DataFrame:
    """The files whose path is new or whose content isn't what the manifest has: an anti-join on both."""
    hashed = source_files.withColumn("sha256", F.sha2("content", 256))
    return hashed.join(old.select("path", "sha256"), ["path", "sha256"], "left_anti")


def refreshed(kept: DataFrame, source_files: DataFrame, old: DataFrame, compute) -> DataFrame:
    """A per-file result (with file_idx) brought up to date: old rows of unchanged files, and compute() of the changed ones."""
    changed = changed_files(source_files, old)
    stays = source_files.select("file_idx").join(changed.select("file_idx"), "file_idx", "left_anti")
    return kept.join(stays, "file_idx", "left_semi").unionByName(compute(changed.drop("sha256")))


def exact_copies(source_files: DataFrame) -> DataFrame:
    """(sha256, n_files, first_path) of the contents that more than one file has."""
    return manifest(source_files).groupBy("sha256").agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path")).where("n_files > 1")
