"""Queries of the skewed-key operator over fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.operators.skew import SkewPlan, balanced_group_stats, fragment_replicate_join, plan_skew
from twinweave.session import table

#: Share of all rows from which a hash counts as one of the few that hold most.
HOT_SHARE = 0.0018

_FP = ("file_idx", "h1", "h2", "line_start", "line_end")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes, both halves not null, that hold at least HOT_SHARE of all rows, repeated rows and rows with nulls included."""
    plan = plan_skew(table(spark, sf_dir, "fingerprints"), ["h1", "h2"])
    hot = _hash_stats(spark, sf_dir, plan).where(F.col("h1").isNotNull() & F.col("h2").isNotNull())
    # integers, so that the bound is met exactly, and multiplied in Python: Spark takes small ones for 32-bit, and their product then overflows from 119,304,648 rows on; the plan has counted all rows
    return hot.where(F.col("n_rows") * 10_000 >= F.lit(plan.total * round(HOT_SHARE * 10_000))).select("h1", "h2")


def _hash_stats(spark: SparkSession, sf_dir: str, plan: SkewPlan | None = None) -> DataFrame:
    fp = table(spark, sf_dir, "fingerprints").select(*_FP)
    return balanced_group_stats(fp, ["h1", "h2"], "file_idx", "line_start", "line_end", ("n_rows", "n_files", "first_line", "last_line"), plan)


def p3_hash_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct files and line extent of every hash."""
    return _hash_stats(spark, sf_dir)


def p3_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct hashes (both halves not null) and line extent of every file."""
    fp = table(spark, sf_dir, "fingerprints").select(*_FP)
    fp = fp.withColumn("hash", F.when(F.col("h1").isNotNull() & F.col("h2").isNotNull(), F.struct("h1", "h2")))
    return balanced_group_stats(fp, ["file_idx"], "hash", "line_start", "line_end", ("n_rows", "n_hashes", "first_line", "last_line"))


def p3_fragment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each file, how many of its fingerprints begin a fragment of clone_pairs, and the most tokens of such a fragment."""
    fp = table(spark, sf_dir, "fingerprints").select("file_idx", "h1", "h2", "pos")
    fp = fp.withColumn("fragment_hash", F.concat_ws("-", F.lower(F.hex("h1")), F.lower(F.hex("h2")))).where(F.col("h1").isNotNull() & F.col("h2").isNotNull())
    pairs = table(spark, sf_dir, "clone_pairs").groupBy("fragment_hash").agg(F.max("token_count").alias("tokens"))
    plan = plan_skew(fp.select("fragment_hash"), ["fragment_hash"])
    joined = fragment_replicate_join(fp, pairs, ["fragment_hash"], plan=plan)
    return joined.groupBy("file_idx").agg(F.count(F.lit(1)).alias("n_starts"), F.max("tokens").alias("max_tokens"))


QUERIES = {f.__name__: f for f in (p3_found, p3_hash_stats, p3_file_stats, p3_fragment_files)}

SQL = {
    "p3_found": "SELECT h1, h2 FROM fingerprints WHERE h1 IS NOT NULL AND h2 IS NOT NULL GROUP BY h1, h2 HAVING count(*) * 10000 >= 18 * (SELECT count(*) FROM fingerprints)",
    "p3_hash_stats": "SELECT h1, h2, count(*) AS n_rows, count(DISTINCT file_idx) AS n_files, min(line_start) AS first_line, max(line_end) AS last_line FROM fingerprints GROUP BY h1, h2",
    "p3_file_stats": "SELECT file_idx, count(*) AS n_rows, count(DISTINCT CASE WHEN h1 IS NOT NULL AND h2 IS NOT NULL THEN row(h1, h2) END) AS n_hashes, min(line_start) AS first_line, max(line_end) AS last_line FROM fingerprints GROUP BY file_idx",
    "p3_fragment_files": """
        WITH p AS (SELECT fragment_hash, max(token_count) AS tokens FROM clone_pairs GROUP BY fragment_hash)
        SELECT f.file_idx, count(*) AS n_starts, max(p.tokens) AS max_tokens
        FROM fingerprints f JOIN p ON p.fragment_hash = printf('%x-%x', f.h1, f.h2)
        WHERE f.h1 IS NOT NULL AND f.h2 IS NOT NULL GROUP BY f.file_idx""",
}
