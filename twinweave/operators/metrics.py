"""Figures over clone pairs: per language, duplication, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_of(path: str) -> Column:
    """The first component of a path."""
    return F.split(F.col(path), "/")[0]


def language_breakdown(parsed: DataFrame, pairs: DataFrame | None = None, source_files: DataFrame | None = None) -> DataFrame:
    """(language, files, tokens, clones) over the distinct parsed files.

    clones is 0, unless pairs and source_files are given: then the sides of clone pairs in files of the language.
    Null languages form a row; null token counts add nothing.
    """
    one = parsed.groupBy("file_idx").agg(F.max("language").alias("language"), F.max("token_count").alias("token_count"))
    out = one.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))
    if pairs is None or source_files is None:
        return out.withColumn("clones", F.lit(0).cast("bigint"))
    sides = pairs.select(F.explode(F.array("file_a", "file_b")).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    by = source_files.select("path", "file_idx").join(one.select("file_idx", "language"), "file_idx").join(sides, "path").groupBy("language").agg(F.sum("n").alias("clones"))
    return out.join(by, out["language"].eqNullSafe(by["language"]), "left").select(out["language"], "files", "tokens", F.coalesce("clones", F.lit(0)).alias("clones"))


def language_share(breakdown: DataFrame) -> DataFrame:
    """breakdown with the percentage of all tokens that each language has; 0 if there are none."""
    total = breakdown.agg(F.sum("tokens").alias("all_tokens"))
    return breakdown.crossJoin(F.broadcast(total)).select("language", "tokens", F.coalesce(F.col("tokens") / F.nullif("all_tokens", F.lit(0)) * 100, F.lit(0.0)).alias("share_pct"))


def duplication(pairs: DataFrame, total_tokens: DataFrame) -> DataFrame:
    """One row: total_clones, total_tokens, dup_tokens, cross_module_pairs, duplication_percentage, cross_module_ratio, dry_health_score.

    total_tokens has one column, total_tokens, and one row. Tokens of all pairs count, overlaps twice. No tokens: 0 %; no pairs: ratio 0 and score 100.
    """
    cross = (module_of("file_a") != module_of("file_b")).cast("int")
    p = pairs.agg(F.count(F.lit(1)).alias("total_clones"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("dup_tokens"), F.coalesce(F.sum(cross), F.lit(0)).alias("cross_module_pairs"))
    one = p.crossJoin(F.broadcast(total_tokens.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"))))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    pct = F.coalesce(clamp(F.col("dup_tokens") / F.nullif("total_tokens", F.lit(0)) * 100), F.lit(0.0))
    ratio = F.coalesce(F.col("cross_module_pairs") / F.nullif("total_clones", F.lit(0)), F.lit(0.0))
    out = one.withColumn("duplication_percentage", pct).withColumn("cross_module_ratio", ratio)
    # fixed values: weights of the score
    return out.withColumn("dry_health_score", clamp((100 - 1.5 * F.col("duplication_percentage")) * (1 - 0.25 * F.col("cross_module_ratio"))))
