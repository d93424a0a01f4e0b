"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.llm import encode, groups, handwritten, mix, pii, spans, syntax
from twinweave.plans import oracles
from twinweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretches of each file that stand word for word in another one."""
    return spans.shared_spans(table(spark, sf_dir, "fingerprints")).select("file_idx", "line_start", "line_end")


def p1_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each file without the stretches that stand in another one."""
    return spans.without_shared(table(spark, sf_dir, "fingerprints"))


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each file stands elsewhere too."""
    return spans.shared_share(table(spark, sf_dir, "fingerprints"), table(spark, sf_dir, "parsed_files"))


def p1_share_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each file's fingerprints and tokens stands elsewhere too, tokens counted in the files."""
    return spans.counted_share(table(spark, sf_dir, "fingerprints"), table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand."""
    return handwritten.unwritten_files(table(spark, sf_dir, "source_files"))


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that remain: all but those of p2_found."""
    return handwritten.kept_files(table(spark, sf_dir, "source_files")).select("file_idx", "path")


def p2_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the classifiers do on repositories they haven't seen, against the weak labels."""
    return handwritten.held_out_accuracy(table(spark, sf_dir, "source_files"))


def p2_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the repository's ignore patterns hit a file, and whether it was found not to be hand-written."""
    files = table(spark, sf_dir, "source_files")
    found = handwritten.unwritten_files(files).distinct().withColumn("unwritten", F.lit(True))
    both = handwritten.ignored_by_pattern(files, table(spark, sf_dir, "scan_configs")).join(found, "file_idx", "left")
    return both.groupBy("ignored", F.coalesce("unwritten", F.lit(False)).alias("unwritten")).agg(F.count(F.lit(1)).alias("n_files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are not valid for the language of their extension."""
    return syntax.checked_files(table(spark, sf_dir, "source_files")).where(~F.col("valid")).select("file_idx")


def p4_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file that isn't valid, the line and token that no parse can take."""
    return syntax.checked_files(table(spark, sf_dir, "source_files")).where(~F.col("valid")).select("file_idx", "claimed", "error_line", "error_token")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate of invalid files per repository and language."""
    return syntax.invalid_rates(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "ast_hashes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every file in a link of clone_pairs."""
    return groups.file_groups(table(spark, sf_dir, "clone_pairs"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"])


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mix, in its order by end_token."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the mix that each source has reached."""
    return mix.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal details of every document."""
    return pii.personal_details(table(spark, sf_dir, "documents"))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders for personal details."""
    return pii.redacted(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_removed, p1_share, p1_share_counted, p2_found, p2_kept, p2_held_out, p2_ignored, p4_found, p4_errors, p4_rates, p5_found, p6_ids, p7_mix, p7_shares, p8_found, p8_redacted)}

_SPANS = """
        WITH d AS (SELECT file_idx, pos, min(row(h1 IS NULL, h1, h2 IS NULL, h2)) AS h, min(line_start) AS ls, min(line_end) AS le FROM fingerprints WHERE file_idx IS NOT NULL AND pos IS NOT NULL GROUP BY file_idx, pos),
        w AS (SELECT file_idx, pos, list(h) OVER f AS hs, bool_and(NOT h[1] AND NOT h[3]) OVER f AND max(pos) OVER f = pos + 7 AS ok FROM d WINDOW f AS (PARTITION BY file_idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
        s AS (SELECT hs FROM w WHERE ok GROUP BY hs HAVING count(DISTINCT file_idx) > 1),
        c AS (SELECT DISTINCT file_idx, unnest(range(pos, pos + 8)) AS pos FROM w SEMI JOIN s ON w.hs = s.hs WHERE ok),
        g AS (SELECT file_idx, pos, pos - row_number() OVER (PARTITION BY file_idx ORDER BY pos) AS isle FROM c),
        x AS (SELECT file_idx, min(pos) AS a, max(pos) AS b FROM g GROUP BY file_idx, isle)"""

SQL = {
    "p1_found": _SPANS + " SELECT x.file_idx, p.ls AS line_start, q.le AS line_end FROM x JOIN d p ON p.file_idx = x.file_idx AND p.pos = x.a JOIN d q ON q.file_idx = x.file_idx AND q.pos = x.b",
    "p1_removed": _SPANS + " SELECT d.file_idx, d.pos, d.h[2] AS h1, d.h[4] AS h2 FROM d LEFT JOIN c ON c.file_idx = d.file_idx AND c.pos = d.pos WHERE c.pos IS NULL",
    "p1_share": _SPANS + """, n AS (SELECT file_idx, count(*) AS n_fingerprints FROM d GROUP BY file_idx),
        k AS (SELECT file_idx, CAST(sum(b - a + 1) AS BIGINT) AS n_shared FROM x GROUP BY file_idx),
        t AS (SELECT file_idx, max(token_count) AS token_count FROM parsed_files GROUP BY file_idx)
        SELECT n.file_idx, n_fingerprints, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0) / n_fingerprints AS share, CAST(round(coalesce(n_shared, 0) / n_fingerprints * token_count) AS BIGINT) AS shared_tokens
        FROM n LEFT JOIN k ON k.file_idx = n.file_idx LEFT JOIN t ON t.file_idx = n.file_idx""",
    "p1_share_counted": _SPANS + f""", {oracles.ctes(ScanConfig(ignore_patterns=()))}, n AS (SELECT file_idx, count(*) AS n_fingerprints FROM d GROUP BY file_idx),
        k AS (SELECT file_idx, CAST(sum(b - a + 1) AS BIGINT) AS n_shared FROM x GROUP BY file_idx),
        l AS (SELECT DISTINCT x.file_idx, unnest(range(p.ls, q.le + 1)) AS line FROM x JOIN d p ON p.file_idx = x.file_idx AND p.pos = x.a JOIN d q ON q.file_idx = x.file_idx AND q.pos = x.b),
        i AS (SELECT t.file_idx, t.pos FROM tokens t JOIN l ON l.file_idx = t.file_idx AND l.line BETWEEN t.line_start AND t.line_end GROUP BY t.file_idx, t.pos, t.line_start, t.line_end HAVING count(*) = t.line_end - t.line_start + 1),
        t AS (SELECT f.file_idx, (SELECT count(*) FROM tokens t WHERE t.file_idx = f.file_idx) AS token_count, (SELECT count(*) FROM i WHERE i.file_idx = f.file_idx) AS shared_tokens FROM files f)
        SELECT n.file_idx, n_fingerprints, coalesce(n_shared, 0) AS n_shared, coalesce(n_shared, 0) / n_fingerprints AS share, token_count, shared_tokens, shared_tokens / nullif(token_count, 0) AS token_share
        FROM n LEFT JOIN k ON k.file_idx = n.file_idx LEFT JOIN t ON t.file_idx = n.file_idx""",
    "p5_found": r"""
        WITH RECURSIVE l AS (
            SELECT regexp_replace(replace(file_a, '\', '/'), '^\./', '') AS a, regexp_replace(replace(file_b, '\', '/'), '^\./', '') AS b
            FROM clone_pairs WHERE file_a IS NOT NULL AND file_b IS NOT NULL AND fragment_hash IS NOT NULL),
        e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
        r AS (SELECT a AS file_path, a AS other FROM e UNION SELECT r.file_path, e.b FROM r JOIN e ON e.a = r.other)
        SELECT file_path, min(other) AS group_path FROM r GROUP BY file_path""",
}
