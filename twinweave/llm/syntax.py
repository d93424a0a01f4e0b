"""Source files that do not parse, and how many there are per repository and language.

Each file is lexed whole and its tokens are fed to a generalised LR parser of the
language that its extension claims; the tables come from the bundled grammars
(package ``parse``). What a parser has seen once, a line after a set of
stacks, it remembers, in a memory of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.llm.parse.check import EXTENSIONS, check_source, extension
from twinweave.session import spread

VERDICTS = "file_idx bigint, claimed string, valid boolean, error_line int, error_token string"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids, claimed, verdicts = [], [], []
            for i, path, text in zip(*(c.to_pylist() for c in part.columns)):
                v = check_source(path, text)
                if v is not None:
                    ids.append(i)
                    claimed.append(EXTENSIONS[extension(path)].replace("cpp_or_c", "c"))
                    verdicts.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(claimed, pa.string()), pa.array([v.valid for v in verdicts], pa.bool_()), pa.array([v.line for v in verdicts], pa.int32()), pa.array([v.token for v in verdicts], pa.string())],
                ["file_idx", "claimed", "valid", "error_line", "error_token"],
            )


def checked_files(source_files: DataFrame) -> DataFrame:
    """(file_idx, claimed, valid, error_line, error_token) of every file of a known extension, letter case ignored.

    claimed is the language by the extension. Files with a null content or
    path and files of other extensions have no row; empty and blank files are
    valid. error_line is the line, from 1, of the first token that no parse can take, and
    error_token that token; both are null for valid files. Repeated rows stay repeated; other columns aren't read.
    """
    return spread(source_files.select("file_idx", "path", "content"), "file_idx").mapInArrow(_checked, VERDICTS)


def repository(path: str) -> F.Column:
    """The first component of a path; empty if the path is null."""
    return F.coalesce(F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")[0], F.lit(""))


def invalid_rates(source_files: DataFrame, ast_hashes: DataFrame) -> DataFrame:
    """(repo, claimed, n_files, n_invalid, rate, n_witnessed): files that don't parse, per repository and language.

    n_witnessed counts the invalid files for which the tolerant tree parser reported an ERROR or MISSING node; it
    covers few languages and isn't always right, so it decides nothing.
    """
    checked = checked_files(source_files)
    repo = source_files.select("file_idx", repository("path").alias("repo"))
    witness = ast_hashes.where(F.col("node_kind").isin("ERROR", "MISSING")).select("file_idx", F.lit(1).alias("w")).distinct()
    one = checked.join(repo, "file_idx").join(witness, "file_idx", "left")
    return one.groupBy("repo", "claimed").agg(
        F.count(F.lit(1)).alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid"), (F.count_if(~F.col("valid")) / F.count(F.lit(1))).alias("rate"), F.count_if(~F.col("valid") & F.col("w").isNotNull()).alias("n_witnessed")
    )
