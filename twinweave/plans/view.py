"""Queries over a scan's clone pairs, as an interactive view asks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Pages, and the extensions that the view's languages stand for (a star: any extension that begins so).
PAGE_SIZE = 25
VIEW_EXTENSIONS = {"Rust": "rs", "TypeScript": "ts*", "JavaScript": "js*", "Python": "py", "Go": "go", "Java": "java", "CSS": "css"}


def extension(path: str) -> Column:
    return F.element_at(F.split(F.col(path), r"\."), -1)


def view_clone_pairs(pairs: DataFrame, search: str = "", language: str = "all", min_similarity: float = 0.0) -> DataFrame:
    """The pairs of a least similarity in percent, whose paths hold the search text, of which either file is of the language.

    Null paths match no search but the empty one. A language that the view doesn't know has no pairs.
    """
    out = pairs.where(F.col("similarity") * 100 >= min_similarity)
    term = search.strip().lower()
    if term:
        out = out.where(F.lower("file_a").contains(term) | F.lower("file_b").contains(term))
    if language != "all":
        e = VIEW_EXTENSIONS.get(language)
        if e is None:
            return out.where(F.lit(False))
        hit = lambda p: extension(p).startswith(e[:-1]) if e.endswith("*") else extension(p) == e
        out = out.where(F.coalesce(hit("file_a"), F.lit(False)) | F.coalesce(hit("file_b"), F.lit(False)))
    return out


def sorted_page(pairs: DataFrame, key: str = "similarity", page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page, counted from 1 (less is the first), of pairs by similarity, tokens or filename; row is the place in the whole view."""
    ties = [F.asc_nulls_last(c) for c in ("file_a", "file_b", "start_line_a", "start_line_b", "end_line_a", "end_line_b", "token_count", "fragment_hash")]
    keys = {"similarity": [F.desc("similarity")], "tokens": [F.desc_nulls_last("token_count")], "filename": []}[key]
    page = max(1, page)
    rows = pairs.orderBy(*keys, *ties).offset((page - 1) * size).limit(size)
    return rows.withColumn("row", F.row_number().over(Window.orderBy(*keys, *ties)) + (page - 1) * size)


def page_count(pairs: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row: the pairs and their pages, at least 1."""
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs")).withColumn("n_pages", F.greatest(F.ceil(F.col("n_pairs") / size), F.lit(1)).cast("bigint"))


def clamp_page(page: int, step: int, total: int) -> int:
    return max(1, min(total, page + step))


def path_parts(path: str) -> tuple[Column, Column]:
    """Directory, with its slash, and file name of a path; backslashes are read as slashes."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    name = F.substring_index(p, "/", -1)
    return F.left(p, F.length(p) - F.length(name)), name


def band(value: Column, high: float, middle: float) -> Column:
    """high, medium or low."""
    return F.when(value >= high, "high").when(value >= middle, "medium").otherwise("low")


def score_band(score: str) -> Column:
    return band(F.col(score), 80, 60)


def similarity_band(similarity: str) -> Column:
    return band(F.col(similarity) * 100, 95, 80)


def range_lines(start: str, end: str) -> Column:
    return F.col(end) - F.col(start) + 1


def parse_ignore_list(column: str) -> Column:
    """Patterns of a comma-separated text, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.col(column), ","), lambda x: F.trim(x)), lambda x: x != "")
