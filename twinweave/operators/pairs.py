"""Clone pairs: fingerprints joined with themselves, neighbours merged, tokens counted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.operators import blocks
from twinweave.operators.lexer import counted_fingerprints, lex, parseable, parsed_files
from twinweave.operators.skew import fragment_replicate_join
from twinweave.session import cut, spread
from twinweave.sources.languages import language

#: Lines that may lie between two matches that are merged.
MAX_GAP = 3

#: Files that top_clone_pairs begins with, about, and the most that it names to the tasks before it takes all.
FEW, MOST = 64, 4096

COUNTS = ("before_a", "before_b", "upto_a", "upto_b")
RAW = ("file_a", "start_a", "end_a", "file_b", "start_b", "end_b", "h1", "h2")


def raw_pairs(fingerprints: DataFrame, scan_self: bool = True) -> DataFrame:
    """Every two places of one hash, the earlier (file_idx, pos) first.

    Columns: file_a, pos_a, start_a, end_a, file_b, ..., h1, h2. Without
    scan_self no two places of one file; never two of one file whose lines meet.
    Null hashes match nothing. The join is an equi-join on the hash with the rest as its
    condition; adaptive execution splits the partitions of frequent hashes. Nearly
    all hashes of normalised tokens of real code are rare; where the whole result
    is not wanted, use groups of copies instead. before and upto of
    lexer.counted_fingerprints, if there, are carried as before_a, upto_a and so on.
    """
    counts = [c for c in ("before", "upto") if c in fingerprints.columns]
    side = lambda s: fingerprints.select("h1", "h2", *[F.col(c).alias(f"{c}_{s}") for c in counts], F.col("file_idx").alias(f"file_{s}"), F.col("pos").alias(f"pos_{s}"), F.col("line_start").alias(f"start_{s}"), F.col("line_end").alias(f"end_{s}"))
    a, b = side("a"), side("b")
    same = F.col("file_a") == F.col("file_b")
    order = F.col("file_a") < F.col("file_b")
    if scan_self:
        apart = (F.col("start_a") > F.col("end_b")) | (F.col("start_b") > F.col("end_a"))
        order = order | (same & (F.col("pos_a") < F.col("pos_b")) & apart)
    return a.join(b, ["h1", "h2"]).where(order)


def _per_file(fingerprints: DataFrame) -> DataFrame:
    """(h1, h2, file_idx, n, apart): the places of a hash in a file, and how many pairs of them have lines that don't meet.

    Two places are apart if one ends before the other starts: a running count of ends, in the order of lines. So
    no pair is made; the places of one hash in one file, sorted, are the largest unit of work.
    """
    slim = fingerprints.where(F.col("h1").isNotNull() & F.col("h2").isNotNull())
    event = lambda line, end: F.struct(F.col(line).alias("line"), F.lit(int(end)).alias("ends"))
    events = slim.select("h1", "h2", "file_idx", F.explode(F.array(event("line_start", False), event("line_end", True))).alias("e")).select("h1", "h2", "file_idx", "e.*")
    # what starts on a line on which another ends isn't apart from it
    so_far = Window.partitionBy("h1", "h2", "file_idx").orderBy("line", "ends").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = events.withColumn("ended", F.sum("ends").over(so_far))
    return counted.groupBy("h1", "h2", "file_idx").agg(F.sum(1 - F.col("ends")).alias("n"), F.sum(F.when(F.col("ends") == 0, F.col("ended")).otherwise(0)).alias("apart"))


def clone_classes(fingerprints: DataFrame) -> DataFrame:
    """(h1, h2, n_places, n_files, n_links): a row per hash that stands at two places or more.

    n_links is the number of rows that raw_pairs would have for it, counted without making them, so that work and
    result grow with the places, not with their pairs. Null hashes have no row; repeated rows count as places; an
    empty table gives no rows.
    """
    return _classes(_per_file(fingerprints)).select("h1", "h2", "n_places", "n_files", "n_links")


def _classes(per_file: DataFrame) -> DataFrame:
    one = per_file.groupBy("h1", "h2").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_files"), F.sum("apart").alias("apart"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    links = F.expr("(n_places * n_places - squares) div 2 + apart")
    return one.where(F.col("n_places") > 1).withColumn("n_links", links)


def file_links(fingerprints: DataFrame) -> DataFrame:
    """(file_idx, n_places, n_shared, n_links): of each file its places, those whose hash stands in another file too, and the raw pairs it is in.

    Hashes that hold a large part of all rows are split (fragment_replicate_join). Rows with a null file or hash are left out.
    """
    per_file = cut(_per_file(fingerprints.where(F.col("file_idx").isNotNull())))
    classes = _classes(per_file).select("h1", "h2", "n_places", "n_files")
    joined = fragment_replicate_join(per_file, classes, ["h1", "h2"], "left")
    other = F.coalesce(F.col("n_places") - F.col("n"), F.lit(0))
    return joined.groupBy("file_idx").agg(F.sum("n").alias("n_places"), F.sum(F.when(F.col("n_files") > 1, F.col("n")).otherwise(0)).alias("n_shared"), F.sum(F.col("n") * other + F.col("apart")).alias("n_links"))


def raw_pairs_of(fingerprints: DataFrame, every: int, scan_self: bool = True) -> DataFrame:
    """The raw_pairs of which at least one file's number is divisible by ``every``: a search with these files against all.

    Frequent hashes are split by all rows' side, the searched files' places go to their shards.
    """
    counts = [c for c in ("before", "upto") if c in fingerprints.columns]
    of = ["file_idx", "pos", "line_start", "line_end", *counts]
    every_row = fingerprints.where(F.col("h1").isNotNull() & F.col("h2").isNotNull()).select("h1", "h2", *of)
    chosen = every_row.where(F.col("file_idx") % every == 0).select("h1", "h2", F.struct(*of).alias("q"))
    joined = fragment_replicate_join(every_row.select("h1", "h2", F.struct(*of).alias("p")), chosen, ["h1", "h2"])
    first = lambda x, y: (F.col(f"{x}.file_idx") < F.col(f"{y}.file_idx")) | (F.col(f"{x}.file_idx") == F.col(f"{y}.file_idx")) & (F.col(f"{x}.pos") < F.col(f"{y}.pos"))
    # a pair of two searched places is found from both; once is enough
    once = joined.where(first("q", "p") | first("p", "q") & (F.col("p.file_idx") % every != 0))
    side = lambda s, x: [x["file_idx"].alias(f"file_{s}"), x["pos"].alias(f"pos_{s}"), x["line_start"].alias(f"start_{s}"), x["line_end"].alias(f"end_{s}"), *[x[c].alias(f"{c}_{s}") for c in counts]]
    a, b = F.when(first("q", "p"), F.col("q")).otherwise(F.col("p")), F.when(first("q", "p"), F.col("p")).otherwise(F.col("q"))
    pairs = once.select("h1", "h2", a.alias("a"), b.alias("b")).select("h1", "h2", *side("a", F.col("a")), *side("b", F.col("b")))
    same = F.col("file_a") == F.col("file_b")
    return pairs.where(~same | ((F.col("start_a") > F.col("end_b")) | (F.col("start_b") > F.col("end_a")))) if scan_self else pairs.where(~same)


def _fold(batches: Iterator[pa.RecordBatch], gap: int, counted: bool = False) -> Iterator[pa.RecordBatch]:
    """Merge sorted raw pairs; only the open pair is held, however many a pair of files has."""
    cur: list | None = None
    done: list[tuple] = []
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 7]
    names = [*RAW, "n_raw", *COUNTS] if counted else [*RAW, "n_raw"]

    def flush() -> pa.RecordBatch:
        cols = list(zip(*done)) if done else [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
        done.clear()
        return batch

    for batch in batches:
        for fa, sa, ea, fb, sb, eb, h1, h2, *count in zip(*(c.to_pylist() for c in batch.columns)):
            if cur is not None and cur[0] == fa and cur[3] == fb and sa <= cur[2] + gap and sb <= cur[5] + gap:
                end_a, end_b = max(cur[2], ea), max(cur[5], eb)
                first_end, second_start = (end_a, cur[4]) if cur[1] <= cur[4] else (end_b, cur[1])
                if fa != fb or first_end < second_start:
                    cur[2], cur[5] = end_a, end_b
                    cur[8] += 1
                    if counted:  # ends and running counts ascend together
                        cur[11], cur[12] = max(cur[11], count[2]), max(cur[12], count[3])
                    continue
            if cur is not None:
                done.append(tuple(cur))
            cur = [fa, sa, ea, fb, sb, eb, h1, h2, 1, *count]
        if len(done) > 20_000:
            yield flush()
    if cur is not None:
        done.append(tuple(cur))
    yield flush()


def merged_pairs(pairs: DataFrame, gap: int = MAX_GAP) -> DataFrame:
    """Raw pairs of two files united in the order of their lines.

    A pair joins the one before it if it begins at most ``gap`` lines after it on
    both sides and, in one file, the two sides then still don't overlap. Ends are raised, starts
    never lowered; the hash is the first pair's. n_raw counts the pairs united. If the
    pairs carry running counts, tokens_a and tokens_b are the tokens wholly within each side's lines.
    """
    counted = all(c in pairs.columns for c in COUNTS)
    parts = pairs.select(*RAW, *(COUNTS if counted else ())).repartition("file_a", "file_b").sortWithinPartitions("file_a", "file_b", "start_a", "start_b", "end_a", "end_b", "h1", "h2")
    schema = "file_a bigint, start_a int, end_a int, file_b bigint, start_b int, end_b int, h1 bigint, h2 bigint, n_raw bigint"
    if not counted:
        return parts.mapInArrow(lambda it: _fold(it, gap), schema)
    folded = parts.mapInArrow(lambda it: _fold(it, gap, True), schema + "".join(f", {c} bigint" for c in COUNTS))
    tokens = [F.greatest(F.col(f"upto_{s}") - F.col(f"before_{s}"), F.lit(0)).alias(f"tokens_{s}") for s in "ab"]
    return folded.select(*RAW, "n_raw", *tokens)


def merged_in_blocks(source_files: DataFrame, fingerprints: DataFrame, gap: int = MAX_GAP) -> DataFrame:
    """merged_pairs(raw_pairs(fingerprints)), its raw pairs never made (see blocks); with tokens_a and tokens_b of counted fingerprints."""
    counted = "before" in fingerprints.columns
    return blocks.meet(fingerprints, source_files, blocks.kernel(gap, tokens=counted), blocks.MERGED + blocks.TOKENS * counted)


def line_counts(source_files: DataFrame, config: ScanConfig) -> DataFrame:
    """(file_idx, line, starts_before, ends_upto): of every line, the tokens that start before it and that end on it or before."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name, text in zip(*(c.to_pylist() for c in batch.columns)):
                _, tok, a, b, _ = lex(text, language(name), config.detect_type2)
                if not len(tok):
                    continue
                n = int(b.max())
                starts = np.cumsum(np.bincount(a, minlength=n + 1))
                ends = np.cumsum(np.bincount(b, minlength=n + 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(starts[:n]), pa.array(ends[1 : n + 1])], ["file_idx", "line", "starts_before", "ends_upto"])

    return spread(parseable(source_files, config), "file_idx").mapInArrow(count, "file_idx bigint, line int, starts_before bigint, ends_upto bigint")


def span_tokens(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """pairs with tokens_a and tokens_b: the tokens that lie wholly within the lines of each side.

    As lines of tokens ascend, that is a difference of two running counts: one
    equi-join of the four lines of each pair instead of a range join. Repeated pairs stay repeated.
    """
    cols = pairs.columns
    point = lambda s, end: F.struct(F.col(f"file_{s}").alias("file_idx"), F.col(f"{'end' if end else 'start'}_{s}").alias("line"), F.lit(s).alias("side"), F.lit(end).alias("upto"))
    points = pairs.select(*cols, F.explode(F.array(*[point(s, e) for s in "ab" for e in (False, True)])).alias("at")).select(*cols, "at.*")
    joined = points.join(counts.select("file_idx", "line", "starts_before", "ends_upto"), ["file_idx", "line"], "left")
    signed = F.when(F.col("upto"), F.col("ends_upto")).otherwise(-F.col("starts_before"))
    found = joined.groupBy(*cols).agg(*[F.sum(F.when(F.col("side") == s, signed)).alias(f"sum_{s}") for s in "ab"], (F.count(F.lit(1)) / 4).cast("int").alias("times"))
    within = [F.greatest(F.coalesce(F.col(f"sum_{s}") / F.col("times"), F.lit(0)), F.lit(0)).cast("bigint").alias(f"tokens_{s}") for s in "ab"]
    return found.select(*cols, *within, F.explode(F.sequence(F.lit(1), "times")).alias("__n")).drop("__n")


def fragment_hash(h1: str = "h1", h2: str = "h2") -> F.Column:
    """The two halves in lower-case hexadecimal, joined by a hyphen."""
    return F.concat(F.lower(F.hex(h1)), F.lit("-"), F.lower(F.hex(h2)))


def clone_pairs(source_files: DataFrame, fingerprints: DataFrame, config: ScanConfig = ScanConfig(), every: int = 1) -> DataFrame:
    """The result rows of a scan, of at least min_tokens tokens, one per six line numbers and files.

    With ``every``, only those of which one file's number is divisible by it (raw_pairs_of). fingerprints may be counted ones; others need a second pass over the files for the tokens of spans.
    Where names and literals are equal, and in a search, counted ones are matched in blocks; exact text has few raw pairs, which are joined.

    The count of a pair is the smaller of its sides', at least k. file_a and
    file_b are paths. The type is Exact; authors are null (see sources.git for them).
    """
    if "before" in fingerprints.columns and (config.detect_type2 or every > 1):
        found = blocks.kernel(MAX_GAP, every, config.scan_self, config.min_tokens, config.k, clones=True)
        return blocks.meet(fingerprints, source_files, found, blocks.CLONES, every, paths=True)
    counted = merged_pairs(raw_pairs(fingerprints, config.scan_self) if every == 1 else raw_pairs_of(fingerprints, every, config.scan_self))
    if "tokens_a" not in counted.columns:
        counted = span_tokens(counted, line_counts(source_files, config))
    tokens = F.greatest(F.lit(config.k), F.least("tokens_a", "tokens_b"))
    kept = counted.withColumn("token_count", tokens.cast("bigint")).where(F.col("token_count") >= config.min_tokens)
    six = ["file_a", "start_a", "end_a", "file_b", "start_b", "end_b"]
    one = kept.groupBy(*six).agg(F.min(F.struct("h1", "h2", "token_count")).alias("m"))
    path = lambda s: source_files.select(F.col("file_idx").alias(f"file_{s}"), F.col("path").alias(f"path_{s}"))
    named = one.join(path("a"), "file_a").join(path("b"), "file_b")
    return named.select(
        F.col("path_a").alias("file_a"), F.col("start_a").alias("start_line_a"), F.col("end_a").alias("end_line_a"), F.col("path_b").alias("file_b"), F.col("start_b").alias("start_line_b"), F.col("end_b").alias("end_line_b"),
        F.col("m.token_count").alias("token_count"), F.lit(1.0).alias("similarity"), fragment_hash("m.h1", "m.h2").alias("fragment_hash"), F.lit("Exact").alias("clone_type"), F.lit(None).cast("string").alias("author_a"), F.lit(None).cast("string").alias("author_b"),
    )


#: The order of clone pairs in reports; the first column descends.
ORDER = ("token_count", "file_a", "file_b", "start_line_a", "start_line_b", "end_line_a", "end_line_b")


def in_order(pairs: DataFrame) -> DataFrame:
    """Clone pairs in the order of reports: most tokens first, then by files and lines."""
    return pairs.orderBy(F.desc(ORDER[0]), *ORDER[1:])


def top_clone_pairs(source_files: DataFrame, config: ScanConfig = ScanConfig(), n: int = 25) -> DataFrame:
    """The first n of in_order(clone_pairs(...)), found among the files of most tokens where that is certain.

    A pair has no more tokens than the smaller of its files, and a text no more than characters; what two files
    have in common depends on no other file. So if n pairs of the files of t tokens or more have t tokens at least, no other pair
    can be among the first n. If not, t is lowered; at last all files are matched. Texts are lexed only if they have t characters.
    """
    tokens_of = lambda chars: parsed_files(source_files.where(F.length("content") >= chars), config).where(F.col("file_idx").isNotNull()).groupBy("file_idx").agg(F.max("token_count").alias("n"))
    few = FEW
    while few <= MOST:
        longest = parseable(source_files, config).select(F.length("content").alias("n")).orderBy(F.desc("n")).limit(8 * few).collect()
        largest = tokens_of(longest[-1].n).orderBy(F.desc("n")).limit(few).collect() if longest else []
        t = largest[-1].n if len(largest) == few else 0
        if t <= max(config.k, config.min_tokens):
            break
        ids = [r.file_idx for r in tokens_of(t).where(F.col("n") >= t).limit(MOST + 1).collect()]
        if len(ids) > MOST:
            break
        large = source_files.where(F.col("file_idx").isin(ids))
        found = clone_pairs(large, counted_fingerprints(large, config), config).where(F.col("token_count") >= t)
        top = cut(in_order(found).limit(n))
        if top.count() == n:
            return in_order(top)
        few *= 8
    return in_order(clone_pairs(source_files, counted_fingerprints(source_files, config), config)).limit(n)
