"""From source text to normalised tokens, k-gram hashes and winnowed fingerprints.

All three depend on one file only, so they are one pass over the input's
partitions without any shuffle: Arrow batches in, Arrow batches out, NumPy in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.session import spread
from twinweave.sources.languages import Language, language, language_of

M61 = (1 << 61) - 1
# Bases of the two polynomial hashes, and codes of the token classes.
BASES = (313, 1000003)
IDENTIFIER, STRING, NUMBER, KEYWORD, PUNCTUATION = 1, 2, 3, 1000, 2000
#: Codes of texts, where the text of identifiers and literals counts.
TEXT = 4096

KINDS = ("identifier", "string", "number", "keyword", "punctuation")
TOKEN_SCHEMA = "file_idx bigint, pos int, kind string, tok bigint, line_start int, line_end int, byte_offset bigint"
HASH_SCHEMA = "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int, byte_offset bigint"


@lru_cache(maxsize=64)
def _lexemes(line_comment: str, block_comment: tuple[str, str] | None, ascii_only: bool):
    """A function that cuts a text into lexemes which cover it, white space and comments among them."""
    if ascii_only:
        import re as engine

        space, word = r"[\t-\r ]+", r"[A-Za-z_][A-Za-z0-9_]*"
    else:
        import regex as engine

        space, word = r"\p{White_Space}+", r"[\p{Alphabetic}_][\p{Alphabetic}\p{N}_]*"
    parts = [space]
    if line_comment:
        parts.append(engine.escape(line_comment) + r"[^\n]*")
    if block_comment:
        x, y = map(engine.escape, block_comment)
        parts.append(rf"{x}(?:(?!{y})[\s\S])*+(?:{y}|\Z)")
    parts += [rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+(?:{q}|\\?\Z)" for q in "\"'`"]
    return engine.compile("|".join([*parts, r"[0-9][0-9A-Za-z._]*", word, r"[\s\S]"])).findall


def text_code(lexeme: str) -> int:
    """TEXT and the first 48 bits of the text's MD5."""
    return TEXT + int.from_bytes(hashlib.md5(lexeme.encode("utf-8", "surrogatepass")).digest()[:6], "big")


_WORD_START = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_")


class _Codes(dict):
    """What a lexeme is: 8 * code + kind + 1, or 0 for white space and comments. Short lexemes are remembered, up to a bound."""

    LIMIT, SHORT = 200_000, 64

    def __init__(self, lang: Language, type2: bool) -> None:
        import regex

        self.lang, self.type2 = lang, type2
        # comment marks that begin like a word, as REM does
        self.lettered = any(m and m[0] in _WORD_START for m in (lang.line_comment, *(lang.block_comment or ())[:1]))
        self.ids: dict[str, int] = {}
        for i, k in enumerate(lang.keywords):
            self.ids.setdefault(k, i)
        self.space, self.letter = regex.compile(r"\p{White_Space}").match, regex.compile(r"[\p{Alphabetic}_]").match

    def __missing__(self, lexeme: str) -> int:
        lang, c, type2 = self.lang, lexeme[0], self.type2
        if c in _WORD_START and not self.lettered:
            k = self.ids.get(lexeme)
            out = 8 * (KEYWORD + k) + 4 if k is not None else 8 * (IDENTIFIER if type2 else text_code(lexeme)) + 1
        elif self.space(c) or lang.line_comment and lexeme.startswith(lang.line_comment) or lang.block_comment and lexeme.startswith(lang.block_comment[0]):
            out = 0
        elif c in "\"'`":
            out = 8 * (STRING if type2 else text_code(lexeme)) + 2
        elif c in "0123456789":
            out = 8 * (NUMBER if type2 else text_code(lexeme)) + 3
        elif self.letter(c):
            k = self.ids.get(lexeme)
            out = 8 * (KEYWORD + k) + 4 if k is not None else 8 * (IDENTIFIER if type2 else text_code(lexeme)) + 1
        else:
            out = 8 * (PUNCTUATION + (ord(c) & 255)) + 5
        if len(lexeme) <= self.SHORT:
            if len(self) >= self.LIMIT:
                self.clear()
            self[lexeme] = out
        return out


@lru_cache(maxsize=64)
def _codes(lang: Language, type2: bool) -> _Codes:
    return _Codes(lang, type2)


def lex(text: str, lang: Language, type2: bool = True) -> tuple[np.ndarray, ...]:
    """(kind, code, first line, last line, byte offset) of the tokens of a text."""
    ascii_only = text.isascii()
    lexemes = _lexemes(lang.line_comment, lang.block_comment, ascii_only)(text)
    n = len(lexemes)
    size = np.fromiter(map(len, lexemes), np.int64, n)
    packed = np.fromiter(map(_codes(lang, type2).__getitem__, lexemes), np.int64, n)
    end = np.cumsum(size)
    on = packed > 0
    packed, end = packed[on], end[on]
    start = end - size[on]
    chars = np.frombuffer(text.encode("ascii"), np.uint8) if ascii_only else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    breaks = np.concatenate([[0], np.cumsum(chars == 10, dtype=np.int32)])
    # only a string can hold a line break
    offset = start if ascii_only or not len(start) else _byte_offsets(text)[start]
    return ((packed & 7) - 1).astype(np.int8), packed >> 3, (breaks[start] + 1).astype(np.int32), (breaks[end] + 1).astype(np.int32), offset


def _byte_offsets(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
    return np.concatenate([[0], np.cumsum(size)])


def mod_m61(x: int) -> int:
    """x modulo 2**61 - 1."""
    return x % M61


@lru_cache(maxsize=64)
def _powers(k: int) -> np.ndarray:
    """The powers of both bases by which k codes are weighted, halved to 30 and 31 bits; codes are halved to 24, so no sum of up to 256 products overflows."""
    powers = [[pow(base, k - 1 - d, M61) for d in range(k)] for base in BASES]
    return np.array([[p[d] >> 31 for p in powers] + [p[d] & 0x7FFFFFFF for p in powers] for d in range(k)], np.int64)


def kgram_hashes(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The two polynomial hashes, modulo 2**61 - 1, of every k successive codes (below 2**49), in 64-bit arithmetic only."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m, table = np.int64(M61), _powers(k)

    def dot(part: np.ndarray) -> list[np.ndarray]:
        sums = (np.lib.stride_tricks.sliding_window_view(part, k) @ table).T
        return [((((sums[c] >> 30) + ((sums[c] & ((1 << 30) - 1)) << 31)) % m) + sums[c + 2]) % m for c in (0, 1)]

    high_part = codes >> 24
    low = dot(codes & 0xFFFFFF)
    if not high_part.any():
        return low[0], low[1]
    return tuple((((h >> 37) + ((h & ((1 << 37) - 1)) << 24)) + x) % m for h, x in zip(dot(high_part), low))


def winnow(h1: np.ndarray, h2: np.ndarray, w: int, standard: bool = False) -> np.ndarray:
    """Positions of the k-grams kept: the least of each window of w, the rightmost of equal ones.

    Fewer than w k-grams have one window. The first window is special, unless
    ``standard``: its first k-gram is compared with its last only, so either
    its last opens the sequence or it is left out.
    """
    n = len(h1)
    if not n:
        return np.zeros(0, np.int64)
    order = n - 1 - np.argsort(h1[::-1], kind="stable")
    near = np.flatnonzero(h1[order[1:]] == h1[order[:-1]])
    if len(near) and (h2[order[near]] != h2[order[near + 1]]).any():
        order = np.lexsort((-np.arange(n), h2, h1))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    if n < w:
        return order[:1]
    floor, skip = 0, False
    if not standard:
        if (h1[w - 1], h2[w - 1]) <= (h1[0], h2[0]):
            floor = w - 1
        else:
            skip = True
    rank = np.where(np.arange(n) >= floor, rank, n)
    least = rank
    size = 1
    while size * 2 <= w:  # sliding minima by doubling
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: n - w + 1], least[w - size : w - size + n - w + 1])
    return np.unique(order[least[1:] if skip else least])


def _batches(batches: Iterator[pa.RecordBatch], make) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            made = [make(i, language(name), text) for i, name, text in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns))]
            made = [b for b in made if b is not None]
            if made:  # one batch for many files: each sent costs a fixed time
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()


def parseable(source_files: DataFrame, config: ScanConfig) -> DataFrame:
    """(file_idx, language, content) of the files that a scan reads: known extension, language kept, no ignore pattern in the path, content not null."""
    keep = source_files.select("file_idx", "path", language_of("path").alias("language"), "content").where(F.col("language").isNotNull() & F.col("content").isNotNull())
    if config.languages:
        keep = keep.where(F.col("language").isin(*config.languages))
    for p in config.ignore_patterns:
        keep = keep.where(~F.col("path").contains(p))
    return keep.select("file_idx", "language", "content")


def tokens(source_files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(file_idx, pos, kind, tok, line_start, line_end, byte_offset) of every token that is no white space or comment.

    Lines count from 1, offsets are of UTF-8 bytes from 0. Empty texts and texts of comments have no tokens.
    """

    def make(i: int, lang: Language, text: str) -> pa.RecordBatch | None:
        kind, tok, a, b, at = lex(text, lang, config.detect_type2)
        if not len(tok):
            return None
        n = len(tok)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), pa.array(np.arange(n, dtype=np.int32)), pa.array(KINDS).take(pa.array(kind)), pa.array(tok), pa.array(a), pa.array(b), pa.array(at)], ["file_idx", "pos", "kind", "tok", "line_start", "line_end", "byte_offset"])

    return spread(parseable(source_files, config), "file_idx").mapInArrow(lambda it: _batches(it, make), TOKEN_SCHEMA)


def _hashes(source_files: DataFrame, config: ScanConfig, thin: bool, counted: bool = False) -> DataFrame:
    k, w = config.k, config.w
    names = ["file_idx", "pos", "h1", "h2", "line_start", "line_end", "byte_offset", *(["before", "upto"] * counted)]

    def make(i: int, lang: Language, text: str) -> pa.RecordBatch | None:
        _, tok, a, b, at = lex(text, lang, config.detect_type2)
        h1, h2 = kgram_hashes(tok, k)
        pos = winnow(h1, h2, w) if thin else np.arange(len(h1))
        if not len(pos):
            return None
        first, last = a[pos], b[pos + k - 1]
        cols = [np.full(len(pos), i), pos.astype(np.int32), h1[pos], h2[pos], first, last, at[pos]]
        if counted:  # lines of tokens ascend
            cols += [np.searchsorted(a, first, "left"), np.searchsorted(b, last, "right")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return spread(parseable(source_files, config), "file_idx").mapInArrow(lambda it: _batches(it, make), HASH_SCHEMA + ", before bigint, upto bigint" * counted)


def kgrams(source_files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(file_idx, pos, h1, h2, line_start, line_end, byte_offset) of every k-gram; files of fewer than k tokens have none."""
    return _hashes(source_files, config, False)


def fingerprints(source_files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """The k-grams that winnowing keeps."""
    return _hashes(source_files, config, True)


def counted_fingerprints(source_files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """fingerprints with before and upto: the file's tokens that begin before its first line, and that end on its last line or before."""
    return _hashes(source_files, config, True, counted=True)


def parsed_files(source_files: DataFrame, config: ScanConfig = ScanConfig()) -> DataFrame:
    """(file_idx, language, token_count) of every file that a scan reads."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, len(lex(t, language(n))[1])) for i, n, t in zip(*(c.to_pylist() for c in b.columns))]
            ids, names, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["file_idx", "language", "token_count"])

    return spread(parseable(source_files, config), "file_idx").mapInArrow(count, "file_idx bigint, language string, token_count bigint")
