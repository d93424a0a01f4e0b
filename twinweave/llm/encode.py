"""Byte-level BPE encoding of whole texts in linear time.

The tokens of the vocabulary are put into an Aho-Corasick automaton over bytes
read as Latin-1. An encoding is the one that merging by rank gives if, and only
if, every two adjacent tokens are *compatible*: merging their joined bytes gives
just these two. So each pre-token is covered by its longest match first; on an
incompatible neighbour the next shorter match is tried, and when none is left
the search steps back, never visiting a position twice after it has failed.
Compatibility is computed once per pair of tokens and memoised.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinweave.session import spread

#: Default folder of the vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"

# Fixed value: the pre-token pattern that belongs to the vocabulary.
PRE_TOKENS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pre-tokens and token pairs remembered by a worker.
MEMO = 1 << 18


class BytePairEncoder:
    """ranks: id of each token's bytes, in the order of the merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.split = regex.compile(PRE_TOKENS).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        # the longest token that is a proper prefix of a token
        self.shorter: dict[int, int] = {}
        for b, i in ranks.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := ranks.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    @classmethod
    def load(cls, folder: str = TOKENIZERS, name: str = VOCABULARY) -> BytePairEncoder:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merged(self, data: bytes) -> list[int]:
        """Merging by rank, step by step; quadratic, for short data only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if rank == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def pre_token(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        first = [-1] * n  # the longest token that starts at each position
        for end, (size, i) in self.automaton.iter(data.decode("latin-1")):
            start = end - size + 1
            first[start] = i  # ends ascend, so the last is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, first[0]
        size_of = self.bytes_of
        while at < n:
            end = at + len(size_of[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = first[at] if at < n else -1
                continue
            while (up := self.shorter.get(token)) is None:
                # nothing starts here that fits: the position is dead, step back
                dead[at] = 1
                token = out.pop()
                at -= len(size_of[token])
            token = up
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without special tokens; their strings are plain text."""
        out: list[int] = []
        memo = self.memo
        for piece in self.split(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.pre_token(piece.encode("utf-8", "replace"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(maxsize=2)
def encoder(folder: str, name: str) -> BytePairEncoder:
    """One encoder per worker process."""
    return BytePairEncoder.load(folder, name)


def _encode_batches(batches: Iterator[pa.RecordBatch], folder: str, name: str, counts: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(folder, name)
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = [enc.encode(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            if counts:
                last = pa.array(sizes, pa.int64())
            else:
                flat = np.fromiter((i for r in rows for i in r), np.int32, int(sizes.sum()))
                last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], last], [*part.schema.names[:-1], "__encoded"])


def _encoded(df: DataFrame, keep: list[str], text: str, out: str, counts: bool, folder: str, name: str) -> DataFrame:
    slim = spread(df.select(*[F.col(k).alias(f"c{i}") for i, k in enumerate(keep)], F.col(text).alias("__text")), "c0")
    schema = ", ".join(f"c{i} {slim.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep))) + f", __encoded {'bigint' if counts else 'array<int>'}"
    done = slim.mapInArrow(lambda it: _encode_batches(it, folder, name, counts), schema)
    return done.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(keep)], F.col("__encoded").alias(out))


def encode_texts(df: DataFrame, keep: list[str], text: str = "text", out: str = "ids", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """keep's columns and the ids of each text; null and empty texts have an empty list.

    No row is dropped and none moves, but for a table of fewer splits than
    tasks. Repeated rows stay repeated; ``out`` may be the name of a column
    that isn't kept.
    """
    return _encoded(df, keep, text, out, False, folder, name)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", out: str = "n_tokens", folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """keep's columns and the number of tokens of each text, 0 for null and empty texts."""
    return _encoded(df, keep, text, out, True, folder, name)
