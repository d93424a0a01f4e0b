"""Long exact spans shared between records, by suffix automata and matching statistics.

Records are sequences of symbols (here: files of fingerprints). A span is
shared if it is at least ``min_run`` symbols long and stands in another record
too.

One automaton of all records cannot be built, and automata of reference
shards that are sent to every task would each have to be walked by every
record: work that grows with the square of the data. So the shards are cut by
content instead. The *minimizer* of a window of ``min_run`` symbols is the least hash of its
sub-windows of ``GRAM`` symbols; equal windows have equal minimizers. Successive windows
with one minimizer form a piece, and pieces go to the shard of their
minimizer, so any two places that share a window meet in one shard. Of each shard a
suffix automaton is built whose states know the least and greatest record that
they occur in, and the shard's pieces are streamed through it; a position
whose matching statistic reaches ``min_run`` in a state of two records or more
ends a shared window. Repeated pieces are reduced to one before they are sent, and
their result is joined back to all their places. The pieces of a minimizer with more symbols than
one automaton should hold are cut into single windows, which are reduced and spread by their
own hash: equal windows still meet. So no shard holds more than a fixed number of symbols.

spans_in_reference is the plain form, one automaton sent to every task, for a reference of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinweave.config import ScanConfig
from twinweave.operators.lexer import lex, parseable
from twinweave.operators.skew import fragment_replicate_join, plan_skew
from twinweave.session import cut
from twinweave.sources.languages import language

#: Symbols of a shared run, at least.
MIN_RUN = 8
#: Symbols of the sub-windows whose least hash is the minimizer.
GRAM = 4


@dataclass(frozen=True)
class Limits:
    """Sizes of the work; the result doesn't depend on them.

    block: consecutive positions of a record that are cut into pieces at once.
    heavy_symbols: the pieces of a minimizer with more symbols than that are cut into windows. heavy_sent: as many such minimizers
    are sent to the tasks; if there are more, their pieces are found by a join. shard_symbols: symbols after which a new automaton
    is begun. memo_pieces: pieces a task remembers so as to send repeated ones once.
    """

    block: int = 8192
    heavy_symbols: int = 200_000
    heavy_sent: int = 100_000
    shard_symbols: int = 200_000
    memo_pieces: int = 100_000


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class SuffixAutomaton:
    """A generalised suffix automaton of integer sequences whose states know the least and greatest record they occur in."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.low: list[int | None] = [None]
        self.high: list[int | None] = [None]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.low.append(None)
        self.high.append(None)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of length[p] + 1 below p: q itself or a copy of it."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: list[int], low: int, high: int) -> None:
        """Add a sequence that stands in records low to high."""
        last = 0
        lows, highs = self.low, self.high
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and symbol not in self.next[p]:
                    self.next[p][symbol] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, symbol, self.next[p][symbol])
                last = new
            if lows[last] is None or low < lows[last]:
                lows[last] = low
            if highs[last] is None or high > highs[last]:
                highs[last] = high

    def finish(self) -> None:
        """Hand the records of each state on to the states of its suffixes."""
        low, high, link = self.low, self.high, self.link
        for s in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            up = link[s]
            if up > 0:
                if low[up] is None or low[s] < low[up]:
                    low[up] = low[s]
                if high[up] is None or high[s] > high[up]:
                    high[up] = high[s]

    def shared_windows(self, sequence: list[int], window: int, record: int | None = None) -> list[int]:
        """The starts of the windows of a sequence that stand in two records or more, or, of a given record's, in another one."""
        state = matched = 0
        out = []
        nexts, link, length, low, high = self.next, self.link, self.length, self.low, self.high
        for i, symbol in enumerate(sequence):
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            to = nexts[state].get(symbol)
            if to is None:
                matched = 0
                continue
            state, matched = to, matched + 1
            # the matching statistic need not be known beyond the window
            while length[link[state]] >= window:
                state = link[state]
            if matched >= window:
                matched = window
                if low[state] != high[state] or record is not None and low[state] != record:
                    out.append(i - window + 1)
        return out


def _carry(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[dict[str, np.ndarray]]:
    """Batches as NumPy columns, cut so that rows of equal first ``keys`` columns are never parted."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        cols = [t.column(i).to_numpy() for i in range(keys)]
        same = np.ones(t.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        end = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = t.slice(end)
        if end:
            yield t.slice(0, end)
    if rest is not None and rest.num_rows:
        yield rest


def _pieces(t: pa.Table, min_run: int, limits: Limits) -> tuple[np.ndarray, ...]:
    """(minimizer, first row, last row) of the pieces of a table of (block, file, pos, h1, h2, ...), sorted, and its symbols."""
    block, rec, pos = (t.column(i).to_numpy() for i in range(3))
    h1, h2 = (np.asarray(t.column(i).fill_null(0)).astype(np.int64).view(np.uint64) for i in (3, 4))
    ok = ~(np.asarray(t.column(3).is_null()) | np.asarray(t.column(4).is_null()))
    sym = mix64(h1 * _M1 ^ mix64(h2 + _M1))
    n = len(rec)
    none = np.zeros(0, np.int64)
    if n < min_run:
        return none.view(np.uint64), none, none, sym
    m = n - min_run + 1
    good = np.ones(m, bool)
    for i in range(min_run):
        good &= ok[i : m + i]
    good &= (rec[:m] == rec[min_run - 1 :]) & (block[:m] == block[min_run - 1 :]) & (pos[min_run - 1 :] - pos[:m] == min_run - 1)
    good &= pos[:m] // limits.block == block[:m]  # windows that begin in the halo belong to the next block
    gram = min(GRAM, min_run)
    g = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        g = mix64(g * _M1 + sym[i : n - gram + 1 + i])
    least = g[:m].copy()
    for i in range(1, min_run - gram + 1):
        np.minimum(least, g[i : m + i], out=least)
    at = np.nonzero(good)[0]
    if not len(at):
        return none.view(np.uint64), none, none, sym
    route = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (route[1:] != route[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    return route[first], at[first], at[last] + min_run - 1, sym


def _piece_hash(sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the symbols and length of each piece."""
    size = hi - lo + 1
    h = size.astype(np.uint64)
    for i in range(int(size.max()) if len(size) else 0):
        on = i < size
        h[on] = mix64(h[on] * _M1 + sym[lo[on] + i])
    return h


def _send(batches: Iterator[pa.RecordBatch], min_run: int, limits: Limits, heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The distinct pieces: minimizer, whether it is heavy, hash, symbols, least and greatest record, number of places."""
    memo: dict[tuple[int, int], list] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        if memo:
            keys, vals = list(memo), list(memo.values())
            routes = np.array([k[0] for k in keys], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.isin(routes, heavy)),
                    pa.array(routes.view(np.int64)),
                    pa.array(np.array([k[1] for k in keys], np.uint64).view(np.int64)),
                    pa.array([v[0] for v in vals], pa.binary()),
                    *(pa.array([v[i] for v in vals], pa.int64()) for i in (1, 2, 3)),
                ],
                ["heavy", "route", "piece", "symbols", "low", "high", "n"],
            )
            memo.clear()

    for t in _carry(batches, 2):
        route, lo, hi, sym = _pieces(t, min_run, limits)
        rec = t.column(1).to_numpy()
        for r, p, a, b, f in zip(route.tolist(), _piece_hash(sym, lo, hi).tolist(), lo.tolist(), hi.tolist(), rec[lo].tolist()):
            seen = memo.get((r, p))
            if seen is None:
                memo[r, p] = [sym[a : b + 1].tobytes(), f, f, 1]
                continue
            seen[3] += 1
            if f < seen[1]:
                seen[1] = f
            elif f > seen[2]:
                seen[2] = f
        if len(memo) > limits.memo_pieces:
            yield from flush()
    yield from flush()


def _count_routes(batches: Iterator[pa.RecordBatch], min_run: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    for t in _carry(batches, 2):
        route, lo, hi, _ = _pieces(t, min_run, limits)
        route, at = np.unique(route, return_inverse=True)
        n = np.bincount(at, weights=hi - lo + 1, minlength=len(route)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(n)], ["route", "n"])


def _windows(batches: Iterator[pa.RecordBatch], min_run: int) -> Iterator[pa.RecordBatch]:
    """The windows of pieces: hash, piece, place in it, symbols, least and greatest record, number of places."""
    for batch in batches:
        out: list[tuple] = []
        for route, piece, data, low, high, n in zip(*(batch.column(c).to_pylist() for c in ("route", "piece", "symbols", "low", "high", "n"))):
            sym = np.frombuffer(data, np.uint64)
            m = len(sym) - min_run + 1
            w = np.zeros(m, np.uint64)
            for i in range(min_run):
                w = mix64(w * _M1 + sym[i : m + i])
            out += [(h, route, piece, i, data[8 * i : 8 * (i + min_run)], low, high, n) for i, h in enumerate(w.view(np.int64).tolist())]
            if len(out) > 50_000:
                yield _window_batch(out)
                out = []
        yield _window_batch(out)


_WINDOW = "window bigint, route bigint, piece bigint, at int, symbols binary, low bigint, high bigint, n bigint"


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in _WINDOW.split(", ")])


def _places(batches: Iterator[pa.RecordBatch], min_run: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Where each piece stands: hashes, record, first position, and the lines of its symbols."""
    for t in _carry(batches, 2):
        route, lo, hi, sym = _pieces(t, min_run, limits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(route.view(np.int64)), pa.array(_piece_hash(sym, lo, hi).view(np.int64)), pa.array(t.column(1).to_numpy()[lo]), pa.array(t.column(2).to_numpy()[lo].astype(np.int32))],
            ["route", "piece", "record", "start"],
        )


def _match(batches: Iterator[pa.RecordBatch], min_run: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """Of each piece in a shard the runs of shared windows; the shard's rows are sorted by minimizer."""
    shard: list[tuple[int, int, bytes, int, int, int]] = []
    symbols = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal symbols
        automaton = SuffixAutomaton()
        reads: dict[tuple[int, int], list[int]] = {}
        places: dict[tuple[int, int], int] = {}
        for r, p, data, lo, hi, n in shard:
            s = reads.get((r, p))
            if s is None:
                s = reads[r, p] = np.frombuffer(data, np.uint64).tolist()
            automaton.add(s, lo, hi)
            places[r, p] = places.get((r, p), 0) + n
        automaton.finish()
        out: list[tuple[int, int, int, int, int]] = []
        for (r, p), s in reads.items():
            begin = previous = None
            for w in automaton.shared_windows(s, min_run):
                if begin is None or w > previous + 1:
                    if begin is not None:
                        out.append((r, p, begin, previous + min_run - 1, places[r, p]))
                    begin = w
                previous = w
            if begin is not None:
                out.append((r, p, begin, previous + min_run - 1, places[r, p]))
        shard.clear()
        symbols = 0
        if out:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["route", "piece", "begin", "stop", "n"])

    for t in _carry(batches, 1):
        route, low, high = (t.column(c).to_numpy() for c in ("route", "low", "high"))
        # a minimizer all of whose pieces stand in one record shares nothing
        start = np.flatnonzero(np.append(True, route[1:] != route[:-1]))
        several = np.minimum.reduceat(low, start) < np.maximum.reduceat(high, start)
        keep = np.repeat(several, np.diff(np.append(start, len(route))))
        if not keep.any():
            continue
        kept = t.filter(pa.array(keep))
        rows = list(zip(*(kept.column(c).to_pylist() for c in ("route", "piece", "symbols", "low", "high", "n"))))
        for i, row in enumerate(rows):
            if symbols > limits.shard_symbols and row[0] != rows[i - 1][0]:
                yield from flush()
            shard.append(row)
            symbols += len(row[2]) // 8
        if symbols > limits.shard_symbols:
            yield from flush()
    if shard:
        yield from flush()


def _blocks(records: DataFrame, min_run: int, size: int) -> DataFrame:
    """Distinct (block, record, pos, h1, h2), sorted in partitions; the first positions of a block also end the block before."""
    block = F.floor(F.col("pos") / size).cast("int")
    both = F.when((F.col("pos") % size < min_run - 1) & (F.col("pos") >= size), F.array(block, block - 1)).otherwise(F.array(block))
    slim = records.select("record", "pos", "h1", "h2").where(F.col("record").isNotNull() & F.col("pos").isNotNull()).withColumn("block", F.explode(both))
    one = slim.repartition("block", "record").sortWithinPartitions("block", "record", "pos", F.col("h1").asc_nulls_last(), F.col("h2").asc_nulls_last())
    return one.select("block", "record", "pos", "h1", "h2")


def _dedup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each (block, record, pos)."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        block, rec, pos = (b.column(i).to_numpy() for i in range(3))
        new = np.ones(len(rec), bool)
        new[1:] = (rec[1:] != rec[:-1]) | (pos[1:] != pos[:-1]) | (block[1:] != block[:-1])
        new[0] = last != (block[0], rec[0], pos[0])
        last = (block[-1], rec[-1], pos[-1])
        yield b.filter(pa.array(new))


def shared_runs(records: DataFrame, min_run: int = MIN_RUN, limits: Limits = Limits()) -> DataFrame:
    """(record, first_pos, last_pos): the pieces of each record that stand in another one too; they may overlap.

    records: record bigint, pos int, h1 and h2 bigint. Symbols are equal if both halves are; a null half equals
    nothing and ends a run, as does a gap in pos. Rows with a null record or
    pos are no symbols; repeated rows count once, and of rows that give one
    position different symbols the one of least (h1, h2), nulls last, holds.
    Symbols are compared by a 64-bit mix of their two halves: a wrong match needs
    two different symbols of one mix inside otherwise equal windows. An empty
    table gives no rows.
    """
    spark = records.sparkSession
    blocks = _blocks(records, min_run, limits.block).persist()
    piped = lambda f, *a: (lambda it: f(_dedup(it), min_run, limits, *a))
    counts = blocks.mapInArrow(piped(_count_routes), "route bigint, n bigint").groupBy("route").agg(F.sum("n").alias("n"))
    many = cut(counts.where(F.col("n") > limits.heavy_symbols))
    few = [r[0] for r in many.select("route").limit(limits.heavy_sent + 1).collect()]
    joined = len(few) > limits.heavy_sent
    sent = blocks.mapInArrow(piped(_send, np.array([] if joined else few, np.int64).view(np.uint64)), "heavy boolean, route bigint, piece bigint, symbols binary, low bigint, high bigint, n bigint")
    if joined:
        sent = fragment_replicate_join(sent.drop("heavy"), many.select("route", F.lit(True).alias("heavy")), ["route"], "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = ["route", "piece", "symbols", "low", "high", "n"]
    pieces = sent.where(~F.coalesce("heavy", F.lit(False))).select(columns) if few else sent.select(columns)
    if few:
        windows = cut(sent.where("heavy").mapInArrow(lambda it: _windows(it, min_run), _WINDOW))
        one = windows.groupBy("window").agg(F.min("symbols").alias("symbols"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
        pieces = pieces.unionByName(one.select(F.col("window").alias("route"), F.lit(0).cast("bigint").alias("piece"), "symbols", "low", "high", "n"))
    shards = pieces.repartition(parts, "route").sortWithinPartitions("route")
    runs = cut(shards.mapInArrow(lambda it: _match(it, min_run, limits), "route bigint, piece bigint, begin int, stop int, n bigint"))
    if few:
        # what was found of windows, back to the pieces they are of
        of = windows.select("window", "route", "piece", "at").distinct()
        back = fragment_replicate_join(of, runs.where("piece = 0").select(F.col("route").alias("window"), "n"), ["window"])
        runs = cut(runs.where("piece <> 0").unionByName(back.select("route", "piece", F.col("at").alias("begin"), (F.col("at") + (min_run - 1)).alias("stop"), "n")))
    places = blocks.mapInArrow(piped(_places), "route bigint, piece bigint, record bigint, start int")
    plan = plan_skew(runs.groupBy("route", "piece").agg(F.max("n").alias("n")), ["route", "piece"], load="n")
    found = fragment_replicate_join(places, runs.drop("n"), ["route", "piece"], plan=plan)
    found = cut(found.select("record", (F.col("start") + F.col("begin")).alias("first_pos"), (F.col("start") + F.col("stop")).alias("last_pos")))
    blocks.unpersist()
    return found


def spans_in_reference(records: DataFrame, reference: DataFrame, min_run: int = MIN_RUN, most: int = 300_000) -> DataFrame:
    """(record, first_pos, last_pos): as shared_runs, the pieces of each record that stand in another record of a reference of at most ``most`` rows.

    One automaton of the reference is sent to every task, and each record is streamed through it once. The reference is
    collected to the driver, hence the bound; a larger one is refused (shared_runs has none).
    """
    rows = reference.select(F.lit(0).alias("block"), "record", "pos", "h1", "h2").where(F.col("record").isNotNull() & F.col("pos").isNotNull()).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"the reference has more than {most} rows")
    rows = rows.sort_by([(c, "ascending") for c in ("record", "pos", "h1", "h2")]).combine_chunks()
    t = pa.Table.from_batches(list(_dedup(iter(rows.to_batches()))), rows.schema)
    automaton = SuffixAutomaton()
    record, pos = t.column(1).to_numpy(), t.column(2).to_numpy()
    _, _, _, sym = _pieces(t, min_run, Limits())
    null = np.asarray(t.column(3).is_null()) | np.asarray(t.column(4).is_null())
    cuts = np.flatnonzero(np.append(True, (record[1:] != record[:-1]) | (pos[1:] != pos[:-1] + 1) | null[1:] | null[:-1])) if len(record) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(record)]):
        if not null[a]:
            automaton.add(sym[a:b].tolist(), int(record[a]), int(record[a]))
    automaton.finish()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limits = Limits()
        for t in _carry(_dedup(batches), 2):
            route, lo, hi, sym = _pieces(t, min_run, limits)
            if not len(lo):
                continue
            rec, pos = t.column(1).to_numpy(), t.column(2).to_numpy()
            # pieces of one record that overlap make one sequence
            new = np.flatnonzero(np.append(True, (lo[1:] > hi[:-1]) | (rec[lo[1:]] != rec[lo[:-1]]) | (lo[1:] != hi[:-1] - min_run + 2)))
            out: list[tuple[int, int, int]] = []
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(lo)]):
                r, x = int(rec[lo[a]]), int(lo[a])
                for w in automaton.shared_windows(sym[x : hi[b - 1] + 1].tolist(), min_run, r):
                    out.append((r, int(pos[x + w]), int(pos[x + w]) + min_run - 1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32()))], ["record", "first_pos", "last_pos"])

    return _blocks(records, min_run, Limits.block).mapInArrow(stream, "record bigint, first_pos int, last_pos int")


def stretches(runs: DataFrame, size: int = 4 * Limits.block) -> DataFrame:
    """Maximal stretches of consecutive positions that overlapping or adjoining runs of a record make.

    Runs are first united inside blocks of positions, so that a record of any length is no single task's work.
    """
    block = F.floor(F.col("first_pos") / size).cast("int")

    def united(df: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("first_pos", "last_pos")
        reach = F.max("last_pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = df.withColumn("new", F.when(reach.isNull() | (F.col("first_pos") > reach + 1), 1).otherwise(0))
        isle = new.withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return isle.groupBy(*by, "isle").agg(F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos")).drop("isle")

    return united(united(runs.withColumn("block", block), "record", "block").drop("block"), "record")


def shared_spans(fingerprints: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(file_idx, line_start, line_end, first_pos, last_pos) of each stretch of a file's fingerprints that stands in other files too.

    See shared_runs for nulls, gaps and repeated rows. The lines are those of the first
    and last fingerprint of the stretch; of several rows of one position the
    least line_start and line_end count.
    """
    fp = fingerprints.select(F.col("file_idx").alias("record"), "pos", "h1", "h2", "line_start", "line_end")
    spans = stretches(shared_runs(fp, min_run))
    ends = spans.select("record", F.explode(F.array("first_pos", "last_pos")).alias("pos"), "first_pos", "last_pos")
    at = fp.select("record", "pos", "line_start", "line_end")
    lines = at.join(ends, ["record", "pos"])  # a few rows for each position: no key is hot
    out = lines.groupBy("record", "first_pos", "last_pos").agg(
        F.min(F.when(F.col("pos") == F.col("first_pos"), F.col("line_start"))).alias("line_start"), F.min(F.when(F.col("pos") == F.col("last_pos"), F.col("line_end"))).alias("line_end")
    )
    return out.select(F.col("record").alias("file_idx"), "line_start", "line_end", "first_pos", "last_pos")


def without_shared(fingerprints: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(file_idx, pos, h1, h2): the fingerprints of each file without the stretches that stand in other files too.

    One row per position; see shared_runs for nulls and repeated rows.
    """
    spans = shared_spans(fingerprints, min_run)
    gone = spans.select("file_idx", F.explode(F.sequence("first_pos", "last_pos")).alias("pos"))
    least = F.min(F.struct(F.col("h1").isNull().alias("no1"), "h1", F.col("h2").isNull().alias("no2"), "h2"))
    one = fingerprints.where(F.col("file_idx").isNotNull() & F.col("pos").isNotNull()).groupBy("file_idx", "pos").agg(least.alias("m"))
    return one.join(gone, ["file_idx", "pos"], "left_anti").select("file_idx", "pos", "m.h1", "m.h2")


def shared_share(fingerprints: DataFrame, parsed_files: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(file_idx, n_fingerprints, n_shared, share, shared_tokens): how much of each file stands elsewhere too.

    shared_tokens is an estimate, the share of the file's token_count; null if that isn't known. Every file of
    fingerprints has a row. See counted_share for counted tokens.
    """
    spans = shared_spans(fingerprints, min_run).groupBy("file_idx").agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n_shared"))
    sizes = fingerprints.where(F.col("file_idx").isNotNull() & F.col("pos").isNotNull()).select("file_idx", "pos").distinct().groupBy("file_idx").agg(F.count(F.lit(1)).alias("n_fingerprints"))
    tokens = parsed_files.groupBy("file_idx").agg(F.max("token_count").alias("token_count"))
    n = F.coalesce("n_shared", F.lit(0))
    share = n / F.col("n_fingerprints")
    return sizes.join(spans, "file_idx", "left").join(tokens, "file_idx", "left").select("file_idx", "n_fingerprints", n.alias("n_shared"), share.alias("share"), F.round(share * F.col("token_count")).cast("bigint").alias("shared_tokens"))


def _count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each file, and those of them all of whose lines lie in its spans."""
    for batch in batches:
        rows = []
        for i, name, text, spans in zip(*(batch.column(c).to_pylist() for c in ("file_idx", "language", "content", "spans"))):
            _, _, first, last, _ = lex(text, language(name))
            edge = np.zeros((int(last.max()) if len(last) else 0) + 2, np.int64)
            for x in spans or ():
                # lines beyond the last token hold none
                edge[min(max(x["line_start"], 1), len(edge) - 1)] += 1
                edge[min(max(x["line_end"], 0) + 1, len(edge) - 1)] -= 1
            covered = np.cumsum(np.cumsum(edge) > 0)
            rows.append((i, len(first), int((covered[last] - covered[first - 1] == last - first + 1).sum())))
        cols = list(zip(*rows)) if rows else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["file_idx", "token_count", "shared_tokens"])


def counted_share(fingerprints: DataFrame, source_files: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(file_idx, n_fingerprints, n_shared, share, token_count, shared_tokens, token_share): what part of each file's fingerprints and of its tokens stands elsewhere too.

    Tokens are the lexer's, counted in source_files; those all of whose lines lie in shared stretches are shared, each
    once. They are null for files without content or of no known language. Every file of fingerprints has a row.
    """
    spans = shared_spans(fingerprints, min_run).groupBy("file_idx").agg(
        F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n_shared"),
        F.collect_list(F.when(F.col("line_start").isNotNull() & F.col("line_end").isNotNull(), F.struct("line_start", "line_end"))).alias("spans"),
    )
    sizes = fingerprints.where(F.col("file_idx").isNotNull() & F.col("pos").isNotNull()).select("file_idx", "pos").distinct().groupBy("file_idx").agg(F.count(F.lit(1)).alias("n_fingerprints"))
    shares = cut(sizes.join(spans, "file_idx", "left"))
    texts = parseable(source_files, ScanConfig(ignore_patterns=())).join(shares.select("file_idx", "spans"), "file_idx")
    counted = texts.select("file_idx", "language", "content", "spans").mapInArrow(_count_shared, "file_idx bigint, token_count bigint, shared_tokens bigint")
    n = F.coalesce("n_shared", F.lit(0))
    return shares.join(counted, "file_idx", "left").select(
        "file_idx", "n_fingerprints", n.alias("n_shared"), (n / F.col("n_fingerprints")).alias("share"), "token_count", "shared_tokens", (F.col("shared_tokens") / F.nullif("token_count", F.lit(0))).alias("token_share")
    )
