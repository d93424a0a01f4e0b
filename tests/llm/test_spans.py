import random

import pytest
from pyspark.sql import functions as F

from twinweave.llm import spans

SCHEMA = "record bigint, pos int, h1 bigint, h2 bigint"


def brute(rows, n):
    """Stretches by comparing all windows."""
    at = {}
    for r, p, a, b in sorted(rows, key=lambda x: (x[0] is None, x[1] is None, x[:2] if None not in x[:2] else (), x[2] is None, x[2] or 0, x[3] is None, x[3] or 0)):
        if r is not None and p is not None:
            at.setdefault((r, p), (a, b))
    where = {}
    windows = {}
    for r, p in at:
        w = [at.get((r, p + i)) for i in range(n)]
        if all(x is not None and None not in x for x in w):
            windows[r, p] = tuple(w)
            where.setdefault(tuple(w), set()).add(r)
    covered = sorted({(r, p + i) for (r, p), w in windows.items() if len(where[w]) > 1 for i in range(n)})
    out = []
    for r, p in covered:
        if out and out[-1][0] == r and out[-1][2] == p - 1:
            out[-1][2] = p
        else:
            out.append([r, p, p])
    return sorted(map(tuple, out))


def run(spark, rows, n, limits=spans.Limits()):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(map(tuple, spans.stretches(spans.shared_runs(df, n, limits), 2 * limits.block).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for r in range(25):
        p = 0
        for _ in range(rng.randrange(0, 120)):
            p += 1 if rng.random() < 0.97 else 2
            a = rng.randrange(3)
            rows.append((r, p, None if rng.random() < 0.02 else a, rng.choice([0, 0, 0, None]) if rng.random() < 0.02 else 0))
    rows += rows[:50] + [(None, 1, 1, 1), (1, None, 1, 1), (3, 1, 9, 9)]
    rng.shuffle(rows)
    n = rng.choice([2, 4, 8])
    assert run(spark, rows, n) == brute(rows, n)


@pytest.mark.parametrize("sent", [1000, 1])
def test_copies_hot_minimizers_and_blocks(spark, sent):
    small = spans.Limits(block=16, heavy_symbols=100, heavy_sent=sent, shard_symbols=50, memo_pieces=20)
    rng = random.Random(9)
    head = [rng.randrange(50) for _ in range(40)]
    rows = []
    for r in range(60):  # most records begin alike, some are one symbol over and over
        body = [7] * 90 if r % 10 == 0 else head + [rng.randrange(10**6) for _ in range(20)]
        rows += [(r, p, s, 0) for p, s in enumerate(body)]
    assert run(spark, rows, 8, small) == brute(rows, 8)


def test_no_shard_is_larger_than_its_bound(spark):
    # a third of all pieces of one minimizer: what a task is given stays bounded
    rng = random.Random(2)
    rows = [(r, p, s, 0) for r in range(80) for p, s in enumerate([3, 3, 3, 3, *(rng.randrange(10**6) for _ in range(8))] * 2)]
    limits = spans.Limits(heavy_symbols=200, shard_symbols=100)
    df = spark.createDataFrame(rows, SCHEMA)
    many = [r.n for r in spans._blocks(df, 8, limits.block).mapInArrow(lambda it: spans._count_routes(spans._dedup(it), 8, limits), "route bigint, n bigint").groupBy("route").sum("n").toDF("route", "n").collect()]
    assert max(many) > 200  # there is something to split
    assert run(spark, rows, 8, limits) == brute(rows, 8)


def test_reference_of_bounded_size(spark):
    rng = random.Random(11)
    rows = [(r, p + (p > 40) * (r % 3), None if rng.random() < 0.02 else rng.randrange(3), 0) for r in range(20) for p in range(rng.randrange(0, 90))]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, spans.stretches(spans.spans_in_reference(df, df, 5)).collect()))
    assert got == brute(rows, 5) and got
    # hashes of 62 bits beside nulls
    wide = df.withColumn("h1", F.col("h1") + F.lit(2**61 + 1))
    assert sorted(map(tuple, spans.stretches(spans.spans_in_reference(wide, wide, 5)).collect())) == got
    part = df.where("record < 4")
    want = sorted(map(tuple, spans.stretches(spans.spans_in_reference(df, part, 5)).where("record >= 4").collect()))
    at = {x for x in want}
    assert at and at != {x for x in got if x[0] >= 4}
    with pytest.raises(ValueError):
        spans.spans_in_reference(df, df, 5, most=10)
    assert spans.spans_in_reference(df, df.where("false"), 5).count() == 0


def test_removed(spark):
    rows = [(f, p, f * 100 + p if p > 9 else p, 0, p, p) for f in (1, 2) for p in range(14)] + [(3, 0, None, 1, 0, 0), (None, 0, 1, 1, 0, 0)]
    fp = spark.createDataFrame(rows + rows[:3], "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int")
    assert sorted(map(tuple, spans.without_shared(fp).collect())) == [(f, p, f * 100 + p, 0) for f in (1, 2) for p in range(10, 14)] + [(3, 0, None, 1)]
    assert spans.without_shared(fp.where("false")).count() == 0


def test_empty_and_clashing_columns(spark):
    assert run(spark, [], 8) == []
    fp = spark.createDataFrame([(f, p, p, 0, p + 1, p + 2, "x", 1) for f in (1, 2) for p in range(9)], "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int, record string, block int")
    assert sorted(map(tuple, spans.shared_spans(fp).select("file_idx", "line_start", "line_end").collect())) == [(1, 1, 10), (2, 1, 10)]
    parsed = spark.createDataFrame([(1, 90), (1, 90)], "file_idx bigint, token_count bigint")
    assert sorted(map(tuple, spans.shared_share(fp, parsed).collect())) == [(1, 9, 9, 1.0, 90), (2, 9, 9, 1.0, None)]


def test_automaton_matching_statistics():
    rng = random.Random(4)
    for _ in range(300):
        seqs = [[rng.randrange(2) for _ in range(rng.randrange(1, 14))] for _ in range(4)]
        a = spans.SuffixAutomaton()
        for i, s in enumerate(seqs):
            a.add(s, i, i)
        a.finish()
        n = rng.randrange(1, 5)
        for s in seqs:
            want = [i for i in range(len(s) - n + 1) if sum(any(t[j : j + n] == s[i : i + n] for j in range(len(t) - n + 1)) for t in seqs) > 1]
            assert a.shared_windows(s, n) == want
