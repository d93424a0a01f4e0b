"""Pairs matched in blocks are the folded raw pairs, which are never made."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from twinweave.operators import blocks, pairs

SCHEMA = "file_idx bigint, pos int, h1 bigint, h2 bigint, line_start int, line_end int, before bigint, upto bigint"


def places(seed):
    """Texts with runs of few hashes, several of which start on one line; the last file number stands for two texts."""
    rng = random.Random(seed)
    out = []
    for f in [*range(-3, 21), 20]:
        line, h, pos = 1, 0, 0
        for _ in range(rng.randrange(60)):
            h = rng.choice([h, h, h, rng.randrange(4)])
            line += rng.choice([0, 0, 1, 1, 2, 9])
            out.append((f, pos, h - 1, h % 2, line, line + 2, 3 * line, 3 * line + 9))
            pos += rng.randrange(1, 5)
    return out


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("seed, units, scan_self", [(1, 50, True), (2, 10**6, True), (3, 50, False)])
def test_merged_in_blocks_equals_folded_raw_pairs(spark, monkeypatch, seed, units, scan_self):
    monkeypatch.setattr(blocks, "UNITS", units)
    prints = spark.createDataFrame(places(seed), SCHEMA)
    files = spark.createDataFrame([(1, "a", "x")], "file_idx bigint, path string, content string")
    meet = lambda every: blocks.meet(prints, files, blocks.kernel(3, every, scan_self, tokens=True), blocks.MERGED + blocks.TOKENS, every)
    found = rows(meet(1))
    assert len(found) > 500 and found == rows(pairs.merged_pairs(pairs.raw_pairs(prints, scan_self)))
    assert rows(meet(5)) == rows(pairs.merged_pairs(pairs.raw_pairs_of(prints, 5, scan_self)))


def test_nothing_gives_nothing(spark):
    prints, files = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "file_idx bigint, path string, content string")
    assert pairs.merged_in_blocks(files, prints).count() == 0
    assert pairs.clone_pairs(files, prints).count() == 0


@pytest.fixture(scope="module")
def repetitive(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("repetitive"))
    text = "x = [\n" + "    1, 2,\n" * 400 + "]\n"
    spark.createDataFrame([(i, f"d{i}/a.py", text) for i in range(40, 60)], "file_idx bigint, path string, content string").write.parquet(f"{d}/source_files.parquet")
    return d


QUERIES = ("clone_pairs_search", "merged_pairs_normalised", "span_token_count_normalised", "clone_pairs_normalised", "top_clones_normalised", "scan_result_normalised")


@pytest.mark.parametrize("name", QUERIES)
def test_raw_pairs_are_not_shuffled(spark, repetitive, name):
    """Fingerprints are the most that moves: no raw pair is made by a join, none is sorted."""
    plan = entry.queries()[name](spark, repetitive)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan
    assert "hashpartitioning(file_a" not in plan


def test_two_paths_of_one_number(spark):
    text = "x = [\n" + "    1, 2,\n" * 60 + "]\n"
    files = spark.createDataFrame([(1, "a.py", text), (2, "b.py", text), (2, "c.odd", None)], "file_idx bigint, path string, content string")
    from twinweave.operators import lexer

    found = pairs.clone_pairs(files, lexer.counted_fingerprints(files)).where(F.col("file_a") != F.col("file_b"))
    across = {(r.file_a, r.file_b) for r in found.collect()}
    assert {("a.py", "b.py"), ("a.py", "c.odd")} <= across


def test_top_pairs_come_from_large_files(spark, monkeypatch):
    """The first pairs are those of all files, though small files, of which there are many, aren't matched; a number's short text counts with its long one."""
    rng = random.Random(4)
    text = lambda n: "".join("a " + " a ".join(rng.choices("+-*/%<>&|^=", k=8)) + " a\n" for _ in range(n))
    large, small = text(200), [text(20) for _ in range(5)]
    data = [(i, f"d{i % 3}/s{i}.py", small[i % 5]) for i in range(200)] + [(i, f"d{i % 3}/l{i}.py", large[: 2000 + 300 * (i - 200)]) for i in range(200, 212)] + [(200, "e/s.py", small[0]), (201, "e/none.py", None)]
    files = spark.createDataFrame(data, "file_idx bigint, path string, content string")
    whole = pairs.in_order(pairs.clone_pairs(files, pairs.counted_fingerprints(files))).limit(25).collect()
    taken, clone_pairs = [], pairs.clone_pairs
    monkeypatch.setattr(pairs, "FEW", 10)
    monkeypatch.setattr(pairs, "clone_pairs", lambda f, *a: taken.append(f.count()) or clone_pairs(f, *a))
    assert pairs.top_clone_pairs(files).collect() == whole and max(taken) < 20
    # few pairs of large files: all are matched at last
    taken.clear()
    rest = files.where("file_idx < 198 or file_idx > 210").orderBy("file_idx")
    assert pairs.top_clone_pairs(rest, n=400).collect() == pairs.in_order(clone_pairs(rest, pairs.counted_fingerprints(rest))).limit(400).collect()
    assert taken[-1] == rest.count()


def test_fingerprints_are_shuffled_once(spark, repetitive, monkeypatch):
    """However many blocks there are, each goes to one place, from which tasks fetch it; texts are lexed once."""
    found = rows(entry.queries()["clone_pairs_normalised"](spark, repetitive))
    monkeypatch.setattr(blocks, "MET", 4000)
    q = entry.queries()["clone_pairs_normalised"](spark, repetitive)
    assert sorted(map(repr, q.select(*sorted(q.columns)).collect())) == found
    q.collect()
    plan = q._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and plan.count("MapInArrow _pack") == plan.count("ReusedExchange") == 1


def test_files_matched_with_themselves_are_folded_some_at_once(monkeypatch):
    """What is held in memory is about UNITS or one file's units, not those of all files of a block."""
    t = pa.table(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], zip(*[(f, 9 * i, 0, 0, 9 * i, 9 * i + 2, 0, 9) for f in range(50) for i in range(10)]))))
    t = t.append_column("side", pa.array(np.full(len(t), 2)))
    sizes, merge = [], blocks._merge
    monkeypatch.setattr(blocks, "UNITS", 100)
    monkeypatch.setattr(blocks, "_merge", lambda parts, gap: sizes.append(sum(len(x[0]) for x in parts)) or merge(parts, gap))
    found = sum(b.num_rows for b in blocks.kernel(3)(iter(t.to_batches())))
    assert found > 1000 and sum(sizes) == 50 * 45 + 50 * 49 // 2 * 100 and max(sizes) < 6000
    assert sizes[-1] < 200


@pytest.mark.parametrize("two, tokens", [(True, False), (False, False), (True, True)])
def test_merged_pairs_take_few_bytes(two, tokens):
    """Neighbouring rows are alike: a file of them is much smaller than in the order of files and lines, which is how they were given before."""
    rng, n = random.Random(7), 120
    got = []
    for f in range(n):
        line, own = 1, rng.choice([1, 2, 5])
        for i in range(12):
            line += rng.choice([6, 9, 14])
            got.append((f, 9 * i, rng.randrange(5), 0, line, line + rng.randrange(1, 5) * own, 9 * i, 9 * i + rng.randrange(9, 30)))
    t = pa.table(dict(zip([c.split()[0] for c in SCHEMA.split(", ")], zip(*got))))
    t = t.append_column("side", pa.array(np.asarray(t["file_idx"]) % 2 if two else np.full(len(t), 2)))
    found = pa.Table.from_batches(blocks.kernel(3, tokens=tokens)(iter(t.to_batches())))
    assert found.num_rows > 30_000

    def size(x):
        sink = pa.BufferOutputStream()
        pq.write_table(x, sink, compression="snappy")
        return len(sink.getvalue())

    assert size(found) < 0.8 * size(found.sort_by([(c, "ascending") for c in ("file_a", "file_b", "start_a", "start_b")]))
