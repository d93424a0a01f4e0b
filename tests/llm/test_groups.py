import random

import pytest

from twinweave.llm import groups


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sorted((x, find(x)) for x in parent)


def run(spark, pairs, **bounds):
    df = spark.createDataFrame(pairs, "a string, b string").repartition(6)
    return sorted(map(tuple, groups.connected_groups(df, "a", "b", **bounds).collect()))


def graph(seed):
    rng = random.Random(seed)
    names = [f"p/{rng.randrange(10**6):06d}é{i}" for i in range(300)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(170)]
    chain = sorted(names[:60])
    pairs += list(zip(chain, chain[1:])) + [(names[70], n) for n in names[70:130]]
    return pairs + pairs[:40] + [(b, a) for a, b in pairs[:30]] + [(None, "x"), ("y", None), ("z", "z")]


@pytest.mark.parametrize("bounds", [{}, {"max_edges": 150, "max_nodes": 40}, {"max_edges": 30, "max_nodes": 25}])
def test_against_brute_force(spark, bounds):
    pairs = graph(len(bounds))
    assert run(spark, pairs, **bounds) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [("a", "a")]) == []


def test_paths_and_nulls(spark):
    rows = [("./a\\b.rs", "c.rs", "1-2", 1), ("a/b.rs", "d.rs", "1-2", 2), ("e", "f", None, 3), (None, "g", "1", 4), ("./h", "h", "1", 5)]
    df = spark.createDataFrame(rows, "file_a string, file_b string, fragment_hash string, node int")
    assert sorted(map(tuple, groups.file_groups(df).collect())) == [("a/b.rs", "a/b.rs"), ("c.rs", "a/b.rs"), ("d.rs", "a/b.rs")]
