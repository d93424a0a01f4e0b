import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return c


NAMES = sorted(entry.queries())


def test_registry():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    got = [norm(tuple(r)) for r in df.select(*sorted(df.columns)).collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    columns = [x[0] for x in r.description]
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(columns) == sorted(df.columns)
    want = [norm(tuple(row[i] for i in order)) for row in r.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    """Nothing outside the package llm imports it, but for the entry, which can do without."""
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent
    for p in (root / "twinweave").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"twinweave\.llm|from \.+llm", p.read_text()), p
