import random

import numpy as np
import pytest

from twinweave.llm import handwritten as hw

SRC = "file_idx bigint, path string, content string"
WORDS = "river stone maple cedar tower bridge lantern meadow harbor pillar".split()


def hand(rng):
    name = lambda: "_".join(rng.sample(WORDS, 2))
    body = "\n".join(f"def {name()}({name()}, b):\n    {name()} = b + {rng.randrange(99)}\n    if b > {rng.randrange(9)}:\n        return {name()}(b)\n    return b\n" for _ in range(rng.randrange(3, 7)))
    return f"src/{name()}.py", rng.choice(["", "# Emits a DO NOT EDIT banner.\n", "# All rights reserved\n"]) + body


def made(rng, banner=True):
    body = "\n".join(f"class {rng.choice(WORDS).title()}{i}Message(Message):\n    FIELD_{i} = ({rng.randrange(9999)}, {i}, '{rng.choice(WORDS)}')" for i in range(rng.randrange(10, 25)))
    return f"src/{'_'.join(rng.sample(WORDS, 2))}.py", ("# Code generated by tool v1. DO NOT EDIT.\n" if banner else "") + body


def vendored(rng):
    name = "".join(rng.sample(WORDS, 2))
    return f"lib/{name}.py", f"# {name} v1.2.{rng.randrange(9)} - fast\n# Upstream: example.net/{name}\n" + hand(rng)[1]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(0)
    rows, truth = [], {}
    for i in range(700):
        kind = rng.choice(["hand"] * 7 + ["made", "hidden", "vendor"])
        path, text = hand(rng) if kind == "hand" else vendored(rng) if kind == "vendor" else made(rng, kind == "made")
        rows.append((i, f"repo{rng.randrange(12)}/m-{i:x}/{path}", text))
        truth[i] = kind != "hand"
    rows += [(900, None, "x"), (901, "repo1/a/b.py", None), (902, "repo1/a/c.py", ""), (903, "repo1/m/src/" + made(rng)[0], made(rng)[1] + "\nclass (:")]
    return spark.createDataFrame(rows, SRC).selectExpr("*", "1 AS label", "'x' AS repo"), truth


def test_found(files):
    df, truth = files
    got = {r.file_idx for r in hw.unwritten_files(df).collect()}
    want = {i for i, t in truth.items() if t}
    assert len(got & want) / len(want) > 0.97 and len(got - want) / len(got) < 0.03
    assert 903 not in got  # doesn't parse
    assert all(r.recall > 0.9 for r in hw.held_out_accuracy(df).collect())


# A second collection, whose tools and vendors word their banners otherwise.
OTHER_TOOLS = ("# This module was produced automatically from {}.yaml\n", "# @generated by {}\n", "# Machine-written. Manual modifications get discarded by {}.\n", "# Datei durch {} erzeugt\n", "# Built by {} 4.2, do not modify\n")
OTHER_VENDORS = ("# Taken from https://{0}.example.org at release 3.1\n", "# {0} version 2.0.11\n", "# Copyright 2019 {0} contributors\n", "# Vendored from {0}, tag v7.2\n")


@pytest.fixture(scope="module")
def other_files(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(600):
        kind = rng.choice(["hand"] * 7 + ["made", "hidden", "vendor"])
        path, text = hand(rng) if kind == "hand" else made(rng, False)
        if kind == "made":
            text = rng.choice(OTHER_TOOLS).format(rng.choice(WORDS)) + text
        elif kind == "vendor":
            name = "".join(rng.sample(WORDS, 2))
            path, text = f"lib/{name}.py", rng.choice(OTHER_VENDORS).format(name) + hand(rng)[1]
        rows.append((i, f"team{rng.randrange(12)}/m-{i:x}/{path}", text))
        truth[i] = kind != "hand"
    return spark.createDataFrame(rows, SRC), truth


def test_other_banners(other_files):
    df, truth = other_files
    got = {r.file_idx for r in hw.unwritten_files(df).collect()}
    want = {i for i, t in truth.items() if t}
    assert len(got & want) / len(want) > 0.95 and len(got - want) / max(1, len(got)) < 0.05


def test_kept(files, spark):
    df, _ = files
    model = hw.fit(df)
    kept = hw.kept_files(df, model)
    assert kept.columns == df.columns
    ids, found = {r.file_idx for r in kept.collect()}, {r.file_idx for r in hw.unwritten_files(df, model).collect()}
    assert ids | found == {r.file_idx for r in df.collect()} and not ids & found and {900, 901, 902, 903} <= ids
    assert hw.kept_files(spark.createDataFrame([], SRC)).count() == 0


@pytest.mark.parametrize("line", ["Emits a DO NOT EDIT banner into its output", "All rights reserved", "Parses generated files", "Copies records from one table to another", "Version 2 of the parser"])
def test_no_banner(spark, line):
    df = spark.createDataFrame([(1, "r/a.py", f"# {line}\nx = 1\n")], SRC)
    assert hw.weak_labels(df).where("tool_banner or vendor_banner").count() == 0


def test_empty(spark):
    e = spark.createDataFrame([], SRC)
    assert hw.unwritten_files(e).count() == 0 and hw.held_out_accuracy(e).count() == 0
    one = spark.createDataFrame([(1, "r/a.py", "x = 1"), (1, "r/a.py", "x = 1")], SRC)
    assert hw.unwritten_files(one).count() == 0


def test_masking():
    assert hw.masked("// Code generated\n/* DO NOT EDIT */\nint a; // b\n// tail\n", "c").strip() == "int a; // b"
    assert hw.masked("#define X 1\n", "c") == "#define X 1" and hw.masked("# made\nx = 1\n", "py").strip() == "x = 1"
    a, b = hw.body_features("// banner one\nint a;", "c"), hw.body_features("int a;", "c")
    assert np.allclose(a, b)
    assert np.isfinite(hw.body_features("", "c")).all() and np.isfinite(hw.body_features("x" * 500_000, "c")).all()


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 20)).astype(np.float32)
    w = rng.normal(size=20)
    y = np.where(x @ w > 0, 1, -1)
    got = hw.train_svm(x, y, c=10)
    assert (np.sign(x @ got) == y).mean() > 0.97


def test_ignore_patterns(spark):
    f = spark.createDataFrame([(1, "r/vendor/a"), (2, "r/src/a"), (3, "q/vendor/a"), (4, None)], "file_idx bigint, path string")
    c = spark.createDataFrame([("r", ["vendor", None]), ("r", ["x"]), ("q", None)], "directory string, ignore_patterns array<string>")
    assert {r.file_idx: r.ignored for r in hw.ignored_by_pattern(f, c).collect()} == {1: True, 2: False, 3: False, 4: False}
