import os
import random

import pytest

from twinweave.llm import encode, mix

if not os.path.exists(f"{encode.TOKENIZERS}/{encode.VOCABULARY}.tiktoken"):
    pytest.skip("vocabulary files are not here", allow_module_level=True)


def tables(spark, n=400, seed=0):
    rng = random.Random(seed)
    docs = [(i, rng.choice(["big"] * 6 + ["mid"] * 3 + ["small", None, "other"]), rng.choice([None, "", "word " * rng.randrange(1, 60)])) for i in range(n)]
    return (
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, n_tokens int"),
        spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 2), ("small", 0.4, 5), ("absent", 0.0, 1)], "source string, target_weight double, max_repeats int"),
        docs,
    )


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET_ROWS", 17)
    docs, targets, rows = tables(spark)
    chosen, shares = mix.mix(docs, targets)
    got = chosen.collect()
    total = sum(r.n_tokens for r in got)
    largest = max(len((t or "").split()) for _, _, t in rows) + 2
    for r in shares.collect():
        if r.available_tokens:
            assert abs(r.tokens - r.target_weight * total) <= 2 * largest, r
    uses = {}
    for r in got:
        uses.setdefault((r.source, r.doc_id), []).append(r["pass"])
    limit = {"big": 1, "mid": 2, "small": 5}
    assert all(sorted(p) == list(range(len(p))) and len(p) <= limit[s] for (s, _), p in uses.items())
    # ordered by finish time, and the running size is exact
    order = sorted(got, key=lambda r: (r.finish_time, r.end_token))
    at = 0
    for r in order:
        at += r.n_tokens
    assert at == max(r.end_token for r in got) == total
    for s in limit:
        mine = sorted((r.finish_time, r.n_tokens) for r in got if r.source == s)
        assert mine[-1][0] * {"big": 0.3, "mid": 0.3, "small": 0.4}[s] == pytest.approx(sum(n for _, n in mine))


def test_same_mix_whatever_the_partitions(spark):
    docs, targets, _ = tables(spark, 150, 1)
    a = sorted(map(tuple, mix.mix(docs.repartition(1), targets)[0].collect()))
    b = sorted(map(tuple, mix.mix(docs.repartition(5), targets)[0].collect()))
    assert a == b and a


def test_budget_and_exhausted_source(spark):
    docs, targets, _ = tables(spark, 200, 2)
    chosen, shares = mix.mix(docs, targets, total_tokens=10**9)
    by = {r.source: r for r in shares.collect()}
    assert all(r.tokens == r.available_tokens for r in by.values())
    small = mix.mix(docs, targets, total_tokens=50)[0].collect()
    assert sum(r.n_tokens for r in small) <= 50


def test_empty(spark):
    docs, targets, _ = tables(spark, 20)
    assert mix.mix(docs.limit(0), targets)[0].count() == 0 and mix.mix(docs, targets.limit(0))[0].count() == 0
    assert mix.mix(docs.limit(0), targets)[1].where("tokens = 0 AND share = 0").count() == 3


def test_source_of_empty_texts(spark):
    docs, targets, rows = tables(spark, 80, 4)
    more = docs.unionByName(spark.createDataFrame([(1000 + i, "none", None, 1) for i in range(30)], docs.schema))
    asked = targets.unionByName(spark.createDataFrame([("none", 0.2, 2)], targets.schema))
    chosen, shares = mix.mix(more, asked)
    got = [r for r in chosen.collect() if r.source == "none"]
    assert len(got) == 60 and {(r.n_tokens, r.end_token, r.finish_time) for r in got} == {(0, 0, 0.0)}
    r = shares.where("source = 'none'").first()
    assert (r.records, r.tokens, r.share) == (60, 0, 0.0)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mix, "MAX_SOURCES", 2)
    docs, targets, _ = tables(spark, 10)
    with pytest.raises(ValueError):
        mix.mix(docs, targets)
