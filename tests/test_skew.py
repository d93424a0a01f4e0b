import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from twinweave.operators import skew
from twinweave.plans import skewed as queries

SCHEMA = "h1 bigint, h2 bigint, file_idx bigint, line_start int, line_end int, n string"


def plain(df, keys):
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.countDistinct("file_idx").alias("distinct_values"), F.min("line_start").alias("first"), F.max("line_end").alias("last"))


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    out = []
    for i in range(6000):
        key = 7 if rng.random() < 0.34 else None if rng.random() < 0.02 else rng.randrange(500)
        out.append((key, key and key % 3, rng.choice([None, 1, rng.randrange(90)]), rng.choice([None, rng.randrange(50)]), rng.randrange(99), "x"))
    return spark.createDataFrame(out + out[:100], SCHEMA)


def test_stats_equal_plain_grouping(skewed):
    plan = skew.plan_skew(skewed.select("h1", "h2"), ["h1", "h2"], tasks=6)
    assert plan.heavy and plan.imbalance < 1.5
    got = skew.balanced_group_stats(skewed, ["h1", "h2"], "file_idx", "line_start", "line_end", plan=skew.plan_skew(skewed.select(F.col("h1").alias("k0"), F.col("h2").alias("k1")), ["k0", "k1"], 6))
    assert rows(got) == rows(plain(skewed, ["h1", "h2"]))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert skew.balanced_group_stats(empty, ["h1"], "file_idx", "line_start", "line_end").count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_equals_plain_join(spark, skewed, how):
    right = spark.createDataFrame([(7, 1, "a"), (7, 1, "b"), (3, 0, "c"), (None, None, "d"), (5, 9, "e")], "h1 bigint, h2 bigint, n string")
    plan = skew.plan_skew(skewed.select("h1", "h2"), ["h1", "h2"], 6)
    got = skew.fragment_replicate_join(skewed, right, ["h1", "h2"], how, plan)
    want = skewed.join(right.withColumnRenamed("n", "n_r"), ["h1", "h2"], how)
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        skew.fragment_replicate_join(skewed, right, ["h1"], "full")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_of_bare_keys(spark, skewed, how, monkeypatch):
    monkeypatch.setattr(skew, "PORTION", 100)
    right = spark.createDataFrame([(7, 1, "a"), (7, 1, "b"), (3, 0, "c"), (None, None, "d")], "h1 bigint, h2 bigint, n string")
    left = skewed.select("h1", "h2")
    assert rows(skew.fragment_replicate_join(left, right, ["h1", "h2"], how)) == rows(left.join(right, ["h1", "h2"], how))


@pytest.mark.parametrize("bare", [False, True])
def test_join_tasks_are_balanced(spark, bare, monkeypatch):
    monkeypatch.setattr(skew, "PORTION", 100)
    left = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("v"))
    right = left.select("k").distinct().withColumn("w", F.lit(1))
    plan = skew.plan_skew(left.select("k"), ["k"], 8)
    assert plan.heavy and plan.total == 20_000
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew.fragment_replicate_join(left.select("k") if bare else left, right, ["k"], plan=plan)
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        plan_text = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(tasks) == 20_000 and len(tasks) == 8 and max(tasks) < 1.5 * 20_000 / 8
    # both sides move once, to their tasks
    assert plan_text.count("REPARTITION_BY_NUM") == 2


def test_packing_is_balanced():
    where, loads = skew.pack([50, 30, 20, 20, 20, 10], 3)
    assert max(loads) == 50 and len(set(where)) == 3
    assert skew.pack([], 2) == ([], [0.0, 0.0])


def test_salts_hit_their_partition(spark):
    salts = skew.task_salt(7)
    got = spark.createDataFrame([(t, s) for t, s in enumerate(salts)], "t int, s int").repartition(7, "s").select("t", F.spark_partition_id().alias("p")).collect()
    assert all(r.t == r.p for r in got)


def test_no_exchange_after_placement(skewed):
    text = skew.balanced_group_stats(skewed.where("h1 <> 7"), ["h1"], "file_idx", "line_start", "line_end")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 3


@pytest.mark.parametrize("total", [3, 119_304_648, 3_000_000_000])
def test_hot_hashes_of_tables_of_any_size(spark, tmp_path, monkeypatch, total):
    """The bound on a hot hash's rows is a 64-bit number."""
    spark.createDataFrame([(1, 1, 2, 1, 1), (2, 1, 2, 1, 1), (3, 5, 6, 1, 1)], "file_idx bigint, h1 bigint, h2 bigint, line_start int, line_end int").write.parquet(f"{tmp_path}/fingerprints.parquet")
    monkeypatch.setattr(queries, "plan_skew", lambda *a: replace(skew.plan_skew(*a), total=total))
    assert queries.p3_found(spark, str(tmp_path)).count() == (2 if total == 3 else 0)
