"""Per-key work over keys of very uneven size: fragment-replicate by estimated load.

Loads are counted with a map-side combine. Keys heavier than a share of one
task are *heavy*; there are at most ``tasks * grain`` of them, whatever the
size of the data, so only these and one total per hash bin reach the driver.
Heavy keys are split into shards in proportion to their load; all other keys
go to hash bins. Shards and bins are packed to tasks (largest first, to the
least loaded task) and the packing goes with the plan: its size depends on
the number of tasks only. Rows are moved to the task of their shard or bin, for groups and for joins. A matching side is replicated to the shards of a
heavy key and to nothing else.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinweave.session import parallelism

#: Heavy is a key with more than 1/GRAIN of a task's fair share of the rows.
GRAIN = 4
#: Equal rows that are joined as one, at most.
PORTION = 10_000
#: Hash bins for the light keys, per task.
BINS_PER_TASK = 16

_LOAD, _KEYID, _BIN, _SHARD, _TASK = "__load", "__keyid", "__bin", "__shard", "__task"


@dataclass(frozen=True)
class SkewPlan:
    """keys: key columns; tasks: number of tasks; heavy: (key id, shards) and their task of each shard; bins: task of each hash bin; loads: of each task; total: of all rows."""

    keys: tuple[str, ...]
    tasks: int
    bins: tuple[int, ...]
    heavy: dict[int, tuple[int, ...]]
    loads: tuple[float, ...]
    total: int = 0

    @property
    def imbalance(self) -> float:
        """Largest task load over the mean."""
        mean = sum(self.loads) / max(1, len(self.loads))
        return max(self.loads, default=0) / mean if mean else 1.0


def key_id(keys: Sequence[str]) -> Column:
    """A 64-bit id of a key. Keys that share one only share a placement; grouping is by the key itself."""
    return F.xxhash64(*[F.col(k) for k in keys], *[F.col(k).isNull() for k in keys])


def pack(loads: Sequence[float], tasks: int) -> tuple[list[int], list[float]]:
    """Longest-processing-time bin packing: task of each item, load of each task."""
    heap = [(0.0, t) for t in range(tasks)]
    where, total = [0] * len(loads), [0.0] * tasks
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load, t = heapq.heappop(heap)
        where[i], total[t] = t, load + loads[i]
        heapq.heappush(heap, (total[t], t))
    return where, total


def plan_skew(df: DataFrame, keys: Sequence[str], tasks: int | None = None, load: str | None = None) -> SkewPlan:
    """Count loads (or add up those of a column), split the heavy keys, pack everything to tasks.

    An empty table gives a plan without heavy keys. Nulls in a key are a value like any other.
    """
    spark = df.sparkSession
    tasks = tasks or parallelism(spark)
    n_bins = min(tasks * BINS_PER_TASK, max(2048, 2 * tasks))
    loads = df.groupBy(key_id(keys).alias(_KEYID)).agg((F.sum(load) if load else F.count(F.lit(1))).alias(_LOAD)).persist()
    # bins first: their sum is the total, from which follows what is heavy
    by_bin = {r[0]: r[1] for r in loads.groupBy(F.pmod(F.col(_KEYID), F.lit(n_bins)).alias(_BIN)).agg(F.sum(_LOAD)).collect()}
    total = sum(by_bin.values())
    bound = max(1.0, total / (tasks * GRAIN))
    heavy = loads.where(F.col(_LOAD) > bound).collect() if max(by_bin.values(), default=0) > bound else []
    loads.unpersist()
    items: list[tuple[float, tuple[int, int] | None, int]] = []
    for r in sorted(heavy, key=lambda r: r[_KEYID]):
        shards = -(-int(r[_LOAD]) // int(bound))
        items += [(r[_LOAD] / shards, (r[_KEYID], s), -1) for s in range(shards)]
        by_bin[r[_KEYID] % n_bins] -= r[_LOAD]
    items += [(float(by_bin.get(b, 0)), None, b) for b in range(n_bins)]
    where, total_by_task = pack([x[0] for x in items], tasks)
    bins, shards_of = [0] * n_bins, {}
    for t, (_, shard, b) in zip(where, items):
        if shard is None:
            bins[b] = t
        else:
            shards_of.setdefault(shard[0], []).append(t)
    return SkewPlan(tuple(keys), tasks, tuple(bins), {k: tuple(v) for k, v in shards_of.items()}, tuple(total_by_task), int(total))


def _placement(spark: SparkSession, plan: SkewPlan) -> DataFrame:
    """(key id, tasks of its shards): a row per heavy key, at most tasks * GRAIN."""
    schema = T.StructType([T.StructField(_KEYID, T.LongType()), T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    return spark.createDataFrame([(k, list(v)) for k, v in plan.heavy.items()], schema)


def _constant(values: Sequence[int]) -> Column:
    """An array that is folded into one constant, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _bin_task(plan: SkewPlan) -> Column:
    return F.element_at(_constant(plan.bins or (0,)), (F.pmod(F.col(_KEYID), F.lit(len(plan.bins) or 1)) + 1).cast("int"))


def assign(df: DataFrame, plan: SkewPlan, spread_by: Sequence[str], replicate: bool = False) -> DataFrame:
    """Add the task (and shard) of each row: one shard by the hash of spread_by, or all shards of its key."""
    df = df.withColumn(_KEYID, key_id(plan.keys))
    if not plan.heavy:
        return df.withColumn(_SHARD, F.lit(-1)).withColumn(_TASK, _bin_task(plan))
    df = df.join(F.broadcast(_placement(df.sparkSession, plan)), _KEYID, "left")
    if replicate:
        shard = F.explode(F.when(F.col("__tasks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.size("__tasks") - 1)))
    else:
        shard = F.when(F.col("__tasks").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.size("__tasks")).cast("int"))
    df = df.withColumn(_SHARD, shard)
    return df.withColumn(_TASK, F.when(F.col(_SHARD) < 0, _bin_task(plan)).otherwise(F.element_at("__tasks", F.col(_SHARD) + 1))).drop("__tasks")


def task_salt(tasks: int) -> list[int]:
    """For each task an integer that Spark's hash partitioning sends to that partition of ``tasks``."""
    found: dict[int, int] = {}
    i = 0
    while len(found) < tasks:
        found.setdefault(_murmur3(i) % tasks, i)
        i += 1
    return [found[t] for t in range(tasks)]


def _murmur3(value: int, seed: int = 42) -> int:
    """Murmur3 x86 32 of one int, signed, as Spark's hash() has it."""
    mask = 0xFFFFFFFF
    k = (value * 0xCC9E2D51) & mask
    k = (((k << 15) | (k >> 17)) * 0x1B873593) & mask
    h = seed ^ k
    h = (((h << 13) | (h >> 19)) * 5 + 0xE6546B64) & mask
    h ^= 4
    h = ((h ^ (h >> 16)) * 0x85EBCA6B) & mask
    h = ((h ^ (h >> 13)) * 0xC2B2AE35) & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def place(df: DataFrame, plan: SkewPlan) -> DataFrame:
    """Move each row to its task: a hash partitioning of a salt chosen per task, which later groupings by (salt, ...) reuse."""
    return df.withColumn(_TASK, F.element_at(_constant(task_salt(plan.tasks)), F.col(_TASK) + 1)).repartition(plan.tasks, _TASK)


def balanced_group_stats(df: DataFrame, keys: Sequence[str], distinct: str, lo: str, hi: str, names: Sequence[str] = ("rows", "distinct_values", "first", "last"), plan: SkewPlan | None = None) -> DataFrame:
    """Rows, distinct values of a column, least ``lo`` and greatest ``hi`` per key, no task much longer than another.

    Rows move once, to the task of their shard or bin; inside a task they are
    grouped by (key, distinct value), which needs no second exchange. Light
    keys are then whole in their task. The shards of heavy keys, already
    reduced to a row per (key, distinct value), are merged by (key, distinct
    value) and then by key, again with a map-side combine.

    Rows with a null key form a group of their own; a null in ``distinct``
    counts as no value, null extents are ignored; an empty table gives no
    rows; other columns are not read, so clashing names among them don't matter.
    """
    keys = list(keys)
    n_rows, n_distinct, first, last = names
    slim = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(distinct).alias("d"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    ks = [f"k{i}" for i in range(len(keys))]
    plan = replace(plan, keys=tuple(ks)) if plan else plan_skew(slim, ks)
    placed = place(assign(slim, plan, ["d", "lo", "hi"]).drop(_KEYID), plan)
    part = placed.groupBy(_TASK, _SHARD, *ks, "d").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    whole = lambda x, *by: x.groupBy(*by).agg(F.sum("n").alias("n"), F.count("d").alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    light = whole(part.where(F.col(_SHARD) < 0), _TASK, *ks).select(*ks, "n", "m", "lo", "hi")
    out = light
    if plan.heavy:
        merged = part.where(F.col(_SHARD) >= 0).groupBy(*ks, "d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        out = light.unionByName(whole(merged, *ks))
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], F.col("n").alias(n_rows), F.col("m").alias(n_distinct), F.col("lo").alias(first), F.col("hi").alias(last))


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: SkewPlan | None = None) -> DataFrame:
    """Equi-join in which heavy keys of the left side are split and only their right rows are replicated, to their shards only.

    Both sides are moved to the task of their shard or bin, and joined there. For this the session's
    spark.sql.requireAllClusterKeysForCoPartition is set to false: else Spark would move both sides once more, by the hash of all keys.

    how: inner, left, left_semi or left_anti. Null keys match nothing, as in SQL; a
    left row then still appears in a left or anti join. Columns of the right side whose names the left side
    has too get the suffix ``_r``. Of a left side without other columns equal rows are counted and the counts joined, in
    portions of at most PORTION, so that they too can be split.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    keys = list(keys)
    plan = plan or plan_skew(left.select(*keys), keys)
    left.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    others = [c for c in left.columns if c not in keys]
    bare = not others
    names = left.columns
    if bare:
        counted = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
        portion = F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / PORTION))).alias("__portion")
        left = counted.select(*keys, "__n", portion).select(*keys, "__portion", F.least(F.lit(PORTION), F.col("__n") - F.col("__portion") * PORTION).alias("__n"))
        others = ["__portion"]
    a = place(assign(left, plan, others).drop(_KEYID), plan)
    renamed = right.select(*[F.col(c).alias(c if c in keys or c not in names else f"{c}_r") for c in right.columns])
    b = place(assign(renamed, plan, keys, replicate=True).drop(_KEYID), plan)
    out = a.join(b, [_TASK, _SHARD, *keys], how).drop(_SHARD, _TASK)
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).drop("__n", "__portion") if bare else out
