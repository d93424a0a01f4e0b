"""Mixing sources to target weights by weighted fair queueing.

Every source's records are put into a random order, pass after pass up to its
number of repeats. A record's virtual finish time is the number of its
source's tokens up to and with it, divided by the source's target weight. All
records sorted by finish time, cut at the total budget, are the mix: at any
point of it each source that isn't used up has had its share, but for a part
of one record.

Running sums are taken in two steps, inside buckets and over the buckets'
totals, so no source, however large, is sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinweave.llm.encode import TOKENIZERS, VOCABULARY, count_tokens
from twinweave.session import cut

#: Records in a bucket of a running sum.
BUCKET_ROWS = 20_000
#: Most rows of targets that the planner takes to the driver.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    source: str
    weight: float
    repeats: int
    records: int
    tokens: int
    largest: int = 0

    @property
    def most(self) -> int:
        return self.tokens * self.repeats


def running_sum(df: DataFrame, groups: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add out, the sum of value up to and with a row, in each group in the given order; bucket must ascend with it."""
    df = df.withColumn("__bucket", bucket)
    by = [*groups, "__bucket"]
    totals = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    before = totals.withColumn("__before", F.sum("__total").over(Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__total")
    inside = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__inside", inside).join(before, by).withColumn(out, F.col("__inside") + F.coalesce("__before", F.lit(0))).drop("__bucket", "__inside", "__before")


def full_target_budget(sources: list[Source]) -> int:
    """The largest total at which every source that has tokens can have its weight; the weights of the others are shared out."""
    live = [s for s in sources if s.most > 0 and s.weight > 0]
    total = sum(s.weight for s in live)
    return int(min((s.most * total / s.weight for s in live), default=0))


def reach_time(sources: list[Source], total: float) -> float:
    """The virtual time at which the sources together have given total tokens; infinite if they never do."""
    live = sorted((s.most / s.weight, s.weight) for s in sources if s.most > 0)
    now = given = 0.0
    for i, (end, _) in enumerate(live):
        rate = sum(w for _, w in live[i:])
        if given + (end - now) * rate >= total:
            return now + (total - given) / rate
        given += (end - now) * rate
        now = end
    return float("inf")


def plan_sources(sized: DataFrame, targets: DataFrame) -> list[Source]:
    """What each row of targets asks and what its source has; a source named twice counts once, with its largest weight and repeats."""
    asked = targets.where(F.col("source").isNotNull() & (F.col("target_weight") > 0)).groupBy("source").agg(F.max("target_weight").alias("weight"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
    has = sized.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    rows = asked.join(has, "source", "left").collect()
    return sorted((Source(r["source"], float(r["weight"]), max(0, int(r["repeats"])), r["records"] or 0, r["tokens"] or 0, r["largest"] or 0) for r in rows), key=lambda s: s.source)


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 0, folder: str = TOKENIZERS, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(the mix, the shares).

    The mix has a row per use of a record: doc_id, source, pass (0 for the
    first use), n_tokens, finish_time and end_token, the size of the mix up to
    and with it, by which it is ordered. The shares have a row per target:
    source, target_weight, max_repeats, available_tokens, records, tokens,
    share.

    total_tokens None: the largest total at which every target can be met. A
    larger total takes from the sources that have more, a smaller one cuts
    earlier. Documents of no target (a null source among them) are not used;
    null and empty texts are records of no tokens. Empty tables give an empty mix and
    shares of 0. Equal doc_ids are ordered by size and are otherwise alike.
    """
    spark = documents.sparkSession
    wanted = targets.where(F.col("target_weight") > 0).select("source").distinct()
    if wanted.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    used = documents.select("doc_id", "source", "text").join(F.broadcast(wanted), "source", "left_semi")
    sized = cut(count_tokens(used, ["doc_id", "source"], folder=folder, name=name))
    sources = plan_sources(sized, targets)
    budget = full_target_budget(sources) if total_tokens is None else int(total_tokens)
    plan = spark.createDataFrame([(s.source, s.weight, s.repeats, s.tokens, s.records) for s in sources], "source string, weight double, repeats int, supply bigint, n_records bigint")
    # a pass that starts after the source alone has filled the whole budget is never reached
    passes = F.sequence(F.lit(0), F.least(F.col("repeats") - 1, F.ceil(F.lit(budget) / F.greatest("supply", F.lit(1))).cast("int")))
    uses = sized.join(F.broadcast(plan.where("repeats > 0")), "source").withColumn("pass", F.explode(passes))
    uses = uses.withColumn("key", F.xxhash64("doc_id", "n_tokens", "pass", F.lit(seed)))
    # sources of empty texts only: all at the start, where they take nothing
    nothing = uses.where("supply = 0").select("doc_id", "source", "pass", "n_tokens", F.lit(0.0).alias("finish_time"), F.lit(0).cast("bigint").alias("end_token"))
    uses = uses.where("supply > 0")
    n_buckets = F.ceil(F.col("n_records") / BUCKET_ROWS)
    bucket = F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * n_buckets)
    uses = running_sum(uses, ["source", "pass"], bucket, ["key", "doc_id", "n_tokens"], "n_tokens", "in_pass")
    uses = uses.withColumn("finish_time", (F.col("pass") * F.col("supply") + F.col("in_pass")) / F.col("weight"))
    # a source lags by less than a record, so nothing later than this can be within the budget
    last = reach_time(sources, budget + 1 + sum(s.largest for s in sources))
    uses = uses.where(F.col("finish_time") <= last)
    last = min(last, max((s.most / s.weight for s in sources if s.most), default=1.0))
    n_uses = sum((s.tokens > 0) * s.records * min(s.repeats, last * s.weight / max(1, s.tokens)) for s in sources)
    step = last / max(1, n_uses // BUCKET_ROWS)
    uses = running_sum(uses.withColumn("__all", F.lit(0)), ["__all"], F.floor(F.col("finish_time") / step), ["finish_time", "source", "pass", "key", "doc_id", "n_tokens"], "n_tokens", "end_token")
    chosen = uses.where(F.col("end_token") <= budget).select("doc_id", "source", "pass", "n_tokens", "finish_time", "end_token").unionByName(nothing)
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("n_tokens").alias("tokens"))
    all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy())
    shares = plan.join(got, "source", "left").select(
        "source", F.col("weight").alias("target_weight"), F.col("repeats").alias("max_repeats"), (F.col("supply") * F.col("repeats")).alias("available_tokens"),
        F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0)).alias("share"),
    )
    return chosen, shares
