"""Session settings and the few helpers every operator shares."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str | int = "*", partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("twinweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; only an unset one gets a local folder (tests, one machine)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "twinweave-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder, so that lineage ends there and a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    """Tasks worth having at once: the wider of the cluster's cores and the session's shuffle partitions."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row-local work enough tasks.

    A table that already has as many input splits as there are cores is left
    alone, so at scale nothing is shuffled; only a small table of few
    splits is spread, by the hash of its keys.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *[F.col(k) for k in keys])


def _below(df: DataFrame, share: float, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys' 64-bit hash is in the lowest share of all hashes."""
    return df if share >= 1 else df.where(F.xxhash64(*keys) < F.lit(int(share * 2**64) - 2**63))


def draw(df: DataFrame, n: int, *keys: str, rows: int | None = None) -> list[Row]:
    """At most n rows, those whose keys have the least 64-bit hashes: the same rows at every run, whatever the size of the table.

    Only rows below a bound on the hash are sorted; the bound follows from the
    number of rows (counted where not given) and is raised until it lets half of n through or everything.
    Repeated rows count apart; an empty table gives no rows.
    """
    share = n / max(1, df.count() if rows is None else rows)
    while True:
        drawn = _below(df, share, keys).orderBy(F.xxhash64(*keys), *keys).limit(n).collect()
        if share >= 1 or 2 * len(drawn) >= n:
            return drawn
        share *= 16


def drawn(df: DataFrame, n: int, *keys: str, rows: int | None = None) -> DataFrame:
    """As draw, about n rows, not collected: for work on rows that shouldn't come to the driver."""
    share = n / max(1, df.count() if rows is None else rows)
    while share < 1 and 2 * _below(df, share, keys).limit(n).count() < n:
        share *= 16
    return _below(df, share, keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
