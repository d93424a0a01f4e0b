"""Changes of files as a stream."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from twinweave.operators.incremental import changed_files, manifest


def _listing(directory: str) -> dict[str, list]:
    out = {}
    for root, dirs, files in os.walk(directory):
        dirs[:] = sorted(d for d in dirs if not d.startswith("."))
        for f in sorted(files):
            if not f.startswith("."):
                p = os.path.join(root, f)
                try:
                    s = os.stat(p)
                except OSError:
                    continue
                out[os.path.relpath(p, directory)] = [s.st_mtime_ns, s.st_size]
    return out


class _Reader(SimpleDataSourceStreamReader):
    """Compares listings; the offset is the last listing."""

    def __init__(self, directory: str) -> None:
        self.directory = directory

    def initialOffset(self) -> dict:
        return {"files": {}}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = _listing(self.directory)
        return iter(self._between(start["files"], now)), {"files": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._between(start["files"], end["files"]))

    @staticmethod
    def _between(old: dict, new: dict) -> list[tuple]:
        out = [(p, "created" if p not in old else "modified", s[0], s[1]) for p, s in new.items() if old.get(p) != s]
        return out + [(p, "deleted", old[p][0], 0) for p in old if p not in new]


class DirectoryChanges(DataSource):
    """Streaming source ``directory_changes``: (path, change, mtime_ns, size) of files created, modified or deleted under option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return "path string, change string, mtime_ns bigint, size bigint"

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def watch(spark: SparkSession, directory: str) -> DataFrame:
    """A stream of the changes under a directory."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("path", directory).load()


def rescan_changed(state_dir: str, handle: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch, over batches of (path, content): hands files on whose content isn't the known one, then stores the new manifest.

    Each batch writes a manifest of its own under state_dir; a file's last one holds.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        # by Hadoop's file systems, as the manifests are written
        place = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = sorted(x.getPath().toString() for x in store.listStatus(place)) if store.exists(place) else []
        df = df.dropDuplicates(["path"]).persist()
        try:
            old = spark.read.parquet(*known) if known else spark.createDataFrame([], "path string, sha256 string, batch bigint")
            last = old.selectExpr("path", "struct(batch, sha256) AS s").groupBy("path").agg({"s": "max"}).selectExpr("path", "`max(s)`.sha256 AS sha256")
            handle(changed_files(df, last).drop("sha256"))
            manifest(df).selectExpr("path", "sha256", f"{batch_id}L AS batch").write.mode("overwrite").parquet(f"{state_dir}/batch={batch_id:09d}.parquet")
        finally:
            df.unpersist()

    return batch
