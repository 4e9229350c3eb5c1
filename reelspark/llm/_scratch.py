"""Tables written between the steps of one operator call.

They lie under ``spark.checkpoint.dir``, which every executor shares, so a lost
executor costs a re-read and never a recomputation from the start. What no step has
dropped goes when the driver ends, as results may read it until then.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one is made only in local mode, where one machine does all (tests, laptops)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), f"reelspark-{os.getpid()}")


class Scratch:
    """Names and holds the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.tag = f"{label}_{uuid.uuid4().hex[:12]}"
        self.root = f"{shared_dir(spark).rstrip('/')}/{self.tag}"
        self.tables: list[str] = []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))  # only what is there can be marked
        self._fs.deleteOnExit(self._path(self.root))

    def stage(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns the written table, with its lineage cut."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, key: str | list[str], buckets: int, name: str, deal: bool = True) -> DataFrame:
        """Writes ``df`` bucketed on ``key`` (one column or more): later joins on that key move only their other side.

        Without ``deal`` rows are written by the tasks that have them, in place of a
        shuffle; for keys that stay within one task. There are no more buckets than the
        session allows; a bucket then holds more.
        """
        table = f"{self.tag}_{name}"
        buckets = min(buckets, int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
        keys = [key] if isinstance(key, str) else key
        dealt = df.repartition(buckets, *keys) if deal else df
        dealt.write.bucketBy(buckets, *keys).format("parquet").option("compression", "zstd").mode("overwrite").saveAsTable(table)
        self.tables.append(table)
        place = self._path(self.spark.conf.get("spark.sql.warehouse.dir"), table)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        """Deletes staged tables that no later step reads."""
        for name in names:
            if f"{self.tag}_{name}" in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.tag}_{name}")
            self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def release(self) -> None:
        """Has Spark delete the shuffle files of finished steps now: it does so once the driver has collected its garbage, what Python held in a second pass."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)
