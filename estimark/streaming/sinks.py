"""The idempotent append sink for ``foreachBatch``.

Parquet has no MERGE, so a keyed table is a log of changed rows: a micro-batch
appends the rows it changes, a read takes the latest row per key (``max_by`` on
the batch).  A batch that is replayed after a failure overwrites exactly its
own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from estimark.session import scratch_folder


def scratch_root(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream under the shared checkpoint folder (never machine-local on a cluster: it is
    whatever ``spark.checkpoint.dir`` names)."""
    return scratch_folder(spark, name)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class AppendTable:
    """Append-only table: batch ``i`` is written to its own folder, so a replay
    of the batch overwrites exactly its own rows."""

    def __init__(self, root: str, partition_by: Sequence[str] = ()):
        self.root = root.rstrip("/")
        self.partition_by = list(partition_by)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        w = batch.write.mode("overwrite")
        if self.partition_by:
            w = w.partitionBy(*self.partition_by)
        w.parquet(f"{self.root}/batch_id={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("basePath", self.root).parquet(f"{self.root}/batch_id=*")
