"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Unset, a local session gets a temporary folder; on a cluster that would be
    local to one machine, so it is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster[...] has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Stage:
    """Intermediate tables of one run, as Parquet in the shared folder.

    A written table cuts the lineage: a lost executor costs a reread, not a
    rerun. ``drop`` and ``keep`` remove tables once all that reads them is written.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/tessera-{what}-{uuid.uuid4().hex[:12]}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._hadoop.Path(f"{self.path}/{name}")
            path.getFileSystem(self._conf).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        path = self._hadoop.Path(self.path)
        found = [f.getPath().getName() for f in path.getFileSystem(self._conf).listStatus(path)]
        self.drop(*(x for x in found if x not in names))

    @property
    def _hadoop(self):
        return self.spark._jvm.org.apache.hadoop.fs

    @property
    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
