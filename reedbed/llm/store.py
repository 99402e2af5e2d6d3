"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of our own on a local master (tests), and an
    error on a cluster, whose executors would not see it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("reedbed.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="reedbed-")
        spark.conf.set("reedbed.shared.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """One job's intermediate tables. They are written as Parquet, which cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that keep() returned and no later step reads."""
        for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            self._delete(file)

    def _delete(self, path: str) -> None:
        if not path.startswith(self.root) and self.root.split("://")[-1] not in path:
            raise ValueError(f"{path} is not in this workspace")
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
