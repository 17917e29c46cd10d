"""Tables that outlive executors: written to shared storage and read back, which cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.corvid.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corvid-")
        spark.conf.set("spark.corvid.scratch", folder)
    return folder.rstrip("/")


#: Spark's own setting that drops the shuffle files of an execution when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write a table; nothing reads its plan again, so its shuffle files go at once and not when a cleaner runs."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file system, wherever they are."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Materialised tables of one run, by name; a name that is written again replaces its table once that is done."""

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark, self.prefix, self.paths = spark, prefix, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{self.prefix}-{name}-{uuid.uuid4().hex}"
        _write(df, path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            remove(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *names: str) -> None:
        """Delete the tables of these names, all where none is given."""
        remove(self.spark, *[self.paths.pop(n) for n in names or list(self.paths) if n in self.paths])
