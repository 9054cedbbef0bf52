"""Places that driver and executors share, and tables that grow by whole commits."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a temporary one if all run in this process; on a cluster that is an error,
    as executors would not see each other's files."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
    return f"file://{_OWN[context.applicationId]}"


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; it goes with the session."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, path = _fs(spark, at)
    fs.deleteOnExit(path)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes to the shared folder and reads again: what is read more than once is made once, and lineage ends there."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, at: str) -> bool:
    fs, path = _fs(spark, at)
    return bool(fs.delete(path, True))


def names(spark: SparkSession, at: str) -> list[str]:
    """What a folder holds, without hidden names; empty if there is no such folder."""
    fs, path = _fs(spark, at)
    return sorted(x.getPath().getName() for x in fs.listStatus(path) if x.getPath().getName()[0] not in "._") if fs.exists(path) else []


class Log:
    """A table that grows by named commits. A commit is written beside and then renamed, so readers see all of it or nothing; a name that
    is there already stays as it is, so that a commit sent again changes nothing. Commits are numbered in order: `seq`."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def commits(self) -> dict[str, int]:
        """Names of commits with their numbers."""
        return {x[9:]: int(x[:8]) for x in names(self.spark, self.path)}

    def has(self, name: str) -> bool:
        return name in self.commits()

    def commit(self, name: str, rows: DataFrame) -> bool:
        """False if the name was there. One writer at a time: two that race for a number don't overwrite each other, the later rename fails."""
        done = self.commits()
        if name in done:
            return False
        beside = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.select(*[x.split()[0] for x in self.schema.split(", ")]).coalesce(2 * self.spark.sparkContext.defaultParallelism).write.parquet(beside)
        fs, path = _fs(self.spark, beside)
        to = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{max(done.values(), default=0) + 1:08d}-{name}")
        if fs.exists(to) or not fs.rename(path, to):
            raise RuntimeError(f"commit {name} lost a race")
        return True

    def read(self) -> DataFrame:
        """All rows with `seq`, the number of their commit."""
        from pyspark.sql import functions as F

        found = names(self.spark, self.path)
        if not found:
            return self.spark.createDataFrame([], f"{self.schema}, seq int")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{x}" for x in found])
        return rows.withColumn("seq", F.regexp_extract(F.col("_metadata.file_path"), r"/(\d{8})-[^/]*/[^/]*$", 1).cast("int"))
