"""A consumer of change events: each micro-batch brings resources to new versions in tables, once, however often it is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import cdc
from ..storage import Log

RESULT = "event_id string, resource_path string, operation string, timestamp double, version long, chunks_affected long, entities_affected long, content string"
BASE = "resource_path string, version long, upto int"


class ChangeConsumer:
    """Tables in a folder: `results`, a commit for each micro-batch named by its id, and `bases`, versions of all resources as of a commit.

    A batch that is sent again finds its commit and changes nothing, so a stream restarted from its checkpoint counts no event twice. The version
    that a batch starts from is the largest of the last base and the commits after it, of the batch's resources only; each BASES-th commit makes
    a base, so that a batch never reads more than so many commits."""

    BASES = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.log, self.bases = Log(spark, f"{path}/results", RESULT), Log(spark, f"{path}/bases", BASE)

    def versions(self) -> DataFrame:
        """(resource_path, version): the version that each resource is at."""
        base = self.bases.read()
        last = base.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s"), F.coalesce(F.max("upto"), F.lit(0)).alias("u")).first()
        old = base.where(F.col("seq") == last.s).select("resource_path", "version")
        new = self.log.read().where(F.col("seq") > last.u).select("resource_path", "version")
        return old.unionByName(new).groupBy("resource_path").agg(F.max("version").alias("version"))

    def process(self, events: DataFrame, batch_id: int) -> None:
        """Takes a micro-batch of events (event_id, operation, resource_path, timestamp, before, after)."""
        name = f"{batch_id:012d}"
        if self.log.has(name):
            return
        before = self.versions().join(events.select("resource_path").distinct(), "resource_path", "left_semi").withColumnRenamed("version", "was")
        told = cdc.line_diff(events.withColumns({"_b": F.col("before")["content"], "_a": F.col("after")["content"]}), "_b", "_a")
        told = cdc.versions(told).join(before, "resource_path", "left")
        filled = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
        op = F.col("operation")
        self.log.commit(name, told.select(
            "event_id", "resource_path", "operation", "timestamp", (F.col("version") + F.coalesce("was", F.lit(0))).alias("version"),
            cdc.impact(op, F.col("added_count"), F.col("is_major_change"), filled("before") & filled("after")).alias("chunks_affected"), cdc.entities(op).alias("entities_affected"), F.col("_a").alias("content"),
        ))
        number = self.log.commits()[name]
        if number % self.BASES == 0:
            self.bases.commit(name, self.versions().withColumn("upto", F.lit(number)))

    def start(self, events: DataFrame, checkpoint: str, **trigger):
        """The running query of a stream of events; by default it takes what is there and ends."""
        return events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def results(self) -> DataFrame:
        return self.log.read().drop("seq")

    def current(self) -> DataFrame:
        """(resource_path, version, content) of resources whose last change isn't a delete."""
        last = self.log.read().groupBy("resource_path").agg(F.max_by(F.struct("operation", "version", "content"), "version").alias("l"))
        return last.where("l.operation <> 'DELETE'").select("resource_path", "l.version", "l.content")
