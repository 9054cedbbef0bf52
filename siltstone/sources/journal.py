"""Append-only journals of events with unique ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "schema string, event_id string, run_id string, document_id string, version int, stage string, event_kind string, subject string, predicate string, object string, direction string, source string, reason string, timestamp double"
#: Fixed values.
STAGES = ("extracted", "normalized", "persisted", "scope_rejected")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def problems(events: DataFrame, schema: str) -> DataFrame:
    """(event_id, problem): other schemas, unknown stages, ids that occur twice."""
    a = events.where(F.coalesce(F.col("schema") != schema, F.lit(True))).select("event_id", F.lit("schema").alias("problem"))
    b = events.where(~F.col("stage").isin(*STAGES)).select("event_id", F.lit("stage"))
    return a.union(b).union(events.groupBy("event_id").count().where("count > 1").select("event_id", F.lit("repeated")))


def new_events(events: DataFrame, journal: DataFrame) -> DataFrame:
    """Events that the journal lacks, each once: appending these twice changes nothing."""
    return events.dropDuplicates(["event_id"]).join(journal.select("event_id"), "event_id", "left_anti")


def of_documents(events: DataFrame, allowed: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    return events.where(F.col("stage").isin(*stages)).join(allowed.select("document_id").distinct(), "document_id", "left_semi")
