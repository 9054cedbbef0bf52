"""Change events: decoding, line differences, impact and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "event_id string, source_type string, operation string, resource_path string, timestamp double, before map<string,string>, after map<string,string>"
#: Codes of change data capture and of file systems; the codes c, u, d and r are mapped, too.
OPERATIONS = {"c": "INSERT", "r": "INSERT", "u": "UPDATE", "d": "DELETE", "created": "INSERT", "modified": "UPDATE", "deleted": "DELETE", "insert": "INSERT", "update": "UPDATE", "delete": "DELETE"}


def operation(c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])[F.lower(c)], F.upper(c))


def decoded(raw: DataFrame, value: str = "value") -> DataFrame:
    """Events from JSON bytes with id, op, ts_ms, source and before/after. Without an id the message's hash stands for it, without
    an operation it is an update, without a table `unknown`, and without a time that of decoding."""
    schema = "id string, op string, ts_ms double, source struct<table:string>, before map<string,string>, after map<string,string>"
    e = raw.select(F.col(value).cast("string").alias("raw")).withColumn("e", F.from_json("raw", schema))
    return e.select(
        F.coalesce(F.col("e.id"), F.substr(F.sha2("raw", 256), F.lit(1), F.lit(16))).alias("event_id"), F.lit("database").alias("source_type"),
        operation(F.coalesce(F.col("e.op"), F.lit("UPDATE"))).alias("operation"), F.coalesce(F.col("e.source.table"), F.lit("unknown")).alias("resource_path"),
        F.coalesce(F.col("e.ts_ms") / 1000, F.unix_millis(F.current_timestamp()) / 1000).alias("timestamp"), F.col("e.before").alias("before"), F.col("e.after").alias("after"),
    )


def from_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A stream of events from the latest offset; needs the Kafka package on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return decoded(raw)


#: Fixed value: what ends a line, besides the two characters of a carriage return and a line feed, which are one end.
LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def lines(c: Column) -> Column:
    """All ends are made line feeds first, by replacing plain strings, so that one split is left; a feed at the very end ends the last line."""
    plain = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), LINE_ENDS, "\n" * len(LINE_ENDS))
    whole = F.when(plain.endswith("\n"), F.substr(plain, F.lit(1), F.char_length(plain) - 1)).otherwise(plain)
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\n", -1))


def line_diff(df: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Adds added_count, removed_count, change_ratio (4 places) and is_major_change (over 0.3): distinct lines of one side only."""
    b, a = lines(F.col(before)), lines(F.col(after))
    add, gone = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    ratio = (add + gone) / F.greatest(F.size(b) + F.size(a), F.lit(1))
    return df.withColumns({"added_count": add.cast("long"), "removed_count": gone.cast("long"), "change_ratio": F.round(ratio, 4), "is_major_change": ratio > 0.3})


def impact(operation: Column, added: Column, major: Column, has_both: Column) -> Column:
    """Chunks affected: 1, -1, or what an update adds (a tenth of it, at least 1, if minor; 0 without both sides)."""
    update = F.when(~has_both, F.lit(0)).when(major, added).otherwise(F.greatest(F.lit(1), F.floor(added / 10)))
    return F.when(operation == "DELETE", F.lit(-1)).when(operation == "INSERT", F.lit(1)).when(operation == "UPDATE", update).otherwise(F.lit(0)).cast("long")


def entities(operation: Column) -> Column:
    """Entities affected: one gone, one come, none."""
    return F.when(operation == "DELETE", -1).when(operation == "INSERT", 1).otherwise(0).cast("long")


def versions(events: DataFrame, resource: str = "resource_path", at: str = "timestamp", id: str = "event_id") -> DataFrame:
    """Each event with the version that it brings its resource to: every event counts."""
    return events.withColumn("version", F.row_number().over(Window.partitionBy(resource).orderBy(at, id)).cast("long"))


def statistics(events: DataFrame, resource: str = "resource_path") -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"), F.countDistinct(resource).alias("tracked_resources"))


def history(events: DataFrame, n: int, at: str = "timestamp", id: str = "event_id") -> DataFrame:
    """The last n events, oldest first."""
    return events.orderBy(F.col(at).desc(), F.col(id).desc()).limit(n).orderBy(at, id)
