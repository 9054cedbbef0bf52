"""Change events as a stream: duplicates dropped within the watermark, windows, versions kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import names


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a folder, or of a pattern; a single file is named by a pattern that fits it."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return timed(reader.parquet(path))


def timed(events: DataFrame) -> DataFrame:
    """Event times without a zone become UTC instants: only these can carry a watermark."""
    local = [c for c, kind in events.dtypes if kind == "timestamp_ntz"]
    return events.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else events


def deduplicated(events: DataFrame, at: str = "ts", id: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([id])


def tumbling(events: DataFrame, width: str = "1 hour", at: str = "ts", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) of windows; a window closes when the watermark has passed it."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", at: str = "ts", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, end, n) of runs of events with gaps under `gap`."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(at, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _bump(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    version = state.get[0] if state.exists else 0
    whole = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    whole = whole.assign(version=range(version + 1, version + 1 + len(whole)))
    state.update((version + len(whole),))
    yield whole[["resource", "event_id", "ts", "version"]]


def versioned(events: DataFrame) -> DataFrame:
    """(resource, event_id, ts, version): a counter per resource kept over micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return events.select("resource", "event_id", "ts").groupBy("resource").applyInPandasWithState(_bump, "resource string, event_id long, ts timestamp, version long", "version long", "append", GroupStateTimeout.NoTimeout)


def into_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs what is available to its end into an in-memory table and returns it."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def complete_table(windows: DataFrame, at: str) -> DataFrame:
    """Runs a stream of windows over what is there, keeping all of them, and returns the table that its last micro-batch left in folder `at`. A
    micro-batch that is sent again replaces what it had written."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/batches/{batch_id:012d}")

    q = windows.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = windows.sparkSession
    done = names(spark, f"{at}/batches")
    return spark.read.schema(windows.schema).parquet(f"{at}/batches/{done[-1]}") if done else spark.createDataFrame([], windows.schema)
