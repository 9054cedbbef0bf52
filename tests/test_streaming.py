"""Streams give what the batch gives."""

from pyspark.sql import functions as F

from siltstone.streaming import cdc as stream


def test_tumbling_and_dedupe(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    path = str(tmp_path / "in")
    events.repartition(3).write.parquet(path)
    s = stream.deduplicated(stream.event_stream(spark, path, events.schema, 1), late="60 days")
    got = stream.into_table(s, "deduped", str(tmp_path / "c1"))
    assert got.count() == events.select("event_id").distinct().count()
    t = stream.tumbling(stream.event_stream(spark, path, events.schema), late="0 seconds")
    seen = stream.into_table(t, "windows", str(tmp_path / "c2"), "complete")
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(seen) == key(stream.tumbling(stream.timed(events)))


def test_versions_as_state(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumnRenamed("user_id", "resource").withColumn("resource", F.col("resource").cast("string"))
    path = str(tmp_path / "in")
    events.orderBy("ts", "event_id").coalesce(1).write.parquet(path)
    got = stream.into_table(stream.versioned(stream.event_stream(spark, path, events.schema)), "versions", str(tmp_path / "c"))
    from siltstone.sources import cdc

    want = cdc.versions(events, "resource", "ts")
    assert sorted((r.event_id, r.version) for r in got.collect()) == sorted((r.event_id, r.version) for r in want.collect())
