"""Operations on documents: failures at every step, crashes, leases, recovery; migrations that are resumed; streams sent again; state with timers."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone import storage
from siltstone.plans import docstore, versions
from siltstone.streaming import cdc as stream
from siltstone.streaming import consumer, timers

NOW = "2026-01-01 00:00:00"
OPS = "operation_id string, operation_type string, document_id long, version long, previous_version long, n_chunks long, n_vectors long"


def at(text=NOW):
    return F.lit(text).cast("timestamp")


def content(spark, version, docs, lost=()):
    rows = [(d, version, f"text {d} {version} {k}") for d in docs for k in range(2)]
    df = spark.createDataFrame(rows, "document_id long, version long, content string")
    return {"catalog": df, "vectors": df.where(~F.col("document_id").isin(*lost, -1)), "graph": df.withColumn("evidence_key", F.md5("content")).drop("content")}


def held(store):
    return sorted((r.store, r.document_id, r.version, r.status, r.is_current) for r in store.states().collect())


def loaded(spark, tmp_path, docs):
    store = docstore.DocumentStore(spark, f"file://{tmp_path}/store")
    got = store.run("load", spark.createDataFrame([(str(d), "create", d, 1, None, 2, 2) for d in docs], OPS), content(spark, 1, docs), at())
    assert {r.status for r in got.collect()} == {"succeeded"}
    return store


def refuse(doc):
    return lambda alive: alive.where(F.col("document_id") == doc)


def test_failure_at_every_step_leaves_the_old_version_in_force(spark, tmp_path):
    steps = docstore.UPDATE[1:]
    docs = list(range(len(steps) + 2))
    store = loaded(spark, tmp_path, docs)
    fine, short = len(steps), len(steps) + 1
    ops = spark.createDataFrame([(str(d), "update", d, 2, 1, 2, 3 if d == short else 2) for d in docs], OPS)
    got = {r.operation_id: r.status for r in store.run("change", ops, content(spark, 2, docs), at(), {s: refuse(d) for d, s in enumerate(steps)}).collect()}
    assert got == {str(d): "succeeded" if d == fine else "failed" for d in docs}
    for d in docs:
        own = [x for x in held(store) if x[1] == d]
        if d == fine:
            assert {x[2]: x[4] for x in own} == {1: False, 2: True}
        else:
            assert {(s, v, status, now) for s, _, v, status, now in own} == {(s, 1, "ready", True) for s in ("registry", *docstore.STORES)} | {("registry", 2, "failed", False)}
            assert {r.version for r in store.rows("catalog", current=True).where(F.col("document_id") == d).collect()} == {1}
    done = {r.operation_id: r for r in store.operations().collect()}
    assert done[f"change/{steps.index('chunk_activated')}"].compensated == [
        "graph_deactivated", "vector_deactivated", "graph_stage_deleted", "vector_stage_deleted", "chunk_stage_deleted", "previous_vector_restored", "previous_graph_restored"]
    assert store.vacuum("catalog") == 1 and store.vacuum("catalog") == 0
    assert store._files("catalog").where("version = 2").count() == 2 and store.rows("catalog", current=True).count() == 2 * len(docs)


@pytest.mark.parametrize("where", ["change-vector_staged", "change-graph_staged", "change-undone"])
def test_a_crash_is_resumed(spark, tmp_path, monkeypatch, where):
    docs = [1, 2, 3]
    ops = spark.createDataFrame([(str(d), "update", d, 2, 1, 2, 2) for d in docs], OPS)
    checks = {"mongo_ready": refuse(2)}
    store = loaded(spark, tmp_path, docs)
    commit = storage.Log.commit

    def crash(self, name, rows):
        if name == where:
            raise RuntimeError("lost the driver")
        return commit(self, name, rows)

    monkeypatch.setattr(storage.Log, "commit", crash)
    with pytest.raises(RuntimeError):
        store.run("change", ops, content(spark, 2, docs), at(), checks)
    monkeypatch.setattr(storage.Log, "commit", commit)
    again = docstore.DocumentStore(spark, store.path)
    got = {r.operation_id: r.status for r in again.run("change", ops, content(spark, 2, docs), at(), checks).collect()}
    assert got == {"1": "succeeded", "2": "failed", "3": "succeeded"}
    assert {(x[1], x[2]) for x in held(again) if x[4]} == {(1, 2), (2, 1), (3, 2)}
    once = held(again)
    again.run("change", ops, content(spark, 2, docs), at(), checks)
    assert held(again) == once and again.rows("graph").count() == 10


def test_deletes_go_forward_and_leases_hold(spark, tmp_path):
    docs = [1, 2, 3, 4]
    store = loaded(spark, tmp_path, docs)
    ops = spark.createDataFrame([(str(d), "delete", d, 1, 1, 0, 0) for d in docs[:3]], OPS)
    got = {r.operation_id: r.status for r in store.run("gone", ops, {}, at(), {"vector_cleaned": refuse(2), "graph_deactivated": refuse(3)}).collect()}
    assert got == {"1": "succeeded", "2": "cleanup_pending", "3": "running"}
    assert {x[0] for x in held(store) if x[1] == 1} == {"registry"} and not [x for x in held(store) if x[1] == 2 and x[0] != "registry" and x[4]]
    busy = spark.createDataFrame([("x", "update", 3, 2, 1, 2, 2), ("y", "update", 4, 2, 1, 2, 2), ("z", "update", 4, 2, 1, 2, 2)], OPS)
    assert [r.operation_id for r in store.run("late", busy, content(spark, 2, [4]), at()).collect()] == ["y"]  # 3 is leased, and 4 has one operation
    before = held(store)
    store.recover("r1", at(), spark.createDataFrame([(2, "graph_cleaned")], "document_id long, step string"))
    status = {r.operation_id: r.status for r in store.operations().collect()}
    assert status["gone/3"] == "running" and status["gone/2"] == "cleanup_pending"  # the lease runs; the graph can't be reached
    assert {x[0] for x in held(store) if x[1] == 2} == {"registry", "graph", "catalog"}
    store.recover("r2", at("2026-01-01 01:00:00"))
    status = {r.operation_id: r.status for r in store.operations().collect()}
    assert status["gone/3"] == "failed" and status["gone/2"] == "succeeded" and {x[0] for x in held(store) if x[1] == 2} == {"registry"}
    after = held(store)
    assert after != before
    store.recover("r2", at("2026-01-01 01:00:00"))
    store.recover("r3", at("2026-01-01 02:00:00"))
    assert held(store) == after


def test_restoring_what_is_gone_needs_reconciliation(spark):
    ops = spark.createDataFrame([("a", "update", 1, 2, 1, "running", ["mongo_reserved", "vector_staged", "vector_activated"], [])],
                                "operation_id string, operation_type string, document_id long, version long, previous_version long, status string, completed array<string>, compensated array<string>")
    state = spark.createDataFrame([("registry", 1, 2, "processing")], "store string, document_id long, version long, status string")
    locks = spark.createDataFrame([], "document_id long, operation_id string, expires_at timestamp")
    got = docstore.recovery(ops, state, locks, at()).first()
    assert (got.action, got.new_status, got.steps) == ("compensate", "needs_reconciliation", ["vector_deactivated", "vector_stage_deleted"])
    both = state.unionByName(spark.createDataFrame([("vectors", 1, 1, "ready")], state.schema))
    got = docstore.recovery(ops, both, locks, at()).first()
    assert (got.new_status, got.steps[-2:]) == ("failed", ["previous_vector_restored", "mongo_failed"])


def test_migration_is_resumed(spark, tmp_path):
    source = spark.range(1000).select("id", F.md5(F.col("id").cast("string")).alias("h"))
    change = lambda rows: rows.withColumn("twice", F.col("id") * 2)
    m = versions.Migration(spark, f"file://{tmp_path}/a")
    assert m.run(source, 6, change=change, most=2) == 2 and 0 < m.rows().count() < 1000
    again = versions.Migration(spark, f"file://{tmp_path}/a")
    assert again.run(source, 6, change=change) == 4 and again.run(source, 6, change=change) == 0
    whole = versions.Migration(spark, f"file://{tmp_path}/b")
    whole.run(source, 6, change=change)
    assert sorted(again.rows().collect()) == sorted(whole.rows().collect()) and again.rows().count() == 1000
    assert {r.same for r in again.verify(["id", "h", "twice"]).collect()} == {True}
    for other in (source.where("id > 5"), source.withColumn("h", F.lit("x"))):
        with pytest.raises(ValueError):
            again.run(other, 6)


EVENT = "event_id string, operation string, resource_path string, timestamp double, before map<string,string>, after map<string,string>"


def test_consumer_takes_a_batch_once(spark, tmp_path):
    one = [("1", "INSERT", "a", 1.0, None, {"content": "x"}), ("2", "UPDATE", "a", 2.0, {"content": "x"}, {"content": "x\ny\nz"}), ("3", "INSERT", "b", 1.0, None, {"content": "b"})]
    two = [("4", "DELETE", "b", 3.0, {"content": "b"}, None), ("5", "UPDATE", "a", 4.0, {"content": "x"}, None)]
    c = consumer.ChangeConsumer(spark, f"file://{tmp_path}/c")
    for rows, n in ((one, 0), (two, 1), (two, 1), (one, 0)):
        c.process(spark.createDataFrame(rows, EVENT), n)
    got = {r.event_id: (r.version, r.chunks_affected, r.entities_affected) for r in c.results().collect()}
    assert got == {"1": (1, 1, 1), "2": (2, 2, 0), "3": (1, 1, 1), "4": (2, -1, -1), "5": (3, 0, 0)}
    assert {(r.resource_path, r.version) for r in c.versions().collect()} == {("a", 3), ("b", 2)} and [r.resource_path for r in c.current().collect()] == ["a"]


def test_consumer_goes_on_from_its_checkpoint(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(consumer.ChangeConsumer, "BASES", 2)
    c = consumer.ChangeConsumer(spark, f"file://{tmp_path}/c")
    made = []
    for k in range(5):
        rows = [(f"{k}-{i}", "UPDATE", f"r{i % 2}", float(k), None, {"content": "x"}) for i in range(4)]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made += rows
        events = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        c.start(events, f"{tmp_path}/check").awaitTermination()
    assert c.results().count() == len(made) and c.bases.commits()
    assert {(r.resource_path, r.version) for r in c.versions().collect()} == {("r0", 10), ("r1", 10)}
    assert sorted(r.version for r in c.results().where("resource_path = 'r0'").collect()) == list(range(1, 11))


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@pytest.fixture
def state_store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    rocks(spark)
    yield
    spark.conf.set(key, before)


def files(spark, rows, schema, path, n):
    """The rows as n files in order of time, and a last one far in the future."""
    for k in range(n):
        part = rows[k * len(rows) // n : (k + 1) * len(rows) // n]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_leases_end_by_event_time(spark, tmp_path, state_store):
    import datetime

    rng = random.Random(4)
    start = datetime.datetime(2026, 1, 1)
    rows = [(rng.randrange(4), f"w{rng.randrange(3)}", rng.choice(["acquire", "acquire", "release"]), start + datetime.timedelta(seconds=20 * k), rng.choice([10, 60, 200])) for k in range(60)]
    end = [(99, "w", "release", start + datetime.timedelta(days=1), 0)]
    path = str(tmp_path / "in")
    files(spark, rows, timers.WANTS, path, 3)
    files(spark, end, timers.WANTS, path, 1)
    events = spark.readStream.schema(timers.WANTS).option("maxFilesPerTrigger", 1).parquet(path)
    got = stream.into_table(timers.lease_stream(events), "leases", str(tmp_path / "c"))
    want = timers.lease_outcomes(spark.createDataFrame(rows + end, timers.WANTS), "2026-01-02 00:00:00")
    key = lambda df: sorted((r.document_id, r.operation_id, r["at"], r.outcome) for r in df.collect())
    assert key(got) == key(want) and {r[3] for r in key(want)} == {"granted", "renewed", "busy", "released", "not_held", "expired"}


def test_entries_end_by_event_time(spark, tmp_path, state_store):
    import datetime

    rng = random.Random(5)
    start = datetime.datetime(2026, 1, 1)
    schema = "key long, at timestamp"
    rows = sorted([(rng.randrange(3), start + datetime.timedelta(seconds=rng.randrange(4000))) for _ in range(50)], key=lambda r: r[1])
    path = str(tmp_path / "in")
    files(spark, rows, schema, path, 2)
    files(spark, [(9, start + datetime.timedelta(days=1))], schema, path, 1)
    files(spark, [(9, start + datetime.timedelta(days=3))], schema, path, 1)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = stream.into_table(timers.entry_stream(events, 120), "entries", str(tmp_path / "c"))
    want = timers.entry_lives(spark.createDataFrame(rows, schema), 120)
    key = lambda df: sorted((r.key, r.ended, r.n) for r in df.where("key < 9").collect())
    assert key(got) == key(want)
