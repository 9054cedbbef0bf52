"""Document versions: reservation, states, activation, operations and consistency, as set operations on tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_key
from ..storage import Log

#: States and the steps that are allowed between them.
TRANSITIONS = {"processing": ("ready", "failed"), "ready": ("processing", "deleting"), "failed": ("processing",), "deleting": ("deleted", "failed"), "deleted": ()}
#: Steps of an update in order; compensation undoes the completed ones backwards.
SAGA = ("prepare", "catalog_staged", "vector_staged", "graph_staged", "verified", "vector_active", "graph_active", "catalog_active", "ready")


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def reserve(registry: DataFrame, uploads: DataFrame) -> DataFrame:
    """(namespace, logical_key, arrival, content_hash, version, outcome) of uploads in order of `arrival`: content that any version of the
    document has, whatever its state, is `unchanged` and gets that version; other content gets the next number when it first arrives.
    Names are made safe, so that those without one share `unnamed`. registry: namespace, logical_key, version, content_hash."""
    keys = ["namespace", "logical_key"]
    safe = {k: safe_key(F.coalesce(F.col(k), F.lit(""))) for k in keys}
    registry, uploads = registry.withColumns(safe), uploads.withColumns(safe)
    known = registry.groupBy(*keys, "content_hash").agg(F.min("version").cast("long").alias("version"))
    top = registry.groupBy(*keys).agg(F.max("version").alias("top"))
    first = uploads.groupBy(*keys, "content_hash").agg(F.min("arrival").alias("first"))
    new = first.join(known, [*keys, "content_hash"], "left_anti").join(top, keys, "left")
    number = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy(*keys).orderBy("first"))
    named = new.select(*keys, "content_hash", number.cast("long").alias("version"), "first").unionByName(known.withColumn("first", F.lit(None)))
    outcome = F.when(F.col("arrival") == F.col("first"), "reserved").otherwise("unchanged")
    return uploads.join(named, [*keys, "content_hash"]).select(*keys, "arrival", "content_hash", "version", outcome.alias("outcome"))


def current(versions: DataFrame, key: str = "document_id") -> DataFrame:
    """The newest ready version of each document; a failed newer one leaves it in force."""
    w = Window.partitionBy(key).orderBy(F.col("version").desc())
    return versions.where("status = 'ready'").withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth").withColumn("is_current", F.lit(True))


def allowed(before: Column, after: Column) -> Column:
    pairs = [f"{a}>{b}" for a, bs in TRANSITIONS.items() for b in bs]
    return F.concat(before, F.lit(">"), after).isin(*pairs)


def replay(events: DataFrame, key: str = "document_id", order: str = "seq") -> DataFrame:
    """(key, seq, status, before, ok) of status events: each against the state that the document is in. A refused step changes nothing. Events come
    sorted by document, so a task keeps the state of one at a time, however many events it has."""
    def run(batches):
        of, now = object(), None
        for batch in batches:
            before, ok = [], []
            for k, status in zip(batch.column(key).to_pylist(), batch.column("status").to_pylist(), strict=True):
                if k != of:
                    of, now = k, None
                good = status == "processing" if now is None else status in TRANSITIONS.get(now, ())
                before.append(now)
                ok.append(good)
                now = status if good else now
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, order, "status")], pa.array(before, pa.string()), pa.array(ok, pa.bool_())], names=[key, order, "status", "before", "ok"])

    rows = events.select(key, F.col(order).cast("long").alias(order), "status").repartition(key).sortWithinPartitions(key, order)
    return rows.mapInArrow(run, f"{key} {events.schema[key].dataType.simpleString()}, {order} long, status string, before string, ok boolean")


def activated(pointers: DataFrame, changes: DataFrame) -> DataFrame:
    """The pointer table (document_id, version) after changes (document_id, version, seq; null version: deleted). Data of versions
    is immutable, so swapping this small table is the whole activation."""
    last = changes.groupBy("document_id").agg(F.max_by(F.struct("version"), "seq").alias("v")).select("document_id", "v.version")
    return pointers.join(last.select("document_id"), "document_id", "left_anti").unionByName(last.where("version is not null"))


def with_current(rows: DataFrame, pointers: DataFrame) -> DataFrame:
    """Rows of versions with is_current by the pointer table."""
    p = pointers.select("document_id", F.col("version").alias("_v"))
    return rows.join(p, "document_id", "left").withColumn("is_current", F.coalesce(F.col("_v") == F.col("version"), F.lit(False))).drop("_v")


def saga_state(journal: DataFrame) -> DataFrame:
    """(operation_id, completed, next_step, compensation): completed steps in order, and how a failed operation is undone.
    journal: operation_id, step, status."""
    done = journal.where("status = 'done'").select("operation_id", F.array_position(F.array(*[F.lit(s) for s in SAGA]), F.col("step")).alias("n")).where("n > 0").distinct()
    failed = journal.groupBy("operation_id").agg(F.bool_or(F.col("status") == "failed").alias("failed"))
    got = failed.join(done.groupBy("operation_id").agg(F.array_sort(F.collect_list("n")).alias("ns")), "operation_id", "left").withColumn("ns", F.coalesce("ns", F.array().cast("array<bigint>")))
    names = lambda c: F.transform(c, lambda i: F.element_at(F.array(*[F.lit(s) for s in SAGA]), i.cast("int")))
    todo = F.array_except(F.sequence(F.lit(1).cast("bigint"), F.lit(len(SAGA)).cast("bigint")), F.col("ns"))
    return got.select("operation_id", names(F.col("ns")).alias("completed"), F.when(~F.col("failed"), F.try_element_at(names(todo), F.lit(1))).alias("next_step"), F.when(F.col("failed"), names(F.reverse("ns"))).alias("compensation"))


def expired(locks: DataFrame, now: Column) -> DataFrame:
    """Locks whose lease is over: another operation may take them."""
    return locks.where(F.col("expires_at") <= now)


def leased(locks: DataFrame, wants: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """(document_id, operation_id, granted, expires_at): a request is granted if no other operation's lease is running; of several
    requests the first operation id gets it."""
    held = locks.where(F.col("expires_at") > now).select("document_id", F.col("operation_id").alias("holder"))
    w = Window.partitionBy("document_id").orderBy("operation_id")
    both = wants.join(held, "document_id", "left").withColumn("nth", F.row_number().over(w))
    ok = F.coalesce(F.col("holder") == F.col("operation_id"), F.col("nth") == 1)
    return both.select("document_id", "operation_id", ok.alias("granted"), F.when(ok, now + F.make_dt_interval(secs=F.lit(seconds))).alias("expires_at"))


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work that a resumed run still has to do."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def consistency(catalog: DataFrame, vectors: DataFrame, graph: DataFrame, registry: DataFrame) -> DataFrame:
    """(document_id, counts of the four stores, consistent): whether the current version of each registered document is everywhere."""
    n = lambda df, name: df.groupBy("document_id", "version").agg(F.count(F.lit(1)).alias(name))
    out = registry.where("is_current").select("document_id", "version", "chunk_count")
    for df, name in ((catalog, "n_catalog"), (vectors, "n_vectors"), (graph, "n_graph")):
        out = out.join(n(df, name), ["document_id", "version"], "left")
    out = out.na.fill(0, ["n_catalog", "n_vectors", "n_graph"])
    return out.withColumn("consistent", (F.col("n_catalog") == F.col("chunk_count")) & (F.col("n_vectors") == F.col("chunk_count")) & (F.col("n_graph") > 0))


def migration_plan(source: DataFrame, target: DataFrame, size: int = 10) -> DataFrame:
    """Rows that the target lacks, with the batch of `size` that each goes into."""
    left = source.join(target.select("id"), "id", "left_anti")
    w = Window.partitionBy(F.pmod(F.xxhash64("id"), F.lit(256))).orderBy("id")
    return left.withColumn("batch", F.concat(F.pmod(F.xxhash64("id"), F.lit(256)).cast("string"), F.lit("-"), F.floor((F.row_number().over(w) - 1) / size).cast("string")))


class Migration:
    """Copies rows of a source that is only read into a table of files, in batches, with a manifest: a batch that the manifest has isn't
    made again, so a run that was stopped goes on where it ended, and the result is that of one run.

    The manifest's first entry is the plan: the number of batches and the digest of the source's rows. If the source has changed since, the run
    stops, as parts of both would be mixed. A batch is rows whose hash falls to it, so that it can be made from one filtered read; its entry
    holds how many rows it has and their digest, and `verify` compares them with what is stored."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path
        self.manifest = Log(spark, f"{path}/manifest", "batch int, n long, digest string")

    @staticmethod
    def digest(rows: DataFrame) -> DataFrame:
        """(n, digest) of rows in any order: the sum of their hashes."""
        return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))

    def run(self, source: DataFrame, batches: int, id: str = "id", change=lambda rows: rows, most: int | None = None) -> int:
        """Makes what is missing, at most `most` batches, and returns how many were made. change: what becomes of the rows."""
        whole = self.digest(source).withColumn("batch", F.lit(-batches))
        if not self.manifest.commit("plan", whole):
            old, new = self.manifest.read().where("batch < 0").first(), whole.first()
            if (old.batch, old.n, old.digest) != (-batches, new.n, new.digest):
                raise ValueError("the source or the number of batches isn't that of the plan")
        todo = [b for b in range(batches) if not self.manifest.has(f"batch-{b}")][:most]
        for b in todo:
            rows = change(source.where(F.pmod(F.xxhash64(id), F.lit(batches)) == b))
            rows.write.mode("overwrite").parquet(f"{self.path}/data/batch={b}")
            self.manifest.commit(f"batch-{b}", self.digest(self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/batch={b}")).withColumn("batch", F.lit(b)))
        return len(todo)

    def rows(self) -> DataFrame:
        """The rows of batches that the manifest has."""
        done = [b.removeprefix("batch-") for b in self.manifest.commits() if b.startswith("batch-")]
        return self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/batch={b}" for b in done]).drop("batch")

    def verify(self, columns: list[str]) -> DataFrame:
        """(batch, n, stored, same) of the manifest's batches against what is stored."""
        held = self.spark.read.parquet(f"{self.path}/data")
        found = held.groupBy("batch").agg(F.count(F.lit(1)).alias("stored"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string").alias("found"))
        told = self.manifest.read().where("batch >= 0").join(found, "batch", "left")
        return told.select("batch", "n", F.coalesce("stored", F.lit(0)).alias("stored"), (F.col("digest") == F.coalesce("found", F.lit("0"))).alias("same"))
