"""Documents of many versions in four stores (registry, catalog, vectors, graph), changed by operations that can fail at any step.

Rows of versions are immutable files, written once by the batch that brings them; which of them count is decided by a log of steps. A step that
is in the log has happened, for all operations of its commit at once, and what it means for a store follows from its name (EFFECTS): staged,
made current, hidden, or deleted, which leaves a tombstone. Readers merge: rows join the states that the log folds to, so rows
without a committed step, or with a tombstone, are not there. `vacuum` rewrites the batches that hold dead rows.

An update goes through the steps of UPDATE; if one can't be taken, those taken are undone in the order of UNDO and the version before is in
force again. A delete first hides a document everywhere and then removes its rows; once it is hidden it only goes forward: what can't be
removed yet is `cleanup_pending`. `recovery` decides what becomes of operations that a crash has left, whose lease is over.
Batches may hold any number of operations: each step is one job over all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.provenance import INCOMPLETE
from ..storage import Log, delete, names, staged
from .versions import allowed

#: The steps of operations, in order.
UPDATE = ("mongo_reserved", "prepared", "chunk_staged", "vector_staged", "graph_stage_committed", "graph_staged", "vector_activated", "graph_activated", "chunk_activated", "mongo_ready")
HIDE = ("mongo_deleting", "vector_deactivated", "graph_deactivated", "chunk_deactivated", "mongo_deleted")
CLEAN = ("vector_cleaned", "graph_cleaned", "chunk_cleaned")
#: The steps that undo an update, in order, and the completed steps of which one calls for it. Those of the second table are
#: for documents with a version before.
UNDO = {
    "chunk_deactivated": ("chunk_activated",), "graph_deactivated": ("graph_activated",), "vector_deactivated": ("vector_activated",),
    "graph_stage_deleted": ("graph_stage_committed", "graph_staged"), "vector_stage_deleted": ("vector_staged",), "chunk_stage_deleted": ("chunk_staged",),
}
RESTORE = {"previous_vector_restored": ("vector_activated",), "previous_graph_restored": ("graph_activated",), "previous_chunk_restored": ("chunk_activated",)}
#: What a step does to which store. `restore` makes the version before current.
EFFECTS = {
    "mongo_reserved": ("registry", "stage"), "mongo_ready": ("registry", "activate"), "mongo_failed": ("registry", "failed"), "mongo_deleting": ("registry", "deleting"), "mongo_deleted": ("registry", "deleted"),
    "chunk_staged": ("catalog", "stage"), "vector_staged": ("vectors", "stage"), "graph_stage_committed": ("graph", "stage"),
    "chunk_activated": ("catalog", "activate"), "vector_activated": ("vectors", "activate"), "graph_activated": ("graph", "activate"),
    "chunk_deactivated": ("catalog", "hide"), "vector_deactivated": ("vectors", "hide"), "graph_deactivated": ("graph", "hide"),
    "chunk_stage_deleted": ("catalog", "delete"), "vector_stage_deleted": ("vectors", "delete"), "graph_stage_deleted": ("graph", "delete"),
    "previous_chunk_restored": ("catalog", "restore"), "previous_vector_restored": ("vectors", "restore"), "previous_graph_restored": ("graph", "restore"),
    "chunk_cleaned": ("catalog", "delete_all"), "vector_cleaned": ("vectors", "delete_all"), "graph_cleaned": ("graph", "delete_all"),
}
STORES = ("catalog", "vectors", "graph")
#: Stores in which a version without rows can't be made current.
NEEDS_ROWS = ("catalog", "vectors")
STEP = "operation_id string, operation_type string, document_id long, version long, previous_version long, step string, nth int, status string, expires_at timestamp"
OPERATION = ("operation_id", "operation_type", "document_id", "version", "previous_version")


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def changes(steps: DataFrame) -> DataFrame:
    """(store, document_id, version, change, at) of logged steps; at orders them."""
    step = F.col("step")
    store, change = (_map({k: v[i] for k, v in EFFECTS.items()})[step] for i in (0, 1))
    out = steps.select(store.alias("store"), "document_id", "version", "previous_version", change.alias("change"), F.struct("seq", "nth").alias("at")).where("store is not null")
    version = F.when(F.col("change") == "restore", F.col("previous_version")).otherwise(F.col("version"))
    return out.select("store", "document_id", version.alias("version"), F.when(F.col("change") == "restore", "activate").otherwise(F.col("change")).alias("change"), "at")


def states(changes: DataFrame) -> DataFrame:
    """(store, document_id, version, status, is_current) of the versions that are in a store after changes (store, document_id, version, change,
    at). Making a version current ends that of the others; hiding leaves the status; the registry keeps versions and their last status."""
    last = lambda *kinds: F.max(F.when(F.col("change").isin(*kinds), F.col("at")))
    told = changes.groupBy("store", "document_id", "version").agg(
        last("stage").alias("staged"), last("activate").alias("on"), last("hide").alias("off"), last("delete").alias("gone"), last("delete_all").alias("swept"),
        F.max_by("change", F.when(F.col("change").isin("stage", "activate", "failed", "deleting", "deleted"), F.col("at"))).alias("said"),
    )
    w = Window.partitionBy("store", "document_id")
    told = told.withColumn("last_on", F.max("on").over(w)).withColumn("last_swept", F.max("swept").over(w))
    after = lambda a, b: F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) > F.col(b)))
    there = told.where(after("staged", "gone") & after("staged", "last_swept"))
    stored = F.when(after("on", "staged"), "ready").otherwise("processing")
    told_status = _map({"stage": "processing", "activate": "ready", "failed": "failed", "deleting": "deleting", "deleted": "deleted"})[F.col("said")]
    current = F.coalesce((F.col("on") == F.col("last_on")) & after("on", "off") & after("on", "staged"), F.lit(False))
    return there.select("store", "document_id", "version", F.when(F.col("store") == "registry", told_status).otherwise(stored).alias("status"), current.alias("is_current"))


def operations_of(steps: DataFrame) -> DataFrame:
    """(operation_id, operation_type, document_id, version, previous_version, status, completed, compensated, stopped) of logged steps; stopped: at a
    step that it could not take."""
    undo = F.col("step").isin(*UNDO, *RESTORE) & (F.col("operation_type") != "delete")
    at = F.struct("seq", "nth")
    did = F.struct(at.alias("at"), F.col("step").alias("step"))
    listed = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(c, did))), lambda x: x["step"]))
    work = F.col("step").isin(*EFFECTS, *UPDATE)
    return steps.where("step <> 'released'").groupBy(*OPERATION).agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), at)).alias("status"), listed(work & ~undo).alias("completed"), listed(work & undo).alias("compensated"),
        F.bool_or(F.col("step").startswith("not_")).alias("stopped"),
    )


def leases(steps: DataFrame) -> DataFrame:
    """(document_id, operation_id, expires_at): who holds each document, by the last step that took or gave up its lease."""
    at = F.struct("seq", "nth")
    last = steps.where(F.col("step").isin("locked", "released")).groupBy("document_id").agg(F.max_by(F.struct("operation_id", "step", "expires_at"), at).alias("l"))
    return last.where("l.step = 'locked'").select("document_id", "l.operation_id", "l.expires_at")


def recovery(operations: DataFrame, now_in: DataFrame, locks: DataFrame, now: Column, broken: DataFrame | None = None) -> DataFrame:
    """What recovery does with each unfinished operation: (operation columns, action, steps, new_status).

    operations as of `operations_of`, now_in as of `states`, locks as of `leases`. A running operation whose document is still leased is skipped; any
    other whose document another operation has leased is `busy`. A delete in `cleanup_pending` goes forward: vectors, graph, catalog (if it holds the
    version) are removed, up to the first store that can't be reached. All else is compensated: each undo step that a completed step calls for,
    unless it is done already, whatever becomes of the others; then the version is marked failed if its state allows that. Making the version before
    current again fails where catalog or vectors hold no rows of it; with a failure the operation needs reconciliation and the registry stays.
    broken: (document_id, step) that can't be taken now."""
    todo = operations.where(F.col("status").isin(*INCOMPLETE))
    held = locks.where(F.col("expires_at") > now).select("document_id", F.col("operation_id").alias("holder"))
    todo = todo.join(held, "document_id", "left")
    rows = now_in.select("store", F.col("document_id").alias("_d"), F.col("version").alias("_v"), F.col("status").alias("_s"))
    own = lambda store, version, name, what=F.lit(True): rows.where(F.col("store") == store).groupBy(F.col("_d").alias("document_id"), F.col("_v").alias(version)).agg(F.first(what).alias(name))
    todo = todo.join(own("catalog", "version", "in_catalog"), ["document_id", "version"], "left").join(own("registry", "version", "registry_status", F.col("_s")), ["document_id", "version"], "left")
    for store in NEEDS_ROWS:
        todo = todo.join(own(store, "previous_version", f"previous_{store}"), ["document_id", "previous_version"], "left")
    if broken is None:
        todo = todo.withColumn("cannot", F.array().cast("array<string>"))
    else:
        todo = todo.join(broken.groupBy("document_id").agg(F.collect_set("step").alias("cannot")), "document_id", "left").withColumn("cannot", F.coalesce("cannot", F.array().cast("array<string>")))
    lost = lambda store: F.col(f"previous_{store}").isNull()
    action = (
        F.when((F.col("status") == "running") & F.col("holder").isNotNull(), "skip").when(F.col("holder").isNotNull() & (F.col("holder") != F.col("operation_id")), "busy")
        .when((F.col("operation_type") == "delete") & (F.col("status") == "cleanup_pending"), "resume_cleanup").otherwise("compensate")
    )
    calls = lambda of: [F.when(F.arrays_overlap("completed", F.array(*[F.lit(x) for x in why])), F.lit(step)) for step, why in of.items()]
    wanted = F.concat(F.array(*calls(UNDO)), F.when(F.col("previous_version").isNotNull(), F.array(*calls(RESTORE))).otherwise(F.array().cast("array<string>")))
    todo = todo.withColumn("action", action).withColumn("wanted", F.when(F.col("action") == "compensate", F.array_except(F.array_compact(wanted), "compensated")).when(
        F.col("action") == "resume_cleanup", F.array_compact(F.array(F.lit("vector_cleaned"), F.lit("graph_cleaned"), F.when(F.col("in_catalog"), F.lit("chunk_cleaned"))))).otherwise(F.array().cast("array<string>")))
    unable = lambda x: F.array_contains(F.col("cannot"), x) | ((x == "previous_vector_restored") & lost("vectors")) | ((x == "previous_chunk_restored") & lost("catalog"))
    first = F.array_position(F.transform("wanted", unable), True)
    cleaned = F.when(first > 0, F.slice("wanted", F.lit(1), (first - 1).cast("int"))).otherwise(F.col("wanted"))
    todo = todo.withColumn("all_well", ~F.exists("wanted", unable))
    steps = F.when(F.col("action") == "resume_cleanup", cleaned).when(F.col("action") != "compensate", F.col("wanted")).otherwise(F.concat(
        F.filter("wanted", lambda x: ~unable(x)), F.when(F.col("all_well") & allowed(F.col("registry_status"), F.lit("failed")), F.array(F.lit("mongo_failed"))).otherwise(F.array().cast("array<string>"))))
    status = F.when(F.col("action") == "resume_cleanup", F.when(F.col("all_well"), "succeeded").otherwise("cleanup_pending")).when(F.col("action") == "compensate", F.when(F.col("all_well"), "failed").otherwise("needs_reconciliation")).otherwise(F.col("status"))
    return todo.select(*OPERATION, "action", steps.alias("steps"), status.alias("new_status"))


Check = Callable[[DataFrame], DataFrame]


def _groups(steps: tuple[str, ...], heads: Callable[[str], bool]) -> list[list[str]]:
    """Runs of steps, each beginning with the first or with one that heads a group."""
    out: list[list[str]] = []
    for step in steps:
        if not out or heads(step):
            out.append([])
        out[-1].append(step)
    return out


class DocumentStore:
    """The four stores in a folder. One coordinator writes; readers see whole steps."""

    def __init__(self, spark: SparkSession, path: str, lease_seconds: int = 300):
        self.spark, self.path, self.lease_seconds = spark, path, lease_seconds
        self.log = Log(spark, f"{path}/log", STEP)

    # --- reading

    def states(self) -> DataFrame:
        return states(changes(self.log.read()))

    def rows(self, store: str, current: bool = False) -> DataFrame:
        """The rows of a store that count, with status and is_current; current: only those in force."""
        now = self.states().where(F.col("store") == store).drop("store")
        return self._files(store).drop("batch").join(now.where("is_current and status = 'ready'") if current else now, ["document_id", "version"])

    def operations(self) -> DataFrame:
        return operations_of(self.log.read())

    def _files(self, store: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{store}")

    # --- changing

    def _stage(self, store: str, batch: str, rows: DataFrame) -> None:
        """The rows of a batch; sent again they replace what that batch has written, and nothing else."""
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.path}/data/{store}")

    def _passed(self, name: str) -> DataFrame:
        """The operations that a commit says go on."""
        number = self.log.commits()[name]
        return self.spark.read.schema(STEP).parquet(f"{self.log.path}/{number:08d}-{name}").where("step = 'passed'").select(*OPERATION)

    def run(self, batch: str, operations: DataFrame, content: dict[str, DataFrame], now: Column, checks: dict[str, Check] | None = None) -> DataFrame:
        """Runs operations (operation_id, operation_type, document_id, version, previous_version, n_chunks, n_vectors) with the rows of their versions in
        each store (document_id, version, ...; the graph's with evidence_key), and returns (operation_id, status).

        checks: by step, which of the operations given to it can't take that step. Counts and evidence are checked anyway. Steps that nothing can stop are
        committed together with the one before. Operation ids get the batch's name in front, so a batch sent again, or after a crash, goes on where
        its last commit ended. An operation whose document is leased, or wanted by another of the batch with a smaller id, isn't run."""
        named = operations.withColumn("operation_id", F.concat(F.lit(f"{batch}/"), F.col("operation_id")))
        if not self.log.has(f"{batch}-locked"):
            held = leases(self.log.read()).where(F.col("expires_at") > now)
            free = named.join(held.select("document_id"), "document_id", "left_anti").withColumn("_nth", F.row_number().over(Window.partitionBy("document_id").orderBy("operation_id"))).where("_nth = 1")
            first = F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(step).alias("step")) for k, step in enumerate(("locked", "passed"))])
            self.log.commit(f"{batch}-locked", free.select(*OPERATION, F.explode(first).alias("t")).select(
                *OPERATION, "t.step", "t.nth", F.lit("running").alias("status"), (now + F.make_dt_interval(secs=F.lit(self.lease_seconds))).alias("expires_at")))
        wants = named.select("operation_id", "n_chunks", "n_vectors")
        tests = {step: [check] for step, check in (checks or {}).items()}
        for step, own in (("chunk_staged", self._counted("catalog", batch, wants, "n_chunks")), ("vector_staged", self._counted("vectors", batch, wants, "n_vectors")), ("graph_staged", self._evidence(batch))):
            tests[step] = [own, *tests.get(step, [])]
        begun = self._passed(f"{batch}-locked")
        kinds = {r[0] == "delete" for r in begun.select("operation_type").distinct().collect()}
        last = f"{batch}-locked"
        if False in kinds:
            for group in _groups(UPDATE, lambda step: step in tests or EFFECTS.get(step, ("", ""))[1] == "stage"):
                before, last = last, f"{batch}-{group[0]}"
                if self.log.has(last):
                    continue
                store, change = EFFECTS.get(group[0], ("", ""))
                alive = self._passed(before).where("operation_type <> 'delete'")
                if change == "stage" and store in content:
                    rows = content[store].join(alive.select("document_id", "version"), ["document_id", "version"], "left_semi")
                    self._stage(store, batch, rows.dropDuplicates(["document_id", "version", "evidence_key"]) if store == "graph" else rows)
                self._take(batch, group, alive, "compensating", tests.get(group[0], []), group[-1] == UPDATE[-1], False)
            if not self.log.has(f"{batch}-undone"):
                self._undo(f"{batch}-undone", self.operations().where(F.col("operation_id").startswith(f"{batch}/") & (F.col("status") == "compensating")), now)
        if True in kinds:  # a delete that stops before it is hidden stays running, and its lease is not given up: recovery is for it
            last = f"{batch}-locked"
            for group in _groups((*HIDE, *CLEAN), lambda step: step in tests or step == CLEAN[0]):
                before, last = last, f"{batch}-{group[0]}"
                if not self.log.has(last):
                    self._take(batch, group, self._passed(before).where("operation_type = 'delete'"), "cleanup_pending" if group[0] in CLEAN else "running", tests.get(group[0], []), group[-1] == CLEAN[-1], group[0] in CLEAN)
        told = self.operations().where(F.col("operation_id").startswith(f"{batch}/")).select("operation_id", "status")
        return told.select(F.substr("operation_id", F.lit(len(batch) + 2)).alias("operation_id"), "status")

    def _take(self, batch: str, group: list[str], alive: DataFrame, otherwise: str, tests: list[Check], ends: bool, frees: bool) -> None:
        """Commits a group of steps for the operations given; those that fail a test of the first step don't take any, and get the state `otherwise`.
        ends: with these steps operations have succeeded; frees: those that stop give up their lease all the same."""
        one = lambda step, nth, status=None, given=F.lit(True): F.struct(F.lit(nth).alias("nth"), F.lit(step).alias("step"), F.lit(status).cast("string").alias("status"), given.alias("given"))
        needs = [s for s in group if s in ("chunk_deactivated", "chunk_cleaned")]
        if needs:  # only where the catalog holds the version
            there = self.states().where("store = 'catalog'").select("document_id", "version", F.lit(True).alias("in_catalog"))
            alive = alive.join(there, ["document_id", "version"], "left")
        steps = [one(s, k, None, F.col("in_catalog").isNotNull() if s in needs else F.lit(True)) for k, s in enumerate(group)]
        steps += [one("finished", len(group), "succeeded"), one("released", len(group) + 1)] if ends else [one("passed", len(group))]
        rows = alive.select(*alive.columns, F.array(*steps).alias("todo"))
        if tests:
            bad = None
            for test in tests:
                found = test(alive.select(*OPERATION)).select("operation_id")
                bad = found if bad is None else bad.union(found)
            stop = [one(f"not_{group[0]}", 0, otherwise)] + ([one("released", 1)] if frees else [])
            rows = alive.join(bad.distinct().withColumn("bad", F.lit(True)), "operation_id", "left").withColumn("todo", F.when(F.col("bad"), F.array(*stop)).otherwise(F.array(*steps)))
        rows = rows.select(*OPERATION, F.explode("todo").alias("t")).where("t.given").select(*OPERATION, "t.step", "t.nth", "t.status", F.lit(None).cast("timestamp").alias("expires_at"))
        self.log.commit(f"{batch}-{group[0]}", rows)

    def _counted(self, store: str, batch: str, wants: DataFrame, column: str) -> Check:
        """Operations whose version has another number of rows in the store than it should."""
        def test(alive: DataFrame) -> DataFrame:
            found = self._batch(store, batch).groupBy("document_id", "version").agg(F.count(F.lit(1)).alias("n"))
            both = alive.join(wants, "operation_id").join(found, ["document_id", "version"], "left")
            return both.where(F.coalesce("n", F.lit(0)) != F.col(column))

        return test

    def _evidence(self, batch: str) -> Check:
        """Operations with evidence that has no identity."""
        def test(alive: DataFrame) -> DataFrame:
            bad = self._batch("graph", batch).where("evidence_key is null or evidence_key = ''").select("document_id", "version").distinct()
            return alive.join(bad, ["document_id", "version"], "left_semi")

        return test

    def _batch(self, store: str, batch: str) -> DataFrame:
        if store not in names(self.spark, f"{self.path}/data") or f"batch={batch}" not in names(self.spark, f"{self.path}/data/{store}"):
            return self.spark.createDataFrame([], "document_id long, version long, evidence_key string")
        return self._files(store).where(F.col("batch") == batch)

    def _undo(self, name: str, operations: DataFrame, now: Column, broken: DataFrame | None = None) -> None:
        """Commits what recovery decides for these operations. Nothing is committed under a name that is there."""
        if self.log.has(name):
            return
        told = recovery(operations, staged(self.states(), "states"), leases(self.log.read()), now, broken).where("action in ('resume_cleanup', 'compensate')")
        told = told.select(*OPERATION, "new_status", F.posexplode(F.concat("steps", F.array(F.lit("recovered"), F.lit("released")))).alias("nth", "step"))
        status = F.when(F.col("step") == "recovered", F.col("new_status"))
        self.log.commit(name, told.select(*OPERATION, "step", "nth", status.alias("status"), F.lit(None).cast("timestamp").alias("expires_at")))

    def recover(self, name: str, now: Column, broken: DataFrame | None = None) -> DataFrame:
        """Recovers all unfinished operations under a name, and returns (operation_id, status) of all. Run again it only looks at those that are
        still unfinished; under the same name it does nothing."""
        self._undo(name, self.operations(), now, broken)
        return self.operations().select("operation_id", "status")

    def vacuum(self, store: str) -> int:
        """Rewrites the batches of a store that hold rows of deleted versions, without them. Returns how many batches."""
        now = self.states().where(F.col("store") == store).select("document_id", "version")
        dead = self._files(store).join(now, ["document_id", "version"], "left_anti").select("batch").distinct()
        batches = [r.batch for r in dead.collect()]  # a row for each batch of the store at most
        for batch in batches:
            kept = self._files(store).where(F.col("batch") == batch).join(now, ["document_id", "version"], "left_semi")
            beside = f"{self.path}/_vacuum/{store}-{batch}"
            kept.drop("batch").write.mode("overwrite").parquet(beside)
            self._stage(store, batch, self.spark.read.parquet(beside)) if self.spark.read.parquet(beside).limit(1).count() else delete(self.spark, f"{self.path}/data/{store}/batch={batch}")
            delete(self.spark, beside)
        return len(batches)
