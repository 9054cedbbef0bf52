"""Registered queries over operations that change documents: updates that fail at any step, deletes in two phases, and their recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import load
from ..storage import folder
from . import docstore, versions
from .catalog import CHUNKS, _chunks, query

#: Of 41 documents in a row, those whose update can't take a step, and the step.
REFUSED = {1: "vector_activated", 2: "graph_activated", 3: "chunk_activated", 4: "mongo_ready", 5: "prepared", 6: "chunk_staged", 7: "mongo_reserved"}
_PLACE = {step: k for k, step in enumerate(docstore.UPDATE, 1)}
_REFUSED_SQL = " ".join(f"WHEN {n} THEN {_PLACE[step]}" for n, step in REFUSED.items())
_STEPS_SQL = "[" + ", ".join(f"'{s}'" for s in docstore.UPDATE) + "]"


def _undone_sql(k: str, previous: str) -> str:
    """The undo steps after k - 1 completed ones."""
    undo = [(9, "chunk_deactivated"), (8, "graph_deactivated"), (7, "vector_deactivated"), (5, "graph_stage_deleted"), (4, "vector_stage_deleted"), (3, "chunk_stage_deleted")]
    restore = [(7, "previous_vector_restored"), (8, "previous_graph_restored"), (9, "previous_chunk_restored")]
    each = [f"CASE WHEN {k} > {n} THEN '{s}' END" for n, s in undo] + [f"CASE WHEN {previous} AND {k} > {n} THEN '{s}' END" for n, s in restore]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


def _versions(spark, d):
    """Lines of documents: the first half is version 1, all are version 2."""
    lines = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("chunk_index", "content"), F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n"))
    lines = lines.withColumn("solid", F.trim("content") != "").withColumn("version", F.explode(F.when(F.col("chunk_index") * 2 < F.col("n"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    return lines.select("document_id", F.col("version").cast("long").alias("version"), "chunk_index", "content", "solid")


def _content(lines, version):
    """A catalog of all lines, vectors of the solid ones, and their evidence; of every 37th document the first vector is lost."""
    own = lines.where(F.col("version") == version)
    key = ["document_id", "version"]
    lost = (F.col("document_id") % 37 == 0) & (F.col("chunk_index") == 0)
    return {
        "catalog": own.select(*key, "chunk_index", "content"),
        "vectors": own.where(F.col("solid") & ~lost).select(*key, "chunk_index", F.xxhash64("content").alias("vector_hash")),
        "graph": own.select(*key, F.when(F.col("solid"), F.md5("content")).alias("evidence_key")),
    }


def _wanted(lines, version):
    return lines.where(F.col("version") == version).groupBy("document_id", "version").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.col("solid").cast("long")).alias("n_vectors"))


@query(rf"""WITH l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM l0),
v AS (SELECT doc_id, v, count(*) AS n_chunks, count(*) FILTER (trim(line, ' ') <> '') AS n_solid, count(DISTINCT line) FILTER (trim(line, ' ') <> '') AS n_keys, bool_or(trim(line, ' ') = '') AS blank,
  bool_or(doc_id % 37 = 0 AND i = 0 AND trim(line, ' ') <> '') AS lost FROM l, (VALUES (1), (2)) t(v) WHERE v = 2 OR i * 2 < n GROUP BY doc_id, v),
a AS (SELECT *, CASE WHEN lost THEN 4 WHEN blank THEN 6 ELSE 11 END AS k FROM v WHERE v = 1),
u AS (SELECT v.doc_id, v.n_chunks, v.n_solid, v.n_keys, least(CASE WHEN v.lost THEN 4 WHEN v.blank THEN 6 ELSE 11 END, CASE v.doc_id % 41 {_REFUSED_SQL} ELSE 11 END) AS k FROM v JOIN a USING (doc_id) WHERE v.v = 2 AND a.k = 11 AND doc_id % 4 < 2),
x AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'stopped' WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'gone' END AS ends FROM a WHERE k = 11 AND doc_id % 4 = 2),
o AS (SELECT 'load/' || doc_id AS id, doc_id, 1 AS v, CASE WHEN k = 11 THEN 'succeeded' ELSE 'failed' END AS status, {_STEPS_SQL}[1:k - 1] || CASE WHEN k < 11 THEN ['mongo_failed'] ELSE [] END AS done, {_undone_sql('(CASE WHEN k = 11 THEN 0 ELSE k END)', 'false')} AS undone FROM a
  UNION ALL SELECT 'change/' || doc_id, doc_id, 2, CASE WHEN k = 11 THEN 'succeeded' ELSE 'failed' END, {_STEPS_SQL}[1:k - 1] || CASE WHEN k > 1 AND k < 11 THEN ['mongo_failed'] ELSE [] END, {_undone_sql('(CASE WHEN k = 11 THEN 0 ELSE k END)', 'true')} FROM u
  UNION ALL SELECT 'change/' || doc_id, doc_id, 1, CASE ends WHEN 'stopped' THEN 'failed' WHEN 'pending' THEN 'cleanup_pending' ELSE 'succeeded' END,
    CASE ends WHEN 'stopped' THEN ['mongo_deleting', 'vector_deactivated', 'mongo_failed'] ELSE ['mongo_deleting', 'vector_deactivated', 'graph_deactivated', 'chunk_deactivated', 'mongo_deleted', 'vector_cleaned'] || CASE WHEN ends = 'gone' THEN ['graph_cleaned', 'chunk_cleaned'] ELSE [] END END, [] FROM x),
stores AS (SELECT unnest(['registry', 'catalog', 'vectors', 'graph']) AS store),
s AS (SELECT store, doc_id, 1 AS v, CASE WHEN store <> 'registry' THEN 'ready' WHEN a.k < 11 THEN 'failed' WHEN x.ends = 'stopped' THEN 'failed' WHEN x.ends IS NOT NULL THEN 'deleted' ELSE 'ready' END AS status,
    a.k = 11 AND coalesce(u.k < 11, true) AND (store = 'registry' OR x.ends IS NULL OR (x.ends = 'stopped' AND store <> 'vectors')) AS is_current, CASE store WHEN 'catalog' THEN a.n_chunks WHEN 'vectors' THEN a.n_solid WHEN 'graph' THEN a.n_keys END AS n
  FROM a LEFT JOIN u USING (doc_id) LEFT JOIN x USING (doc_id), stores WHERE store = 'registry' OR (a.k = 11 AND (x.ends IS NULL OR x.ends = 'stopped' OR (x.ends = 'pending' AND store IN ('catalog', 'graph'))))
  UNION ALL SELECT store, doc_id, 2, CASE WHEN k = 11 THEN 'ready' ELSE 'failed' END, k = 11, CASE store WHEN 'catalog' THEN n_chunks WHEN 'vectors' THEN n_solid WHEN 'graph' THEN n_keys END FROM u, stores WHERE k = 11 OR (store = 'registry' AND k > 1))
SELECT store, NULL AS operation_id, doc_id AS document_id, v AS version, status, is_current, n AS n_rows, NULL AS steps FROM s
UNION ALL SELECT 'operations', id, doc_id, v, status, NULL, NULL, array_to_string(done, ',') || '|' || array_to_string(undone, ',') FROM o""")
def document_operations(spark, d):
    """All documents are created; of those in force half are updated and a quarter deleted, with failures at every step; then a recovery whose
    graph can't be reached for every seventh document. Rows: what each store holds of each version at the end, and how each operation went."""
    lines = _versions(spark, d)
    store = docstore.DocumentStore(spark, folder(spark, "documents"))
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    op = lambda df, kind, previous: df.select(F.col("document_id").cast("string").alias("operation_id"), F.lit(kind).alias("operation_type"), "document_id", "version", previous.cast("long").alias("previous_version"), "n_chunks", "n_vectors")
    store.run("load", op(_wanted(lines, 1), "create", F.lit(None)), _content(lines, 1), now)
    live = store.states().where("store = 'registry' and is_current and status = 'ready'").select("document_id")
    both = op(_wanted(lines, 2).where("document_id % 4 < 2"), "update", F.lit(1)).unionByName(op(_wanted(lines, 1).where("document_id % 4 = 2"), "delete", F.col("version")))
    refuse = lambda rule: lambda alive: alive.where(rule)
    checks = {step: refuse(f"document_id % 41 = {n}") for n, step in REFUSED.items()}
    checks |= {"graph_deactivated": refuse("document_id % 11 = 0"), "vector_cleaned": refuse("document_id % 5 = 0"), "graph_cleaned": refuse("document_id % 7 = 0")}
    store.run("change", both.join(live, "document_id", "left_semi"), _content(lines, 2), now, checks)
    broken = both.where("document_id % 7 = 0").select("document_id", F.lit("graph_cleaned").alias("step"))
    store.recover("recovery", now + F.expr("interval 1 hour"), broken)
    none = F.lit(None).cast("string")
    counts = None
    for name in docstore.STORES:
        n = store.rows(name).groupBy("document_id", "version").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("store", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
    held = store.states().join(counts, ["store", "document_id", "version"], "left").select("store", none.alias("operation_id"), "document_id", "version", "status", "is_current", "n_rows", none.alias("steps"))
    told = store.operations().select(
        F.lit("operations").alias("store"), "operation_id", "document_id", "version", "status", F.lit(None).cast("boolean").alias("is_current"), F.lit(None).cast("long").alias("n_rows"),
        F.concat(F.array_join("completed", ","), F.lit("|"), F.array_join("compensated", ",")).alias("steps"),
    )
    return held.unionByName(told)


_STATUSES = ("pending", "running", "compensating", "cleanup_pending", "needs_reconciliation", "succeeded", "failed")
_NOW = "2026-01-01 00:00:00"



@query(f"""WITH o0 AS (SELECT CAST(event_id AS VARCHAR) AS id, event_id // 2 AS doc, event_id % 2 AS half, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS kind, {list(_STATUSES)}[event_id % 7 + 1] AS status,
  user_id % 4 > 0 AS has_previous, {_STEPS_SQL}[1:1 + user_id % 10] AS steps, CASE WHEN event_id % 3 = 0 THEN ['graph_deactivated'] ELSE [] END AS undone FROM events),
o AS (SELECT *, doc % 6 = 0 AS leased, CASE WHEN kind = 'delete' THEN ['mongo_reserved', 'mongo_deleting'] ELSE steps END AS done FROM o0 WHERE status IN ('running', 'compensating', 'cleanup_pending', 'needs_reconciliation')),
a AS (SELECT *, CASE WHEN leased AND status = 'running' THEN 'skip' WHEN leased AND half = 1 THEN 'busy' WHEN kind = 'delete' AND status = 'cleanup_pending' THEN 'resume_cleanup' ELSE 'compensate' END AS action FROM o),
w AS (SELECT *, list_filter(CASE action WHEN 'resume_cleanup' THEN ['vector_cleaned', 'graph_cleaned', CASE WHEN doc % 5 > 0 THEN 'chunk_cleaned' END] WHEN 'compensate' THEN list_filter([
    CASE WHEN 'chunk_activated' IN done THEN 'chunk_deactivated' END, CASE WHEN 'graph_activated' IN done THEN 'graph_deactivated' END, CASE WHEN 'vector_activated' IN done THEN 'vector_deactivated' END,
    CASE WHEN 'graph_stage_committed' IN done OR 'graph_staged' IN done THEN 'graph_stage_deleted' END, CASE WHEN 'vector_staged' IN done THEN 'vector_stage_deleted' END, CASE WHEN 'chunk_staged' IN done THEN 'chunk_stage_deleted' END,
    CASE WHEN has_previous AND 'vector_activated' IN done THEN 'previous_vector_restored' END, CASE WHEN has_previous AND 'graph_activated' IN done THEN 'previous_graph_restored' END, CASE WHEN has_previous AND 'chunk_activated' IN done THEN 'previous_chunk_restored' END],
    lambda x: x NOT IN undone) ELSE [] END, lambda x: x IS NOT NULL) AS wanted FROM a),
u AS (SELECT *, list_filter(wanted, lambda x: (x = 'vector_stage_deleted' AND doc % 11 = 0) OR (x = 'graph_cleaned' AND doc % 13 = 0) OR (x IN ('previous_vector_restored', 'previous_chunk_restored') AND doc % 3 = 0)) AS unable FROM w)
SELECT id AS operation_id, action, array_to_string(CASE WHEN action = 'resume_cleanup' AND len(unable) > 0 THEN wanted[1:list_position(wanted, unable[1]) - 1]
    WHEN action = 'compensate' AND len(unable) = 0 AND doc % 4 < 2 THEN wanted || ['mongo_failed'] ELSE list_filter(wanted, lambda x: x NOT IN unable) END, ',') AS steps,
  CASE action WHEN 'resume_cleanup' THEN CASE WHEN len(unable) = 0 THEN 'succeeded' ELSE 'cleanup_pending' END WHEN 'compensate' THEN CASE WHEN len(unable) = 0 THEN 'failed' ELSE 'needs_reconciliation' END ELSE status END AS new_status FROM u""")
def recovery_actions(spark, d):
    """Events stand for operations, two for each document; every sixth document is leased by its first one, and stores hold or lack versions by document."""
    e = load(spark, d, "events").withColumn("document_id", F.floor(F.col("event_id") / 2).cast("long"))
    doc, user, none = F.col("document_id"), F.col("user_id"), F.array().cast("array<string>")
    words = lambda xs: F.array(*[F.lit(x) for x in xs])
    delete = F.col("event_type") == "error"
    operations = e.select(
        F.col("event_id").cast("string").alias("operation_id"), F.when(delete, "delete").otherwise("update").alias("operation_type"), "document_id", F.lit(2).cast("long").alias("version"), F.when(user % 4 > 0, F.lit(1).cast("long")).alias("previous_version"),
        F.element_at(words(_STATUSES), (F.col("event_id") % 7 + 1).cast("int")).alias("status"), F.when(delete, words(("mongo_reserved", "mongo_deleting"))).otherwise(F.slice(words(docstore.UPDATE), F.lit(1), (1 + user % 10).cast("int"))).alias("completed"),
        F.when(F.col("event_id") % 3 == 0, words(("graph_deactivated",))).otherwise(none).alias("compensated"),
    )
    docs = e.select("document_id").distinct()
    now = F.lit(_NOW).cast("timestamp")
    locks = docs.where(doc % 3 == 0).select("document_id", (doc * 2).cast("string").alias("operation_id"), F.when(doc % 6 == 0, now + F.expr("interval 1 minute")).otherwise(now).alias("expires_at"))
    held = lambda store, version, status, where: docs.where(where).select(F.lit(store).alias("store"), "document_id", F.lit(version).cast("long").alias("version"), status.alias("status"))
    ready = F.lit("ready")
    now_in = held("registry", 2, F.when(doc % 4 == 0, "processing").when(doc % 4 == 1, "deleting").when(doc % 4 == 2, "deleted").otherwise("ready"), "true").unionByName(held("catalog", 2, ready, "document_id % 5 > 0"))
    for store in docstore.NEEDS_ROWS:
        now_in = now_in.unionByName(held(store, 1, ready, "document_id % 3 > 0"))
    broken = docs.where("document_id % 11 = 0").select("document_id", F.lit("vector_stage_deleted").alias("step")).unionByName(docs.where("document_id % 13 = 0").select("document_id", F.lit("graph_cleaned").alias("step")))
    return docstore.recovery(operations, now_in, locks, now, broken).select("operation_id", "action", F.array_join("steps", ",").alias("steps"), "new_status")


# --- streams

@query("""WITH e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS resource_path, ts, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
  user_id % 12 AS m, event_id % 4 AS k, event_id % 4 + CAST(floor(value) AS BIGINT) % 12 AS n, event_id % 7 = 0 AS bare FROM events),
c AS (SELECT *, CASE WHEN bare THEN n - k + 1 ELSE greatest(0, n - greatest(k, m + 1) + 1) END AS added, CASE WHEN bare THEN 0 ELSE m + 1 - greatest(0, least(n, m) - k + 1) END AS gone, n - k + 1 + CASE WHEN bare THEN 0 ELSE m + 1 END AS lines FROM e)
SELECT event_id, resource_path, operation, row_number() OVER (PARTITION BY resource_path ORDER BY ts, event_id) AS version,
  CASE operation WHEN 'DELETE' THEN -1 WHEN 'INSERT' THEN 1 ELSE CASE WHEN bare THEN 0 WHEN (added + gone) / lines > 0.3 THEN added ELSE greatest(1, added // 10) END END AS chunks_affected,
  CASE operation WHEN 'DELETE' THEN -1 WHEN 'INSERT' THEN 1 ELSE 0 END AS entities_affected FROM c""")
def cdc_consumer(spark, d):
    """Events as changes of users' texts, taken by the consumer from a stream over the file. Every seventh has no text before."""
    from ..streaming import cdc as stream
    from ..streaming.consumer import ChangeConsumer

    at = folder(spark, "changes")
    events = stream.event_stream(spark, f"{d}/event[s].parquet", load(spark, d, "events").schema)
    consumer = ChangeConsumer(spark, f"{at}/tables")
    consumer.start(changes_of(events), f"{at}/checkpoint").awaitTermination()
    return consumer.results().select("event_id", "resource_path", "operation", "version", "chunks_affected", "entities_affected")


def changes_of(events):
    id, user = F.col("event_id"), F.col("user_id")
    text = lambda a, b: F.array_join(F.transform(F.sequence(a, b), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    first = id % 4
    content = lambda c: F.map_from_arrays(F.array(F.lit("content")), F.array(c))
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return events.select(
        id.cast("string").alias("event_id"), op.alias("operation"), user.cast("string").alias("resource_path"), (F.unix_micros("ts") / 1e6).alias("timestamp"),
        F.when(id % 7 != 0, content(text(F.lit(0).cast("long"), user % 12))).alias("before"), content(text(first, first + F.floor("value").cast("long") % 12)).alias("after"),
    )


@query("""WITH RECURSIVE r AS (SELECT user_id AS doc, 'w' || (event_id % 3) AS op, CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END AS kind, ts, 3600 * (1 + event_id % 24) AS secs,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, 'w' || (event_id % 3), CASE WHEN event_type = 'error' THEN 'release' ELSE 'acquire' END) AS n FROM events),
f(doc, n, holder, ends, lost, lost_at, op, asked, outcome) AS (SELECT DISTINCT doc, 0, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR) FROM r
  UNION ALL SELECT r.doc, r.n,
    CASE WHEN kind = 'release' THEN CASE WHEN h = r.op THEN NULL ELSE h END WHEN h IS NOT NULL AND h <> r.op THEN h ELSE r.op END,
    CASE WHEN kind = 'release' THEN CASE WHEN h = r.op THEN NULL ELSE f.ends END WHEN h IS NOT NULL AND h <> r.op THEN f.ends ELSE r.ts + to_seconds(secs) END,
    CASE WHEN f.ends <= r.ts THEN f.holder END, CASE WHEN f.ends <= r.ts THEN f.ends END, r.op, r.ts,
    CASE WHEN kind = 'release' THEN CASE WHEN h = r.op THEN 'released' ELSE 'not_held' END WHEN h IS NULL THEN 'granted' WHEN h = r.op THEN 'renewed' ELSE 'busy' END
  FROM (SELECT *, CASE WHEN ends <= (SELECT ts FROM r x WHERE x.doc = f0.doc AND x.n = f0.n + 1) THEN NULL ELSE holder END AS h FROM f f0) f JOIN r ON r.doc = f.doc AND r.n = f.n + 1)
SELECT doc AS document_id, op AS operation_id, asked AS "at", outcome FROM f WHERE n > 0 UNION ALL SELECT doc, lost, lost_at, 'expired' FROM f WHERE lost IS NOT NULL
UNION ALL SELECT doc, holder, ends, 'expired' FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC) AS l FROM f) WHERE l = 1 AND holder IS NOT NULL""")
def lease_timers(spark, d):
    """Events as requests of three workers for the leases of users; all leases have ended by the end."""
    from ..streaming import timers

    e = load(spark, d, "events")
    wants = e.select(
        F.col("user_id").alias("document_id"), F.concat(F.lit("w"), (F.col("event_id") % 3).cast("string")).alias("operation_id"), F.when(F.col("event_type") == "error", "release").otherwise("acquire").alias("kind"),
        F.col("ts").cast("timestamp").alias("at"), (3600 * (1 + F.col("event_id") % 24)).cast("int").alias("seconds"),
    )
    return timers.lease_outcomes(wants, "2100-01-01 00:00:00")


@query("SELECT doc_id AS id, lang, source, n_chars, sha256(coalesce(text, '')) AS content_hash FROM documents")
def migration_run(spark, d):
    """Documents' identities copied in eight batches by a run that is stopped after three and then resumed; the rows are those of the source."""
    source = load(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars", "text")
    at = folder(spark, "migration")
    change = lambda rows: rows.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).drop("text")
    versions.Migration(spark, at).run(source, 8, change=change, most=3)
    again = versions.Migration(spark, at)
    again.run(source, 8, change=change)
    return again.rows().select("id", "lang", "source", "n_chars", "content_hash")


# --- strict joins, hash trees, point reads

@query("""WITH l AS (SELECT CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 300 END AS k FROM events WHERE event_type <> 'view'), r AS (SELECT item_id AS k FROM benchmark UNION ALL SELECT item_id FROM benchmark WHERE item_id % 9 = 0 UNION ALL SELECT 1000 + item_id FROM benchmark),
n AS (SELECT k, sum(a) AS a, sum(b) AS b, max(odd) AS odd FROM (SELECT k, 1 AS a, 0 AS b, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS odd FROM l UNION ALL SELECT k, 0, 1, CASE WHEN k IS NULL THEN 2 ELSE 0 END FROM r) GROUP BY k, odd),
s AS (SELECT *, CASE WHEN odd > 0 THEN 'no_key' WHEN a > 1 OR b > 1 THEN 'repeated' WHEN b = 0 THEN 'missing_right' WHEN a = 0 THEN 'missing_left' ELSE 'matched' END AS status FROM n)
SELECT status, count(*) AS n_keys, CAST(sum(a) AS BIGINT) AS n_left, CAST(sum(b) AS BIGINT) AS n_right FROM s GROUP BY status""")
def strict_join_report(spark, d):
    """Events as results and items as cases, some without, some with several of the other: where all rows have gone."""
    from ..operators import strict

    id = F.col("event_id")
    results = load(spark, d, "events").where("event_type <> 'view'").select(F.when(id % 97 != 0, id % 300).alias("k"), "value")
    item = load(spark, d, "benchmark").select(F.col("item_id").alias("k"), "text")
    cases = item.unionByName(item.where("k % 9 = 0")).unionByName(item.withColumn("k", F.col("k") + 1000))
    return strict.accounted(strict.one_to_one(results, cases, ["k"]))


@query("""WITH f AS (SELECT source AS tree, CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT tree, sha256(path)[1:3] AS g, sha256(string_agg(path || chr(31) || h, chr(10) ORDER BY path)) AS h, count(*) AS n FROM f GROUP BY ALL),
t AS (SELECT tree, g[1:1] AS d, sha256(string_agg(g || chr(31) || h, chr(10) ORDER BY g)) AS h, sum(n) AS n FROM g GROUP BY ALL)
SELECT tree, CAST(sum(n) AS BIGINT) AS n_files, sha256(string_agg(d || chr(31) || h, chr(10) ORDER BY d)) AS root FROM t GROUP BY tree""")
def tree_roots(spark, d):
    """Sources as trees of documents."""
    from ..sources import files

    docs = load(spark, d, "documents").select(F.col("source").alias("tree"), F.col("doc_id").cast("string").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return files.tree_roots(docs)


@query(f"""WITH {CHUNKS}, c AS (SELECT *, 'p' || (chunk_index // 4) AS parent_id FROM chunks)
SELECT doc_id AS document_id, parent_id, 'c' || chunk_index AS chunk_id, chunk_index, row_number() OVER (PARTITION BY doc_id, parent_id ORDER BY chunk_index) AS nth, sha256(content) AS content_hash FROM c WHERE doc_id % 50 = 0""")
def children_by_parent(spark, d):
    """Windows of all documents laid out by document, four to a parent; the children of all parents of every fiftieth document."""
    from .points import ChunkTable

    at = folder(spark, "chunks")
    rows = _chunks(spark, d).select(
        F.col("doc_id").alias("document_id"), F.lit(1).cast("long").alias("version"), F.concat(F.lit("p"), F.floor(F.col("chunk_index") / 4).cast("string")).alias("parent_id"),
        F.concat(F.lit("c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", F.lit("ready").alias("status"), F.lit(True).alias("is_current"), F.sha2("content", 256).alias("content_hash"),
    )
    table = ChunkTable(spark, f"chunks_{at.rsplit('-', 1)[1]}", at)
    table.write(rows)
    return table.of(rows.where("document_id % 50 = 0")).select("document_id", "parent_id", "chunk_id", "chunk_index", "nth", "content_hash")


@query("""SELECT 'customer:' || c_custkey AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) AND c_acctbal < 0""")
def legacy_entity_deletes(spark, d):
    """Customers of two sources; accounts in credit are mentioned, every twentieth order is an edge."""
    name = lambda c: F.concat(F.lit("customer:"), F.col(c).cast("string"))
    c = load(spark, d, "customer").select(name("c_custkey").alias("name"), F.col("c_mktsegment").alias("source"), "c_acctbal")
    edges = load(spark, d, "orders").where("o_orderkey % 20 = 0").select(name("o_custkey").alias("subject"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("object"))
    sources = spark.createDataFrame([("BUILDING",), ("MACHINERY",)], "source string")
    return graph.legacy_deletes(c.select("name", "source"), c.where("c_acctbal >= 0").select("name"), edges, sources).select("name")
