"""Registered queries over scopes, evidence, operations, versions, summaries and frozen vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import provenance
from ..session import load
from .catalog import query

_HEX = "md5(CAST(doc_id AS VARCHAR))"


@query(rf"""WITH x AS (SELECT source, lang, doc_id, CASE doc_id % 5 WHEN 0 THEN '{{' || {_HEX} || '}}' WHEN 1 THEN upper({_HEX}) WHEN 2 THEN 'urn:uuid:' || {_HEX}
  WHEN 3 THEN substr({_HEX}, 1, 8) || '-' || substr({_HEX}, 9) ELSE CASE WHEN source = 'src3' THEN 'doc-' || doc_id ELSE {_HEX} END END AS document_id FROM documents),
c AS (SELECT source || CASE WHEN lang = 'fr' THEN '/fr' ELSE '' END AS run_id, replace(regexp_replace(regexp_replace(lower(document_id), '^(urn:)?(uuid:)?\{{?', ''), '\}}?$', ''), '-', '') AS b FROM x)
SELECT run_id, count(DISTINCT b) FILTER (regexp_full_match(b, '[0-9a-f]{{32}}')) AS n_documents,
  bool_and(regexp_full_match(b, '[0-9a-f]{{32}}')) AND regexp_full_match(run_id, '[A-Za-z0-9][A-Za-z0-9_.-]{{0,80}}') AS verified FROM c GROUP BY run_id""")
def scope_verification(spark, d):
    """Scopes of documents: some names and identifiers are malformed."""
    h, n = F.md5(F.col("doc_id").cast("string")), F.col("doc_id") % 5
    forms = F.when(n == 0, F.concat(F.lit("{"), h, F.lit("}"))).when(n == 1, F.upper(h)).when(n == 2, F.concat(F.lit("urn:uuid:"), h))
    forms = forms.when(n == 3, F.concat(F.substr(h, F.lit(1), F.lit(8)), F.lit("-"), F.substr(h, F.lit(9), F.lit(24))))
    forms = forms.otherwise(F.when(F.col("source") == "src3", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).otherwise(h))
    run = F.concat("source", F.when(F.col("lang") == "fr", "/fr").otherwise(""))
    return provenance.verified_scopes(load(spark, d, "documents").select(run.alias("run_id"), forms.alias("document_id")))


#: Orders stand for relations: a document is a customer, its version the order's priority, and the key names the evidence.
_FACTS = """r AS (SELECT o_custkey AS document_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS version, 'k' || o_orderkey AS evidence_key, 'clerk:' || (o_orderkey % 50) AS subject,
  CASE WHEN o_orderstatus = 'P' THEN 'MENTIONS' ELSE 'USES' END AS predicate, 'order:' || o_orderkey AS object,
  CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'processing' END AS status, o_orderkey % 3 > 0 AS is_current FROM orders)"""


def _facts(spark, d):
    o = load(spark, d, "orders")
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    return o.select(
        F.col("o_custkey").alias("document_id"), F.substr("o_orderpriority", F.lit(1), F.lit(1)).cast("long").alias("version"),
        F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("evidence_key"), F.concat(F.lit("clerk:"), (F.col("o_orderkey") % 50).cast("string")).alias("subject"),
        F.when(F.col("o_orderstatus") == "P", "MENTIONS").otherwise("USES").alias("predicate"), F.lit(None).cast("string").alias("raw_predicate"), name("order", "o_orderkey").alias("object"),
        F.when(F.col("o_orderstatus") == "F", "ready").otherwise("processing").alias("status"), (F.col("o_orderkey") % 3 > 0).alias("is_current"),
    )


@query(f"""WITH {_FACTS} SELECT document_id, version, row_number() OVER (PARTITION BY document_id, version ORDER BY evidence_key, subject, object) AS nth, evidence_key, subject, predicate, object,
  count(*) OVER (PARTITION BY document_id, version) AS n_evidence FROM r""")
def document_evidence(spark, d):
    return provenance.document_evidence(_facts(spark, d))


@query(f"""WITH {_FACTS}, dv AS (SELECT DISTINCT document_id, version FROM r WHERE document_id % 2 = 0),
m AS (SELECT DISTINCT document_id, version, subject FROM r WHERE hash_ok), a AS (SELECT c_custkey AS document_id FROM customer WHERE c_acctbal > 0)
SELECT document_id, version, evidence_key, subject, predicate, predicate AS raw_predicate, object, 'forward' AS direction FROM r
WHERE predicate <> 'MENTIONS' AND is_current AND status = 'ready' AND document_id IN (SELECT document_id FROM a) AND (document_id, version) IN (SELECT (document_id, version) FROM dv)
  AND (document_id, version, subject) IN (SELECT (document_id, version, subject) FROM m)""".replace("WHERE hash_ok", "WHERE CAST(substr(evidence_key, 2) AS BIGINT) % 4 <> 1"))
def scoped_snapshot(spark, d):
    """Versions of even customers are in force; three quarters of the orders are mentioned; customers in credit are allowed."""
    r = _facts(spark, d)
    v = r.where("document_id % 2 = 0").select("document_id", "version", F.lit(True).alias("is_current"), F.lit("ready").alias("status"))
    m = r.where(F.substr("evidence_key", F.lit(2), F.lit(20)).cast("long") % 4 != 1).select("document_id", "version", F.col("subject").alias("name"))
    allowed = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("document_id"))
    return provenance.scoped_snapshot(v, m, r, allowed)


_LABELS = ("single_hop", "multi_hop", "constraint_multi_hop", "distractor_fact", "unanswerable", "abstention", " Constraint")


@query(f"""WITH r AS (SELECT CASE user_id % 3 WHEN 0 THEN 'vector_only' WHEN 1 THEN 'graph_rag' ELSE 'hybrid' END AS mode, event_id % 500 AS question, {list(_LABELS)}[event_id % 7 + 1] AS label,
  event_type <> 'error' AS ok, event_type IN ('click', 'purchase') AS correct, event_type IN ('click', 'purchase', 'view') AS correct_v2, event_id % 4 > 0 AS source_hit, event_id % 6 > 1 AS abstained, event_id % 10 = 0 AS forbidden,
  (event_id % 11) / 10.0 AS semantic, (event_id % 5) / 4.0 AS keyword, (event_id % 3) / 2.0 AS coverage, CASE WHEN event_id % 2 = 1 THEN (event_id % 7) / 6.0 END AS fidelity, event_id % 3 AS graph_calls, event_id % 4 AS contexts,
  event_id % 3 AS plan, 1 + event_id % 2 AS answer, user_id % 3 AS embedding, floor(value * 100) AS ms FROM events),
c AS (SELECT *, CASE WHEN label IN ('unanswerable', 'abstention') THEN 'abstention' WHEN label LIKE 'distractor%' THEN 'distractor' WHEN lower(trim(label)) LIKE 'constraint%' THEN 'constraint' ELSE label END AS category FROM r),
p AS (SELECT mode, sum(plan) AS plans FROM (SELECT mode, question, max(plan) AS plan FROM r GROUP BY ALL) GROUP BY mode),
w AS (SELECT mode, count(*) AS n, count(*) FILTER (ok) AS s, count(*) FILTER (ok AND correct) AS c1, count(*) FILTER (ok AND correct_v2) AS c2, avg(semantic) FILTER (ok) AS semantic, avg(keyword) FILTER (ok) AS keyword, count(*) FILTER (ok AND source_hit) AS sources,
  avg(coverage) FILTER (ok) AS coverage, count(*) FILTER (ok AND label LIKE '%multi_hop%') AS hops, count(*) FILTER (ok AND label LIKE '%multi_hop%' AND correct) AS hops_right, count(*) FILTER (ok AND label IN ('unanswerable', 'abstention')) AS none,
  count(*) FILTER (ok AND label IN ('unanswerable', 'abstention') AND abstained) AS none_right, avg(fidelity) FILTER (ok) AS fidelity, count(*) FILTER (ok AND forbidden) AS bad, count(*) FILTER (ok AND graph_calls > 0) AS g, count(*) FILTER (ok AND contexts > 0) AS t,
  avg(ms) FILTER (ok) AS ms, list_sort(list(ms) FILTER (ok)) AS sorted, sum(answer) AS answers, sum(embedding) AS embeddings, sum(graph_calls) AS graphs FROM r GROUP BY mode)
SELECT mode, NULL AS category, n AS questions, round(s / n, 3) AS success_rate, round(c1 / n, 3) AS question_accuracy, round(c2 / n, 3) AS question_accuracy_v2, coalesce(round(semantic, 3), 0) AS answer_semantic_score_v2,
  coalesce(round(keyword, 3), 0) AS keyword_fact_hit_rate, coalesce(round(keyword, 3), 0) AS required_fact_hit_rate, round(sources / n, 3) AS source_hit_rate, coalesce(round(coverage, 3), 0) AS source_coverage, round(hops_right / nullif(hops, 0), 3) AS multi_hop_accuracy,
  round(none_right / nullif(none, 0), 3) AS abstention_accuracy, round(fidelity, 3) AS relation_fidelity, round(bad / n, 3) AS forbidden_fact_violation_rate, CASE WHEN mode = 'graph_rag' THEN round(g / n, 3) END AS graph_participation_rate,
  CASE WHEN mode = 'graph_rag' THEN round(t / n, 3) END AS graph_evidence_entering_top_k_rate, round(ms, 3) AS latency_avg_ms, sorted[CAST(ceil(0.5 * s) AS INT)] AS latency_p50_ms, sorted[CAST(ceil(0.95 * s) AS INT)] AS latency_p95_ms,
  CAST(plans + answers AS BIGINT) AS chat_logical_calls, CAST(embeddings AS BIGINT) AS embedding_logical_calls, CAST(graphs AS BIGINT) AS neo4j_logical_calls, NULL AS correct, NULL AS accuracy FROM w JOIN p USING (mode)
UNION ALL SELECT m.mode, k.category, count(c.mode), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(c.mode) FILTER (c.correct_v2), round(count(c.mode) FILTER (c.correct_v2) / nullif(count(c.mode), 0), 3)
  FROM (SELECT DISTINCT mode FROM r) m, (VALUES ('single_hop'), ('multi_hop'), ('constraint'), ('distractor'), ('abstention')) k(category) LEFT JOIN c ON c.mode = m.mode AND c.category = k.category GROUP BY m.mode, k.category""")
def rag_summary(spark, d):
    """Events stand for answers: their kind tells success and correctness, their numbers the scores."""
    u, e, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    return provenance.rag_summary(load(spark, d, "events").select(
        F.when(u % 3 == 0, "vector_only").when(u % 3 == 1, "graph_rag").otherwise("hybrid").alias("mode"), (e % 500).cast("string").alias("question_id"), F.element_at(F.array(*[F.lit(c) for c in _LABELS]), (e % 7 + 1).cast("int")).alias("category"),
        (kind != "error").alias("success"), kind.isin("click", "purchase").alias("correct"), kind.isin("click", "purchase", "view").alias("correct_v2"), (e % 4 > 0).alias("source_hit"), (e % 6 > 1).alias("abstention_correct"), (e % 10 == 0).alias("forbidden"),
        ((e % 11) / 10).alias("semantic_v2"), ((e % 5) / 4).alias("keyword"), ((e % 3) / 2).alias("coverage"), F.when(e % 2 == 1, (e % 7) / 6).alias("fidelity"), (e % 3).alias("graph_calls"), (e % 4).alias("graph_contexts"),
        (e % 3).alias("plan_calls"), (1 + e % 2).alias("answer_calls"), (u % 3).alias("embedding_calls"), F.floor(F.col("value") * 100).cast("double").alias("latency_ms"),
    ))


_STATES = "['pending', 'running', 'compensating', 'cleanup_pending', 'needs_reconciliation', 'succeeded', 'failed']"
_OPS = f"""o AS (SELECT event_id AS operation_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS operation_type, {_STATES}[event_id % 7 + 1] AS status FROM events)"""


def _operations(spark, d):
    states = F.array(*[F.lit(s) for s in ("pending", "running", "compensating", "cleanup_pending", "needs_reconciliation", "succeeded", "failed")])
    return load(spark, d, "events").select(
        F.col("event_id").alias("operation_id"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("operation_type"),
        F.element_at(states, (F.col("event_id") % 7 + 1).cast("int")).alias("status"))


@query(f"WITH {_OPS} SELECT operation_id, operation_type, status FROM o WHERE status IN ('pending', 'running', 'compensating')")
def active_operations(spark, d):
    return provenance.operations_in(_operations(spark, d), provenance.ACTIVE).select("operation_id", "operation_type", "status")


@query("""WITH v AS (SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, event_type AS status FROM events)
SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version) AS nth FROM v""")
def version_lists(spark, d):
    from ..sources import cdc

    v = cdc.versions(load(spark, d, "events"), "user_id", "ts").select(F.col("user_id").alias("document_id"), "version", F.col("event_type").alias("status"))
    return provenance.version_list(v)


@query("SELECT user_id AS document_id, 'n' || (user_id % 3) AS namespace, max(ts) AS updated_at FROM events GROUP BY user_id")
def document_lists(spark, d):
    e = load(spark, d, "events").groupBy(F.col("user_id").alias("document_id")).agg(F.max("ts").alias("updated_at"))
    return provenance.document_list(e.withColumn("namespace", F.concat(F.lit("n"), (F.col("document_id") % 3).cast("string"))))


@query("""WITH docs AS (SELECT doc_id, source FROM documents), q AS (SELECT item_id, 'src' || (item_id % 25) AS filename FROM benchmark),
sd AS (SELECT source AS filename FROM docs WHERE doc_id % 3 = 0), ids AS (SELECT doc_id AS id FROM docs WHERE doc_id % 3 = 0 UNION ALL SELECT -1), qs AS (SELECT item_id AS id FROM q WHERE item_id % 2 = 0 UNION ALL SELECT -2)
SELECT 'unknown_document:' || id AS error FROM ids WHERE id NOT IN (SELECT doc_id FROM docs)
UNION SELECT 'unknown_question:' || id FROM qs WHERE id NOT IN (SELECT item_id FROM q)
UNION SELECT 'missing_source:' || filename FROM q WHERE item_id IN (SELECT id FROM qs) AND filename NOT IN (SELECT filename FROM sd WHERE filename IS NOT NULL)""")
def subset_errors(spark, d):
    """A third of the documents and half of the questions, each with one id that doesn't exist."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string"))).alias("expected_sources"))
    extra = lambda n, name: spark.range(1).select(F.lit(n).cast("long").alias(name))
    ids = docs.where("document_id % 3 = 0").select("document_id").unionByName(extra(-1, "document_id"))
    return provenance.subset(docs, q, ids, q.where("question_id % 2 = 0").select("question_id").unionByName(extra(-2, "question_id")))


@query("""WITH docs AS (SELECT doc_id, source FROM documents), q AS (SELECT item_id, 'src' || (item_id % 20) AS filename FROM benchmark),
missing AS (SELECT count(*) AS n FROM q WHERE item_id % 2 = 0 AND filename NOT IN (SELECT source FROM docs WHERE doc_id % 3 < 2))
SELECT 'document' AS kind, doc_id AS id, doc_id AS position FROM docs, missing WHERE n = 0 AND doc_id % 3 < 2 UNION ALL SELECT 'question', item_id, item_id FROM q, missing WHERE n = 0 AND item_id % 2 = 0""")
def subset_selection(spark, d):
    """Two thirds of the documents and half of the questions, asked for backwards."""
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"), F.col("doc_id").alias("position"))
    q = load(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), F.array(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"))).alias("expected_sources"), F.col("item_id").alias("position"))
    own = provenance.selected(docs, q, docs.where("document_id % 3 < 2").orderBy(F.col("position").desc()).select("document_id"), q.where("question_id % 2 = 0").select("question_id"))
    return own[0].select(F.lit("document").alias("kind"), F.col("document_id").alias("id"), "position").union(own[1].select(F.lit("question"), "question_id", "position"))


@query("""WITH p AS (SELECT item_id AS i, unnest([0, 1]) AS o FROM benchmark)
SELECT 'Q' || i AS question_id, CAST(o AS INTEGER) AS query_ordinal, CASE WHEN i % 9 = 0 AND o = 1 THEN 'invalid_plan' WHEN i % 5 = 0 OR embedding IS NULL THEN 'missing' WHEN i % 11 = 0 THEN 'ambiguous' WHEN i % 7 = 0 OR i % 13 = 0 THEN 'mismatch' ELSE 'ok' END AS status,
  CASE WHEN NOT (i % 9 = 0 AND o = 1) AND i % 5 > 0 AND i % 11 > 0 AND i % 7 > 0 AND i % 13 > 0 THEN list_sum(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT))) END AS vector_sum FROM p LEFT JOIN embeddings ON vec_id = 2 * i + o""")
def frozen_query_vectors(spark, d):
    """A plan of two queries for each item, frozen with vectors of the table; then every fifth item's records are lost, every eleventh's are there twice, every
    seventh's vectors are changed, and every thirteenth plan is another. Every ninth item's second query is blank."""
    n = F.col("item_id")
    plans = load(spark, d, "benchmark").select(F.concat(F.lit("Q"), n.cast("string")).alias("question_id"), F.sha2("text", 256).alias("plan_hash"), F.array(F.col("text"), F.when(n % 9 == 0, " ").otherwise(F.concat(F.lit("again "), "text"))).alias("queries"), "item_id")
    planned = provenance.planned_queries(plans)
    v = load(spark, d, "embeddings").select(F.concat(F.lit("Q"), F.floor(F.col("vec_id") / 2).cast("string")).alias("question_id"), (F.col("vec_id") % 2).cast("int").alias("query_ordinal"), F.col("embedding").cast("array<double>").alias("vector"))
    space = F.lit("provider/model/64/space")
    item = F.substr("question_id", F.lit(2)).cast("long")
    records = provenance.frozen(planned, v, "run", space).where(item % 5 != 0)
    records = records.unionByName(records.where(item % 11 == 0)).withColumn("vector", F.when(item % 7 == 0, F.transform("vector", lambda x: x + 1)).otherwise(F.col("vector")))
    root = provenance.root_hash(records).first().root
    asked = planned.withColumn("plan_hash", F.when(item % 13 == 0, F.lit("another")).otherwise(F.col("plan_hash")))
    got = provenance.frozen_vectors(asked, records, "run", space, 64, root)
    total = F.aggregate(F.transform("vector", lambda x: F.round(x * 1000).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return got.select("question_id", "query_ordinal", "status", total.alias("vector_sum"))


@query("""SELECT user_id, count(*) AS n_plain, count(*) FILTER (event_id % 13 > 0) AS n_traced, count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) AS n_different,
  count(*) FILTER (event_id % 13 = 0 OR event_id % 17 = 0) = 0 AS equivalent FROM events GROUP BY user_id""")
def trace_equivalence(spark, d):
    """Results with traces on lack some rows and have another value in some."""
    e = load(spark, d, "events").select("user_id", "event_id", "event_type")
    traced = e.where("event_id % 13 > 0").withColumn("event_type", F.when(F.col("event_id") % 17 == 0, "other").otherwise(F.col("event_type")))
    return provenance.same_results(e, traced, ["user_id", "event_id"], ["event_type"])
