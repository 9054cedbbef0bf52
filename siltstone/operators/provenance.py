"""Where facts come from: scopes, evidence of documents and versions, operations, subsets of fixtures, frozen vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

#: States of operations that hold a document, and of those that recovery has to look at.
ACTIVE = ("pending", "running", "compensating")
INCOMPLETE = ("running", "compensating", "cleanup_pending", "needs_reconciliation")
#: Fixed value: categories of the summary.
CATEGORIES = ("single_hop", "multi_hop", "constraint", "distractor", "abstention")


def canonical_uuid(c: Column) -> Column:
    """The lower-case hyphenated form of an identifier with or without hyphens, braces or a urn prefix; null if it is none."""
    bare = F.replace(F.regexp_replace(F.lower(c), r"^(?:urn:)?(?:uuid:)?\{?|\}?$", ""), F.lit("-"))
    return F.when(bare.rlike(r"\A[0-9a-f]{32}\z"), F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"))


def verified_scopes(scopes: DataFrame, run: str = r"\A[A-Za-z0-9][A-Za-z0-9_.-]{0,80}\z") -> DataFrame:
    """(run_id, n_documents, verified) of scopes (run_id, document_id): all identifiers must be valid and the run's name too.
    A run whose document is null or no identifier isn't verified, so that nothing passes by mistake."""
    each = scopes.withColumn("_id", canonical_uuid(F.col("document_id")))
    got = each.groupBy("run_id").agg(F.countDistinct("_id").alias("n_documents"), F.bool_and(F.col("_id").isNotNull()).alias("ok"))
    name = F.coalesce(F.col("run_id").rlike(run), F.lit(False))
    return got.select("run_id", "n_documents", (name & F.col("ok") & (F.col("n_documents") > 0)).alias("verified"))


def document_evidence(edges: DataFrame) -> DataFrame:
    """(document_id, version, nth, evidence_key, subject, predicate, object, n_evidence): the evidence of each version in order of keys."""
    per = Window.partitionBy("document_id", "version")
    out = edges.where("document_id is not null").withColumn("nth", F.row_number().over(per.orderBy("evidence_key", "subject", "object")))
    return out.withColumn("n_evidence", F.count(F.lit(1)).over(per)).select("document_id", "version", "nth", "evidence_key", "subject", "predicate", "object", "n_evidence")


def scoped_snapshot(versions: DataFrame, mentions: DataFrame, edges: DataFrame, allowed: DataFrame, current: bool = True) -> DataFrame:
    """Relations of allowed documents whose subject a current, ready version of the same document mentions.

    versions: document_id, version, is_current, status; mentions: document_id, version, name; edges: document_id, version, subject,
    predicate, raw_predicate, object, evidence_key, status, is_current. All joins are by document and version."""
    ids = allowed.select("document_id").where("document_id is not null").distinct()
    ready = versions.where("is_current and status = 'ready'").select("document_id", "version").join(ids, "document_id", "left_semi").distinct()
    facts = edges.where("predicate <> 'MENTIONS'")
    facts = facts.where("is_current and status = 'ready'") if current else facts.where(F.col("status").isin("processing", "ready", "failed", "deleted"))
    named = mentions.select("document_id", "version", F.col("name").alias("subject")).distinct()
    out = facts.join(ready, ["document_id", "version"], "left_semi").join(named, ["document_id", "version", "subject"], "left_semi")
    raw = F.coalesce("raw_predicate", "predicate").alias("raw_predicate")
    return out.select("document_id", "version", "evidence_key", "subject", "predicate", raw, "object", F.lit("forward").alias("direction"))


def summary_category(c: Column) -> Column:
    """The category of the summary that a label belongs to; a label that is none stays, folded."""
    name = F.lower(F.trim(c))
    return F.when(name.isin("unanswerable", "abstention"), "abstention").when(name.startswith("distractor"), "distractor").when(name.startswith("constraint"), "constraint").otherwise(name)


def rag_summary(results: DataFrame) -> DataFrame:
    """The summary of answers per mode, and how many of each category are right; one row per mode with `category` null, and one per mode and
    category of CATEGORIES, also those without any question.

    results: mode, question_id, category, success, correct, correct_v2, source_hit, abstention_correct, forbidden (booleans), semantic_v2, keyword, coverage,
    fidelity (scores, fidelity may be null), graph_calls, graph_contexts, plan_calls, answer_calls, embedding_calls, latency_ms. Rates are over all questions
    and count successful answers; means, and percentiles by nearest rank, are of successful answers. A question's plan is made once for
    a mode, so its calls count once. Graph rates are those of graph_rag alone."""
    done = F.coalesce(F.col("success"), F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.count(F.lit(1))
    over = lambda c: F.sum(c.cast("int"))
    rate = lambda c: F.round(over(done & c) / n, 3)
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(done, F.col(c))), 3), F.lit(0.0))
    among = lambda some, c: F.round(over(done & some & c) / F.nullif(over(done & some), F.lit(0)), 3)
    graph = lambda c: F.when(F.col("mode") == "graph_rag", c)
    calls = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    rank = lambda p: F.round(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY IF(success, latency_ms, NULL))"), 3)
    hops, none = F.contains(F.col("category"), F.lit("multi_hop")), F.col("category").isin("unanswerable", "abstention")
    plans = results.groupBy("mode", "question_id").agg(F.max(F.coalesce("plan_calls", F.lit(0))).alias("plan")).groupBy("mode").agg(F.sum("plan").cast("long").alias("plans"))
    whole = results.groupBy("mode").agg(
        n.alias("questions"), rate(F.lit(True)).alias("success_rate"), rate(yes("correct")).alias("question_accuracy"), rate(yes("correct_v2")).alias("question_accuracy_v2"),
        mean("semantic_v2").alias("answer_semantic_score_v2"), mean("keyword").alias("keyword_fact_hit_rate"), mean("keyword").alias("required_fact_hit_rate"), rate(yes("source_hit")).alias("source_hit_rate"),
        mean("coverage").alias("source_coverage"), among(hops, yes("correct")).alias("multi_hop_accuracy"), among(none, yes("abstention_correct")).alias("abstention_accuracy"),
        F.round(F.avg(F.when(done, F.col("fidelity"))), 3).alias("relation_fidelity"), rate(yes("forbidden")).alias("forbidden_fact_violation_rate"),
        graph(rate(F.col("graph_calls") > 0)).alias("graph_participation_rate"), graph(rate(F.col("graph_contexts") > 0)).alias("graph_evidence_entering_top_k_rate"),
        F.round(F.avg(F.when(done, F.col("latency_ms"))), 3).alias("latency_avg_ms"), rank(0.5).alias("latency_p50_ms"), rank(0.95).alias("latency_p95_ms"),
        calls("answer_calls").alias("answers"), calls("embedding_calls").alias("embedding_logical_calls"), calls("graph_calls").alias("neo4j_logical_calls"),
    )
    whole = whole.join(plans, "mode").withColumn("chat_logical_calls", F.col("plans") + F.col("answers")).drop("plans", "answers")
    told = results.withColumn("of", summary_category(F.col("category"))).groupBy("mode", "of").agg(over(yes("correct_v2")).alias("right"), n.alias("all"))
    every = results.select("mode").distinct().select("mode", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("of"))
    per = every.join(told, ["mode", "of"], "left").select("mode", F.col("of").alias("category"), F.coalesce("right", F.lit(0)).cast("long").alias("correct"), F.coalesce("all", F.lit(0)).alias("questions"), F.round(F.col("right") / F.col("all"), 3).alias("accuracy"))
    return whole.unionByName(per, allowMissingColumns=True)


def operations_in(operations: DataFrame, states: tuple[str, ...]) -> DataFrame:
    return operations.where(F.col("status").isin(*states))


def version_list(versions: DataFrame) -> DataFrame:
    """All versions of each document, from the first on, with their place."""
    w = Window.partitionBy("document_id").orderBy("version")
    return versions.withColumn("nth", F.row_number().over(w))


def document_list(documents: DataFrame, namespace: str | None = None) -> DataFrame:
    """Documents (document_id, namespace, updated_at, ...), of one namespace if it is given, latest first; sorted over all partitions."""
    own = documents if namespace is None else documents.where(F.col("namespace") == namespace)
    return own.orderBy(F.col("updated_at").desc(), "document_id")


def subset(documents: DataFrame, questions: DataFrame, document_ids: DataFrame, question_ids: DataFrame) -> DataFrame:
    """(error): why a selection of a fixture can't be used: unknown ids, nothing selected, a question whose source isn't selected.
    documents: document_id, filename; questions: question_id, expected_sources. No row: the selection is good."""
    docs = documents.join(document_ids.select("document_id").distinct(), "document_id", "left_semi")
    asked = questions.join(question_ids.select("question_id").distinct(), "question_id", "left_semi")
    a = document_ids.join(documents, "document_id", "left_anti").select(F.concat(F.lit("unknown_document:"), F.col("document_id").cast("string")).alias("error"))
    b = question_ids.join(questions, "question_id", "left_anti").select(F.concat(F.lit("unknown_question:"), F.col("question_id").cast("string")))
    wants = asked.select("question_id", F.explode("expected_sources").alias("filename"))
    c = wants.join(docs.select("filename").distinct(), "filename", "left_anti").select(F.concat(F.lit("missing_source:"), F.col("filename")))
    empty = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(name))
    return a.union(b).union(c).union(empty(docs, "no_documents")).union(empty(asked, "no_questions")).distinct()


def selected(documents: DataFrame, questions: DataFrame, document_ids: DataFrame, question_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents and the questions of a selection, in the fixture's order (column `position`), whatever the order asked for; nothing if `subset` finds
    any error, so that no part of a selection passes for the whole."""
    good = subset(documents, questions, document_ids, question_ids).agg((F.count(F.lit(1)) == 0).alias("good")).where("good").select()
    own = lambda df, ids, id: df.join(ids.select(id).distinct(), id, "left_semi").join(F.broadcast(good), F.lit(True), "left_semi").orderBy("position")
    return own(documents, document_ids, "document_id"), own(questions, question_ids, "question_id")


def planned_queries(plans: DataFrame) -> DataFrame:
    """(question_id, query_ordinal, query_text_sha256, plan_hash, valid) of plans (question_id, plan_hash, queries): ordinals from 0. Not valid: a plan without
    question or hash, a blank query, a question's ordinal that comes twice."""
    each = plans.select(F.coalesce("question_id", F.lit("")).alias("question_id"), F.coalesce("plan_hash", F.lit("")).alias("plan_hash"), F.posexplode_outer("queries").alias("query_ordinal", "query"))
    query = strip(F.coalesce("query", F.lit("")))
    alone = F.count(F.lit(1)).over(Window.partitionBy("question_id", "query_ordinal")) == 1
    return each.select("question_id", "query_ordinal", F.sha2(query, 256).alias("query_text_sha256"), "plan_hash", ((F.col("question_id") != "") & (F.col("plan_hash") != "") & (query != "") & alone).alias("valid"))


def vector_hash(v: Column) -> Column:
    """SHA-256 of a vector as a JSON array of numbers."""
    return F.sha2(F.to_json(F.transform(v, lambda x: x.cast("double"))), 256)


RECORD = ("run_id", "question_id", "query_ordinal", "query_text_sha256", "plan_hash", "embedding", "vector_dimension", "vector_sha256")


def record_hash(prefix: str = "") -> Column:
    """SHA-256 of a record's identity: all but the vector itself and this hash."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in RECORD])), 256)


def frozen(planned: DataFrame, vectors: DataFrame, run_id: str, embedding: Column) -> DataFrame:
    """Snapshot records of planned queries with their vectors (question_id, query_ordinal, vector)."""
    rows = planned.where("valid").join(vectors.select("question_id", "query_ordinal", "vector"), ["question_id", "query_ordinal"]).select(
        F.lit(run_id).alias("run_id"), "question_id", "query_ordinal", "query_text_sha256", "plan_hash", embedding.alias("embedding"), F.size("vector").alias("vector_dimension"), vector_hash(F.col("vector")).alias("vector_sha256"), "vector")
    return rows.withColumn("snapshot_hash", record_hash())


def root_hash(records: DataFrame) -> DataFrame:
    """(n, root): how many records a snapshot has, and a hash of all that doesn't depend on their order."""
    return records.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.coalesce(F.sum(F.conv(F.substr("snapshot_hash", F.lit(1), F.lit(15)), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string"), 256).alias("root"))


def frozen_vectors(planned: DataFrame, records: DataFrame, run_id: str, embedding: Column, dimension: int, root: str | None) -> DataFrame:
    """(question_id, query_ordinal, status, vector) of planned queries against a snapshot's records. root: what `root_hash` gave when it was complete.

    `incomplete` without a root, `root_mismatch` if records came, went or changed since; `invalid_plan`; `missing` or `ambiguous` unless one record is of
    the question and ordinal; `mismatch` unless run, plan, text, embedding, dimension, finite numbers and both hashes are right. Only `ok` has a vector."""
    right = (
        (F.col("r.run_id") == run_id) & (F.col("r.plan_hash") == F.col("plan_hash")) & (F.col("r.query_text_sha256") == F.col("query_text_sha256")) & (F.col("r.embedding") == embedding)
        & (F.col("r.vector_dimension") == dimension) & (F.size("r.vector") == dimension) & F.forall("r.vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & (F.col("r.vector_sha256") == vector_hash(F.col("r.vector"))) & (F.col("r.snapshot_hash") == record_hash("r."))
    )
    now = root_hash(records).select("root")
    held = records.select("question_id", "query_ordinal", F.struct(*records.columns).alias("r")).groupBy("question_id", "query_ordinal").agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    both = planned.join(held, ["question_id", "query_ordinal"], "left").crossJoin(F.broadcast(now))  # one row
    status = (
        F.when(F.lit(root is None), "incomplete").when(F.col("root") != F.lit(root), "root_mismatch").when(~F.col("valid"), "invalid_plan").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous")
        .when(F.coalesce(right, F.lit(False)), "ok").otherwise("mismatch")
    )
    return both.select("question_id", "query_ordinal", status.alias("status"), F.when(status == "ok", F.col("r.vector")).alias("vector"))


def same_results(plain: DataFrame, traced: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(query key, n_plain, n_traced, n_different, equivalent): whether switching traces on changed any result."""
    a = plain.select(*keys, F.xxhash64(*values).alias("a"), F.lit(1).alias("in_a"))
    b = traced.select(*keys, F.xxhash64(*values).alias("b"), F.lit(1).alias("in_b"))
    both = a.join(b, keys, "full").groupBy(keys[0])
    got = both.agg(F.count("in_a").alias("n_plain"), F.count("in_b").alias("n_traced"), F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("n_different"))
    return got.withColumn("equivalent", F.col("n_different") == 0)
