"""From ranked candidates to a context: expansion to parents, the token budget, and the whole build."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, token_estimate
from .fusion import rerank, rrf
from .retrieval import scoped

TOP, BUDGET = 8, 6000


def expand(candidates: DataFrame, parents: DataFrame, allowed: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """(query_id, context_id, kind, content, estimated_token_count, final_rank, supporting_ids, child ids, fallback ...).

    candidates: query_id, candidate_id, content, document_id, document_version, chunk_id, parent_chunk_id, retrieval_types,
    rrf_score, post_rank. Graph evidence stands alone; a candidate whose parent is missing, not ready, not current or out of
    scope falls back to itself; the children of one parent become one context at the rank of the best of them."""
    c = candidates if allowed is None else candidates.join(allowed.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")
    graph = F.array_contains("retrieval_types", "graph")
    named = F.lit(enabled) & F.coalesce(F.col("parent_chunk_id") != "", F.lit(False)) & F.col("document_id").isNotNull() & F.col("document_version").isNotNull()
    p = parents.where("kind = 'parent' and status = 'ready' and is_current").select("document_id", "document_version", F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_content"), F.col("estimated_token_count").alias("parent_tokens"))
    both = c.join(p, ["document_id", "document_version", "parent_chunk_id"], "left")
    kind = F.when(graph, "graph_evidence").when(named & F.col("parent_content").isNotNull(), "parent").otherwise("child_fallback")
    both = both.withColumn("kind", kind).withColumn("own_tokens", token_estimate(F.col("content")))
    key = F.when(F.col("kind") == "parent", F.concat(F.lit("parent:"), F.col("document_id").cast("string"), F.lit(":v"), F.col("document_version").cast("string"), F.lit(":"), F.col("parent_chunk_id")))
    both = both.withColumn("context_id", F.coalesce(key, F.when(F.col("kind") == "graph_evidence", F.concat(F.lit("graph:"), F.col("candidate_id"))).otherwise(F.concat(F.lit("child:"), F.col("candidate_id")))))
    child = F.coalesce("chunk_id", "candidate_id")
    best = F.array_sort(F.collect_list(F.struct("post_rank", "candidate_id", child.alias("child"), "content", "own_tokens", "rrf_score")))
    out = both.groupBy("query_id", "context_id", "kind").agg(best.alias("m"), F.first("parent_content").alias("parent_content"), F.first("parent_tokens").alias("parent_tokens"))
    is_parent = F.col("kind") == "parent"
    return out.select(
        "query_id", "context_id", "kind",
        F.when(is_parent, F.col("parent_content")).otherwise(F.col("m")[0]["content"]).alias("content"),
        F.when(is_parent, F.col("parent_tokens")).otherwise(F.col("m")[0]["own_tokens"]).cast("long").alias("estimated_token_count"),
        F.col("m")[0]["post_rank"].alias("final_rank"), F.col("m")[0]["rrf_score"].alias("rrf_score"),
        F.array_distinct(F.col("m.candidate_id")).alias("supporting_candidate_ids"), F.array_distinct(F.col("m.child")).alias("supporting_child_ids"),
        F.when(is_parent, F.col("m")[0]["content"]).alias("fallback_content"), F.when(is_parent, F.col("m")[0]["own_tokens"]).cast("long").alias("fallback_tokens"),
    )


def expansion_diagnostics(candidates: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per query: candidates in, contexts out, and contexts of each kind."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"{kind}_count")
    got = expanded.groupBy("query_id").agg(F.count(F.lit(1)).alias("context_count"), n("parent"), n("child_fallback"), n("graph_evidence"))
    return candidates.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidate_count")).join(got, "query_id", "left").na.fill(0)


def budgeted(contexts: DataFrame, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(query_id, context_id, position, accepted, reason, tokens): greedy in rank order; what doesn't fit tries its fallback,
    else is skipped, and later smaller ones may still fit. A fold over the query's few contexts, in codegen-free but JVM-side code."""
    fields = F.array_sort(F.collect_list(F.struct("final_rank", "context_id", F.col("estimated_token_count").alias("t"), F.col("fallback_tokens").alias("f"))))
    fold = f"""aggregate(items, cast(struct(0 as n, 0 as used, array() as out) as struct<n:bigint,used:bigint,out:array<struct<context_id:string,position:bigint,accepted:boolean,reason:string,tokens:bigint>>>),
      (s, x) -> case
        when s.n >= {top} then named_struct('n', s.n, 'used', s.used, 'out', concat(s.out, array(named_struct('context_id', x.context_id, 'position', cast(null as bigint), 'accepted', false, 'reason', 'top_k_truncated', 'tokens', 0L))))
        when x.t <= {budget} - s.used then named_struct('n', s.n + 1, 'used', s.used + x.t, 'out', concat(s.out, array(named_struct('context_id', x.context_id, 'position', s.n + 1, 'accepted', true, 'reason', 'fits', 'tokens', x.t))))
        when x.f is not null and x.f <= {budget} - s.used then named_struct('n', s.n + 1, 'used', s.used + x.f, 'out', concat(s.out, array(named_struct('context_id', x.context_id, 'position', s.n + 1, 'accepted', true, 'reason', 'parent_to_child_fallback', 'tokens', x.f))))
        else named_struct('n', s.n, 'used', s.used, 'out', concat(s.out, array(named_struct('context_id', x.context_id, 'position', cast(null as bigint), 'accepted', false, 'reason', 'budget_exceeded', 'tokens', 0L)))) end, s -> s.out)"""
    each = contexts.groupBy("query_id").agg(fields.alias("items")).select("query_id", F.explode(F.expr(fold)).alias("d"))
    return each.select("query_id", "d.context_id", "d.position", "d.accepted", "d.reason", "d.tokens")


def build(candidates: DataFrame, details: DataFrame, parents: DataFrame, scores: DataFrame | None = None, allowed: DataFrame | None = None, rerank_in: int = 30, rerank_out: int = 12, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """The final contexts of each query: fuse, re-rank, expand, pack.

    candidates: query_id, retrieval_type, candidate_id, rank (and identity columns); details: what `expand` needs of each
    candidate_id. The scope applies before anything is ranked."""
    if allowed is not None:
        candidates = scoped(candidates, allowed.select(F.col("doc_id").alias("document_id")), "document_id")
    ranked = rerank(rrf(candidates, top=rerank_in), scores, rerank_out)
    full = ranked.join(details, "candidate_id")
    expanded = expand(full, parents, allowed)
    packed = budgeted(expanded, top, budget).where("accepted")
    return packed.join(expanded, ["query_id", "context_id"]).select(
        "query_id", F.col("position").alias("final_position"), "context_id", "kind", "reason", "tokens",
        F.when(F.col("reason") == "parent_to_child_fallback", F.col("fallback_content")).otherwise(F.col("content")).alias("content"), "supporting_child_ids",
    )


#: Names of variants, and the lists that each fuses.
VARIANTS = {
    "vector_only": ("vector",), "bm25_only": ("bm25",), "graph_only": ("graph",), "vector_bm25": ("vector", "bm25"),
    "vector_graph": ("vector", "graph"), "bm25_graph": ("bm25", "graph"), "hybrid": ("bm25", "vector", "graph"),
}


def variant(candidates: DataFrame, name: str) -> DataFrame:
    return candidates.where(F.col("retrieval_type").isin(*VARIANTS[name]))


def prompt(contexts: DataFrame) -> DataFrame:
    """(query_id, prompt): contexts in order with index, source, type and score."""
    line = F.format_string("[%d] (%s, %s, %.2f)\n%s", F.col("rank").cast("int"), basename(F.coalesce("source", F.lit(""))), F.col("retrieval_type"), F.col("score").cast("double"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return contexts.groupBy("query_id").agg(rows.alias("r")).select("query_id", F.array_join(F.col("r.line"), "\n\n").alias("prompt"))


def query_plans(plans: DataFrame) -> DataFrame:
    """Trims, drops blanks and repeats of the arrays queries, entities and keywords, in their order."""
    tidy = lambda c: F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")).alias(c)
    return plans.select(*[tidy(c) if c in ("queries", "entities", "keywords") else F.col(c) for c in plans.columns])


def numbered(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
