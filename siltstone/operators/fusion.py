"""Fusing and re-ranking candidate lists: reciprocal rank fusion, score re-ranking, weighted merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("bm25", "vector", "graph")
IDENTITY = ["document_id", "document_version", "chunk_id", "parent_chunk_id", "source"]


def checked(candidates: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Adds `verdict`: ok, or why a row can't be fused. A rank that two rows of a list hold rejects both; ids whose rows
    disagree on identity are rejected everywhere; an id twice in one list is rejected there."""
    bad = ~F.col("retrieval_type").isin(*kinds) | F.col("retrieval_type").isNull() | F.col("rank").isNull() | (F.col("rank") < 1)
    if "eligible" in candidates.columns:
        bad = bad | ~F.coalesce("eligible", F.lit(False))
    same_rank = F.count(F.lit(1)).over(Window.partitionBy("query_id", "retrieval_type", "rank"))
    df = candidates.withColumn("invalid", bad).withColumn("at_rank", same_rank).withColumn("invalid", F.col("invalid") | (F.col("at_rank") > 1))
    identity = F.when(~F.col("invalid"), F.xxhash64(F.lit(0), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY if c in candidates.columns]))
    by_id = Window.partitionBy("query_id", "candidate_id")
    df = df.withColumn("identity", identity)
    df = df.withColumn("conflict", F.coalesce(F.min("identity").over(by_id) != F.max("identity").over(by_id), F.lit(False)))
    twice = F.count(F.when(~F.col("invalid"), 1)).over(Window.partitionBy("query_id", "candidate_id", "retrieval_type")) > 1
    verdict = F.when(F.col("invalid"), "invalid").when(F.col("conflict"), "conflict").when(twice, "duplicate").otherwise("ok")
    return df.withColumn("verdict", verdict).drop("at_rank", "identity", "invalid", "conflict")


def rrf(candidates: DataFrame, k: int = 60, top: int = 30) -> DataFrame:
    """(query_id, candidate_id, rrf_score, n_types, min_rank, fused_rank, retrieval_types, source_ranks): the sum of 1 / (k + rank) over lists."""
    good = checked(candidates).where("verdict = 'ok'")
    fused = good.groupBy("query_id", "candidate_id").agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("rrf_score"), F.countDistinct("retrieval_type").alias("n_types"), F.min("rank").alias("min_rank"),
        F.array_sort(F.collect_set("retrieval_type")).alias("retrieval_types"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("retrieval_type", "rank")))).alias("source_ranks"),
    )
    w = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("n_types").desc(), "min_rank", "candidate_id")
    return fused.withColumn("fused_rank", F.row_number().over(w)).where(F.col("fused_rank") <= top)


def rrf_diagnostics(candidates: DataFrame) -> DataFrame:
    """Per query: rows read, ids that were fused or dropped as duplicates, ids in several lists, and rejections."""
    df = checked(candidates)
    count = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    per = df.groupBy("query_id").agg(F.count(F.lit(1)).alias("input_count"), count("invalid").alias("invalid_count"), F.countDistinct(F.when(F.col("verdict") == "conflict", F.col("candidate_id"))).alias("conflict_count"), F.countDistinct(F.when(F.col("verdict").isin("ok", "duplicate"), F.col("candidate_id"))).alias("unique_count"))
    multi = df.where("verdict = 'ok'").groupBy("query_id", "candidate_id").agg(F.countDistinct("retrieval_type").alias("n")).groupBy("query_id").agg(F.count(F.when(F.col("n") > 1, 1)).alias("multi_source_count"), F.count(F.lit(1)).alias("output_count"))
    return per.join(multi, "query_id", "left").na.fill(0, ["multi_source_count", "output_count"])


def rerank(fused: DataFrame, scores: DataFrame | None, top: int = 12) -> DataFrame:
    """Orders by model score, then fused score, then id. Without scores, or where the scores of a query don't cover its
    candidates exactly with finite numbers, the fused order stands and rerank_score is null."""
    base = fused.withColumnRenamed("fused_rank", "pre_rank")
    if scores is None:
        out = base.withColumn("rerank_score", F.lit(None).cast("double"))
    else:
        finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
        both = base.select("query_id", "candidate_id").withColumn("ours", F.lit(1)).join(scores.select("query_id", "candidate_id", "score"), ["query_id", "candidate_id"], "full")
        whole = both.groupBy("query_id").agg(F.bool_and(F.col("ours").isNotNull() & finite).alias("usable"))
        out = base.join(scores.select("query_id", "candidate_id", "score"), ["query_id", "candidate_id"], "left").join(whole, "query_id")
        out = out.withColumn("rerank_score", F.when(F.col("usable"), F.col("score"))).drop("usable", "score")
    w = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), F.round("rrf_score", 12).desc(), F.when(F.col("rerank_score").isNull(), F.col("pre_rank")), "candidate_id")
    return out.withColumn("post_rank", F.row_number().over(w)).where(F.col("post_rank") <= top)


#: Weights of the older merge orders.
GRAPHRAG_WEIGHTS = {"vector": 1.0, "subgraph": 1.15, "path": 1.25, "community": 1.1}
HYBRID_WEIGHTS = {"graph": 1.2, "hybrid": 1.1}
MODALITY_WEIGHTS = {"pdf": 0.95, "table": 0.9, "image": 0.85}


def weight(kind: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(kind == name, F.lit(w)).otherwise(out)
    return out


def merged(contexts: DataFrame, weights: dict[str, float], prefix: int, top: int | None = None, kind: str = "retrieval_type") -> DataFrame:
    """Weighted scores; of rows with equal first `prefix` characters the first to arrive stays; best first, arrival breaks ties."""
    first = Window.partitionBy("query_id", F.substr(F.col("content"), F.lit(1), F.lit(prefix))).orderBy("arrival")
    df = contexts.withColumn("weighted", F.col("score") * weight(F.col(kind), weights)).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    w = Window.partitionBy("query_id").orderBy(F.round("weighted", 9).desc(), "arrival")
    df = df.withColumn("rank", F.row_number().over(w))
    return df if top is None else df.where(F.col("rank") <= top)


def modality(contexts: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("weighted", 9).desc(), "arrival")
    return contexts.withColumn("weighted", F.col("score") * weight(F.col("modality"), MODALITY_WEIGHTS)).withColumn("rank", F.row_number().over(w))


def confidence(contexts: DataFrame) -> DataFrame:
    """min(mean score, 1) per query; queries without contexts are not in the input and have 0 by definition."""
    return contexts.groupBy("query_id").agg(F.least(F.avg("score"), F.lit(1.0)).alias("confidence"))


def lexical_scores(candidates: DataFrame, queries: DataFrame, text: str = "content") -> DataFrame:
    """A deterministic stand-in for a cross-encoder: the share of distinct query tokens that a candidate holds."""
    from ..functions.text import lexical_tokens

    q = queries.select("query_id", F.array_distinct(lexical_tokens(F.col("query"))).alias("qt"))
    both = candidates.join(F.broadcast(q) if q.limit(50_001).count() <= 50_000 else q, "query_id")
    share = F.size(F.array_intersect("qt", lexical_tokens(F.col(text)))) / F.greatest(F.size("qt"), F.lit(1))
    return both.select("query_id", "candidate_id", share.alias("score"))
