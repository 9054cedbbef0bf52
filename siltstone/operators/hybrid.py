"""Recall over several channels: one candidate schema for lexical, vector and graph hits; graph-supported retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import child_candidate_id, edges_text, graph_candidate_id
from .context import VARIANTS
from .fusion import GRAPHRAG_WEIGHTS, merged
from .graph import paths, shortest_paths, usable

GRAPH_SCORE = 0.8
#: Scores of what graph-supported retrieval adds to vector hits.
SUBGRAPH_SCORE, PATH_SCORE, COMMUNITY_SCORE = 0.75, 0.85, 0.9


def child_candidates(hits: DataFrame, kind: str, source: str = "source") -> DataFrame:
    """Candidates of chunk hits: query_id, doc_id, version, chunk_id, parent_chunk_id, content, source, score, rank."""
    name = child_candidate_id(F.col("chunk_id"), F.col("doc_id"), F.col("version"), F.col("content"))
    return hits.select("query_id", F.lit(kind).alias("retrieval_type"), name.alias("candidate_id"), "rank", F.col("score").alias("raw_score"), F.col("doc_id").cast("string").alias("document_id"), F.col("version").cast("int").alias("document_version"), "chunk_id", "parent_chunk_id", F.substring_index(F.translate(F.col(source), "\\", "/"), "/", -1).alias("source"), "content")


def graph_candidates(found: DataFrame) -> DataFrame:
    """Candidates of paths: query_id, rank, edges (array of subject, predicate, object, direction, evidence_key, document_id, version)."""
    content = edges_text(F.col("edges"))
    return found.select(
        "query_id", F.lit("graph").alias("retrieval_type"), graph_candidate_id(F.col("edges.evidence_key"), content).alias("candidate_id"), "rank", F.lit(GRAPH_SCORE).alias("raw_score"),
        F.col("edges")[0]["document_id"].cast("string").alias("document_id"), F.col("edges")[0]["version"].cast("int").alias("document_version"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("parent_chunk_id"), F.lit("graph").alias("source"), content.alias("content"),
    )


def graph_recall(entities: DataFrame, edges: DataFrame, hops: int = 2, top: int = 10, per_entity: int = 50, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, start, hops, edge_ids): the entities' neighbourhoods one after the other, up to `top` of a query.
    entities: query_id, pos, name."""
    found = paths(usable(edges, allowed), entities.select("name").distinct(), hops, per_entity)
    both = entities.join(found, entities["name"] == found["start"])
    w = Window.partitionBy("query_id").orderBy("pos", "hops", "edge_ids", "directions")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query_id", "rank", "start", "hops", "edge_ids")


def recall(variant: str, **channels: DataFrame) -> DataFrame:
    """The candidate lists (bm25, vector, graph) that a named variant fuses, as one table."""
    parts = [channels[k] for k in VARIANTS[variant] if k in channels]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def facts(found: DataFrame) -> DataFrame:
    """(query_id, content, sources): equal facts once, with all of their sources."""
    return found.groupBy("query_id", "content").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def entity_pairs(entities: DataFrame, reach: int = 3) -> DataFrame:
    """(query_id, source, target) of entities less than `reach` places apart."""
    a, b = entities.select("query_id", F.col("pos").alias("i"), F.col("name").alias("source")), entities.select("query_id", F.col("pos").alias("j"), F.col("name").alias("target"))
    return a.join(b, "query_id").where((F.col("j") > F.col("i")) & (F.col("j") < F.col("i") + reach)).select("query_id", "source", "target")


def graphrag(vector_hits: DataFrame, entities: DataFrame, edges: DataFrame, summaries: DataFrame | None = None, top: int = 8) -> DataFrame:
    """(query_id, content, retrieval_type, weighted, rank): vector hits, facts around the entities, shortest paths between neighbouring
    entities and community summaries, weighted by kind and without repeats. edges: edge_id, subject, predicate, object, source."""
    text = F.concat_ws(" ", "subject", "predicate", "object")
    line = edges.select("edge_id", text.alias("fact"), "source")
    near = entities.join(paths(edges, entities.select("name").distinct(), 1, 50), F.col("name") == F.col("start")).select("query_id", F.explode("edge_ids").alias("edge_id")).distinct().join(line, "edge_id")
    sub = facts(near.withColumnRenamed("fact", "content")).select("query_id", "content", F.lit("subgraph").alias("retrieval_type"), F.lit(SUBGRAPH_SCORE).alias("score"))
    pairs = entity_pairs(entities)
    found = shortest_paths(edges, pairs, 3, 1).select("source", "target", F.posexplode("edge_ids").alias("p", "edge_id")).join(line.drop("source"), "edge_id")
    route = found.groupBy("source", "target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "fact"))), lambda x: x["fact"]), " -> ").alias("content"))
    path = pairs.join(route, ["source", "target"]).select("query_id", "content", F.lit("path").alias("retrieval_type"), F.lit(PATH_SCORE).alias("score"))
    parts = vector_hits.select("query_id", "content", F.lit("vector").alias("retrieval_type"), "score").unionByName(sub).unionByName(path)
    if summaries is not None:
        parts = parts.unionByName(summaries.select("query_id", "content", F.lit("community").alias("retrieval_type"), F.lit(COMMUNITY_SCORE).alias("score")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "retrieval_type", "content")
    return merged(parts.withColumn("arrival", F.row_number().over(w)), GRAPHRAG_WEIGHTS, 80, top).select("query_id", "content", "retrieval_type", "weighted", "rank")
