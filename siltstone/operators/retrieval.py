"""Lexical and vector search for many queries at once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..functions.text import lexical_tokens
from ..storage import staged

K1, B = 1.5, 0.75
#: Queries of one pass over the vectors: what a task holds besides a batch.
QUERY_BLOCK = 4096
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marks df for broadcast if it has at most `rows` rows; otherwise leaves the strategy to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scoped(df: DataFrame, allowed: DataFrame | None, on: str = "doc_id") -> DataFrame:
    """Rows whose document is allowed. None means no scope; an empty scope lets nothing through."""
    return df if allowed is None else df.join(allowed.select(on).distinct(), on, "left_semi")


def eligible(df: DataFrame) -> DataFrame:
    """Rows of ready, current documents."""
    return df.where((F.col("status") == "ready") & F.col("is_current"))


def bm25_index(chunks: DataFrame, chunk: list[str] | None = None, text: str = "content") -> DataFrame:
    """(*chunk, len, terms, counts) of each chunk, staged: its tokens by the exact folding, counted within the row. Nothing is exchanged."""
    chunk = chunk or ["doc_id", "chunk_index"]
    kinds = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in chunk)
    return staged(chunks.select(*chunk, F.col(text).alias("_text")).mapInArrow(_counted(chunk), f"{kinds}, len int, terms array<string>, counts array<int>"), "bm25")


def _counted(chunk: list[str]):
    def run(batches):
        for batch in batches:
            held = [exact.tokens(x) for x in batch.column("_text").to_pylist()]
            each = [Counter(x) for x in held]
            at = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
            terms = pa.array([t for x in each for t in x], pa.string())
            counts = pa.array([n for x in each for n in x.values()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in chunk], pa.array([len(x) for x in held], pa.int32()), pa.ListArray.from_arrays(pa.array(at), terms), pa.ListArray.from_arrays(pa.array(at), counts)],
                names=[*chunk, "len", "terms", "counts"],
            )

    return run


def bm25(queries: DataFrame, chunks: DataFrame, k: int, query: str = "query_id", query_text: str = "query", chunk: list[str] | None = None, text: str = "content", allowed: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query, *chunk, score, rank): the k best chunks of each query.

    A query term counts as often as it occurs in the query. Statistics are over all chunks; the scope comes after, and before ranking. Chunks are
    read and tokenised once, into an index (given, or made here) of terms with their counts; it is read once for the statistics, of which one
    row for each query term comes back, and once for each QUERY_BLOCK queries for the scores. A task keeps the k best chunks of each query, so only those are exchanged."""
    chunk = chunk or ["doc_id", "chunk_index"]
    index = bm25_index(chunks, chunk, text) if index is None else index
    whole = index.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avgdl")).first()
    asked = queries.select(F.col(query).alias("q"), F.col(query_text).alias("text"))
    kinds = ", ".join(f"{c} {index.schema[c].dataType.simpleString()}" for c in chunk)
    schema = f"q {queries.schema[query].dataType.simpleString()}, {kinds}, score double"
    pool, out = scoped(index, allowed, chunk[0]), None
    for rows in blocks_of(asked, "q"):
        found = _Block([r.q for r in rows], [r.text for r in rows])
        if not found.terms:
            continue
        names = asked.sparkSession.createDataFrame([(t,) for t in found.terms], "term string")
        df = index.select(F.explode("terms").alias("term")).join(F.broadcast(names), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # of one block's queries
        found.weigh({r.term: r.df for r in df.collect()}, whole.n)
        part = pool.mapInArrow(_best(found, chunk, whole.avgdl, k), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = asked.sparkSession.createDataFrame([], schema)
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), *chunk)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query), *chunk, "score", "rank")


class _Block:
    """The queries of a block, by term: which of them ask for it, and its weight for each."""

    def __init__(self, names: list, texts: list[str | None]):
        self.names = names
        asked: dict[str, list[tuple[int, int]]] = {}
        for q, text in enumerate(texts):
            for term, times in Counter(exact.tokens(text)).items():
                asked.setdefault(term, []).append((q, times))
        self.terms = {t: i for i, t in enumerate(asked)}
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in asked.values()]))).astype(np.int64)
        self.query = np.array([q for x in asked.values() for q, _ in x], np.int64)
        self.weight = np.array([n for x in asked.values() for _, n in x], np.float64)

    def weigh(self, df: dict[str, int], n: int) -> None:
        held = np.array([df.get(t, 0) for t in self.terms], np.float64)
        self.weight *= np.repeat(np.log(1 + (n - held + 0.5) / (held + 0.5)), np.diff(self.at))

    def scores(self, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
        """rows x queries, from postings (row, term, part)."""
        n = self.at[term + 1] - self.at[term]
        place = np.repeat(self.at[term], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        flat = np.bincount(np.repeat(row, n) * len(self.names) + self.query[place], np.repeat(part, n) * self.weight[place], rows * len(self.names))
        return flat.reshape(rows, len(self.names))


def _best(found: _Block, chunk: list[str], avgdl: float, k: int):
    """Each task's k best chunks of each query, ties by the chunk's columns."""
    def run(batches):
        held: list[pd.DataFrame] = []

        def kept() -> pd.DataFrame:
            whole = pd.concat(held).sort_values(["_q", "score", *chunk], ascending=[True, False, *[True] * len(chunk)], kind="stable")
            return whole.groupby("_q", sort=False).head(k)

        kind = pa.array(found.names).type
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch, [(c, "ascending") for c in chunk]))
            terms = batch.column("terms")
            row = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
            term = np.fromiter((found.terms.get(t, -1) for t in terms.flatten().to_pylist()), np.int64, len(row))
            tf, size = batch.column("counts").flatten().to_numpy().astype(np.float64), batch.column("len").to_numpy()
            some = term >= 0
            row, term, tf = row[some], term[some], tf[some]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / avgdl))
            score = np.round(found.scores(row, term, part, batch.num_rows), 8)
            top = np.argsort(-score, axis=0, kind="stable")[:k]
            best = np.take_along_axis(score, top, 0)
            at, q = np.nonzero(best > 0)
            own = batch.select(chunk).take(pa.array(top[at, q])).to_pandas()
            held.append(own.assign(_q=q, score=best[at, q]))
            if sum(map(len, held)) > 4 * k * len(found.names) + 10_000:
                held[:] = [kept()]
        if held:
            last = kept()
            yield pa.RecordBatch.from_arrays([pa.array([found.names[i] for i in last["_q"]], kind), *[pa.array(last[c]) for c in chunk], pa.array(last["score"])], names=["q", *chunk, "score"])

    return run


def blocks_of(queries: DataFrame, by: str, size: int | None = None):
    """The rows of queries in blocks that a task can hold, in order."""
    size = size or QUERY_BLOCK
    held = staged(queries.withColumn("_block", F.floor((F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(by), F.lit(64))).orderBy(by)) - 1) / max(1, size // 64))), "queries")
    for n in range((held.agg(F.max("_block")).first()[0] or 0) + 1):
        rows = held.where(F.col("_block") == n).drop("_block").orderBy(by).collect()
        if rows:
            yield rows


def term_statistics(chunks: DataFrame, text: str = "content", tokens=lexical_tokens) -> DataFrame:
    """(term, df, cf): how many chunks hold a term, and how often it occurs."""
    each = chunks.select(tokens(F.col(text)).alias("t"))
    counted = each.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode_outer("t").alias("term")).where("term is not null")
    per = counted.groupBy("row", "term").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def finite(v: Column, size: int | None = None) -> Column:
    """Whether a vector has only finite numbers (and the size wanted)."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & ok if size is None else v.isNotNull() & (F.size(v) == size) & ok


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(batch: pa.Array) -> np.ndarray:
    m = np.stack(batch.to_numpy(zero_copy_only=False)).astype(np.float64) if len(batch) else np.zeros((0, 1))
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query: str = "query_id", id: str = "vec_id", vector: str = "embedding", allowed: DataFrame | None = None, skip_self: bool = False, overfetch: bool = False) -> DataFrame:
    """(query, id, score, rank): the k nearest vectors by cosine, exactly.

    The scope filters before ranking. With overfetch, min(max(5k, k), 50) neighbours are ranked first and the scope
    comes after, which may leave fewer than k. Every task keeps its own k best of each query before anything is
    sent, in blocks of queries."""
    fetch = min(max(5 * k, k), 50) if overfetch else k
    pool = vectors if overfetch else scoped(vectors, allowed, id)
    pool = pool.where(finite(F.col(vector))).select(F.col(id).alias("id"), F.col(vector).alias("v"))
    kind = vectors.schema[id].dataType.simpleString()
    asked = queries.where(finite(F.col(vector))).select(F.col(query).alias("q"), F.col(vector).alias("v"))
    out = None
    for rows in blocks_of(asked, "q"):
        part = pool.mapInArrow(_nearest([r.q for r in rows], [list(r.v) for r in rows], fetch, skip_self), f"q {queries.schema[query].dataType.simpleString()}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = asked.sparkSession.createDataFrame([], f"q {queries.schema[query].dataType.simpleString()}, id {kind}, score double")
    w = Window.partitionBy("q").orderBy(F.round("score", 9).desc(), "id")
    best = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= fetch)
    if overfetch:
        best = scoped(best.withColumnRenamed("id", id), allowed, id).withColumnRenamed(id, "id")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("q").alias(query), F.col("id").alias(id), "score", "rank")


def _nearest(names: list, vectors: list, k: int, skip_self: bool):
    def run(batches):
        q = np.array(vectors, np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        kind, mine = pa.array(names).type, np.array(names, object)
        best = np.zeros((len(names), 0))
        kept = np.zeros((len(names), 0), object)
        for batch in batches:
            own = np.array(batch.column("id").to_pylist(), object)
            score = np.round(q @ _unit(batch.column("v")).T, 12)
            if skip_self:
                score[np.equal.outer(mine, own)] = -np.inf
            best, kept = np.concatenate([best, score], 1), np.concatenate([kept, np.broadcast_to(own, score.shape)], 1)
            if best.shape[1] > k:
                order = np.stack([np.lexsort((kept[r].astype(object).astype(str) if kept[r].dtype == object and isinstance(kept[r][0], str) else kept[r].astype(np.int64), -np.round(best[r], 9)))[:k] for r in range(len(names))])
                best, kept = np.take_along_axis(best, order, 1), np.take_along_axis(kept, order, 1)
        rows = [(names[r], kept[r][c], float(best[r][c])) for r in range(len(names)) for c in range(best.shape[1]) if best[r][c] > -np.inf]
        if rows:
            a, b, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b), pa.array(c, pa.float64())], names=["q", "id", "score"])

    return run
