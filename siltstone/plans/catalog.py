"""The catalog: registered queries over the driver's tables, and the SQL that each one must equal.

Inputs that the tables lack are derived from them the same way on both sides: chunks from documents, queries
from benchmark texts, edges from keys, versions from copies within a source, changes from events.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, context, evaluation, fusion, graph, memory, retrieval
from ..session import load
from ..sources import cdc, files
from . import versions

QUERIES: dict = {}
SQL: dict = {}
TOKEN_SQL = T.TOKEN.replace("'", "''")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- documents to chunks ----------------------------------------------------------------------

CHUNKS = r"""chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, s AS char_start, s + 512 AS char_end, content FROM (
  SELECT doc_id, CAST(s AS INTEGER) AS s, trim(substr(text, s + 1, 512), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content
  FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 448)) AS s FROM documents) WHERE s < length(text)) WHERE content <> '')"""


def _chunks(spark, d):
    return chunking.fixed_windows(load(spark, d, "documents"))


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, char_start, char_end, content FROM chunks")
def chunk_fixed_windows(spark, d):
    return _chunks(spark, d)


@query(f"WITH {CHUNKS} SELECT lang, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars, max(chunk_index) AS last_index FROM chunks JOIN documents USING (doc_id) GROUP BY lang")
def chunk_stats_by_lang(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang")
    got = _chunks(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("c"), F.max("chunk_index").alias("m"))
    return got.join(docs, "doc_id").groupBy("lang").agg(F.sum("n").alias("n_chunks"), F.sum("c").alias("n_chars"), F.max("m").alias("last_index"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]')) + len(regexp_extract_all(regexp_replace(text, '[\x{3400}-\x{9fff}\x{f900}-\x{faff}]', ' ', 'g'), '[A-Za-z0-9_]+')) AS INTEGER) AS tokens FROM documents""")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(r"""WITH p AS (SELECT page_id, unnest(string_split(x, chr(10))) AS s, generate_subscripts(string_split(x, chr(10)), 1) AS line FROM (SELECT page_id, regexp_replace(regexp_replace(html, '<h[1-6][^>]*>', chr(10) || '# ', 'g'), '</?[a-zA-Z][^>]*>', chr(10), 'g') AS x FROM pages)),
m AS (SELECT *, regexp_matches(s, '^#{1,6}\s') AS h, sum(CASE WHEN regexp_matches(s, '^#{1,6}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY line) AS block FROM p),
g AS (SELECT page_id, CAST(block AS BIGINT) AS block, max(CASE WHEN h THEN trim(regexp_replace(s, '^#+\s+', ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) END) AS title,
  trim(coalesce(string_agg(CASE WHEN NOT h THEN s END, chr(10) ORDER BY line), ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content FROM m GROUP BY page_id, block)
SELECT * FROM g WHERE content <> ''""")
def markdown_blocks(spark, d):
    html = F.regexp_replace(F.regexp_replace("html", "<h[1-6][^>]*>", "\n# "), "</?[a-zA-Z][^>]*>", "\n")
    return chunking.markdown_blocks(load(spark, d, "pages").select("page_id", html.alias("text")), "page_id")


@query("""SELECT CAST(p_partkey // 20 AS BIGINT) AS grp, '表头: p_partkey | p_name | p_brand | p_size' || chr(10) || string_agg('p_partkey: ' || p_partkey || ' | p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_size: ' || p_size, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY grp""")
def csv_row_groups(spark, d):
    return chunking.row_groups(load(spark, d, "part").withColumn("k", F.col("p_partkey") + 1), "k", ["p_partkey", "p_name", "p_brand", "p_size"])


@query()
def parent_child_chunks(spark, d):
    return chunking.parent_child(load(spark, d, "documents"))


@query(f"WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, 'not_contiguous' AS reason FROM chunks WHERE content LIKE '%the%' GROUP BY doc_id HAVING max(chunk_index) + 1 <> count(*)")
def chunk_validation(spark, d):
    return chunking.invalid_chunk_sets(_chunks(spark, d).where(F.contains("content", F.lit("the"))))


# --- lexical search ---------------------------------------------------------------------------

# The tables hold one letter that folding and lower case treat differently, the German sharp s.
BM25 = rf"""q AS (SELECT item_id AS query_id, text AS query FROM benchmark),
{CHUNKS},
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(replace(lower(query), 'ß', 'ss'), '{TOKEN_SQL}')) AS term FROM q) GROUP BY ALL),
tk AS MATERIALIZED (SELECT doc_id, chunk_index, regexp_extract_all(replace(lower(content), 'ß', 'ss'), '{TOKEN_SQL}') AS t FROM chunks),
st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM tk),
tf AS (SELECT doc_id, chunk_index, len(t) AS len, term, count(*) AS tf FROM (SELECT doc_id, chunk_index, t, unnest(t) AS term FROM tk) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT query_id, doc_id, chunk_index, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 8) AS score FROM tf JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL)"""


def _queries(spark, d):
    return load(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ranked(sql: str, k: int) -> str:
    return f"SELECT query_id, doc_id, chunk_index, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_index) AS rank FROM {sql}) WHERE rank <= {k}"


@query(f"WITH {BM25} {_ranked('sc', 10)}")
def bm25_topk(spark, d):
    return retrieval.bm25(_queries(spark, d), _chunks(spark, d), 10)


@query(f"WITH {BM25} {_ranked('(SELECT sc.* FROM sc JOIN documents USING (doc_id) WHERE source IN (SELECT max(source) FROM documents UNION SELECT min(source) FROM documents))', 5)}")
def bm25_scoped_topk(spark, d):
    docs = load(spark, d, "documents")
    ends = docs.agg(F.max("source").alias("a"), F.min("source").alias("b")).select(F.explode(F.array("a", "b")).alias("source"))
    allowed = docs.join(F.broadcast(ends), "source", "left_semi").select("doc_id")
    return retrieval.bm25(_queries(spark, d), _chunks(spark, d), 5, allowed=allowed)


@query(rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKEN_SQL}')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t GROUP BY term""")
def bm25_term_stats(spark, d):
    return retrieval.term_statistics(load(spark, d, "documents"), "text")


# --- vector search ----------------------------------------------------------------------------

PAIRS = "p AS (SELECT q.vec_id AS query_id, e.vec_id AS vec_id, e.label, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS s FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e {where})"
TOP = "SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= {k}"


def _vector_queries(spark, d):
    return load(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query(f"WITH {PAIRS.format(where='')} {TOP.format(k=10)}")
def vector_topk(spark, d):
    return retrieval.vector_topk(_vector_queries(spark, d), load(spark, d, "embeddings"), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {PAIRS.format(where='WHERE e.label IN (1, 3)')} {TOP.format(k=5)}")
def vector_scoped_topk(spark, d):
    v = load(spark, d, "embeddings")
    return retrieval.vector_topk(_vector_queries(spark, d), v, 5, allowed=v.where("label in (1, 3)").select("vec_id")).withColumn("score", F.round("score", 6))


@query(f"""WITH {PAIRS.format(where='')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS n FROM p), f AS (SELECT * FROM r WHERE n <= 25 AND label IN (1, 3))
SELECT query_id, vec_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM f) WHERE rank <= 5""")
def vector_overfetch_topk(spark, d):
    v = load(spark, d, "embeddings")
    return retrieval.vector_topk(_vector_queries(spark, d), v, 5, allowed=v.where("label in (1, 3)").select("vec_id"), overfetch=True).withColumn("score", F.round("score", 6))


@query(f"""WITH {PAIRS.format(where='WHERE q.vec_id <> e.vec_id')}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p) WHERE rank <= 10)
SELECT query_id, label, count(*) AS votes, round(sum(s), 5) AS weight FROM t GROUP BY query_id, label""")
def vector_label_knn(spark, d):
    v = load(spark, d, "embeddings")
    top = retrieval.vector_topk(_vector_queries(spark, d), v, 10, skip_self=True)
    return top.join(v.select("vec_id", "label"), "vec_id").groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("votes"), F.round(F.sum("score"), 5).alias("weight"))


@query("SELECT vec_id, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS usable FROM embeddings")
def vector_checks(spark, d):
    return load(spark, d, "embeddings").select("vec_id", retrieval.finite(F.col("embedding"), 64).alias("usable"))


# --- fusion -----------------------------------------------------------------------------------
# three ranked lists per source: documents by length, by id, and by text; the third holds planted faults

LISTS = """base AS (SELECT doc_id, source AS query_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY text, doc_id) AS c FROM documents),
lists AS (SELECT query_id, 'bm25' AS retrieval_type, doc_id AS candidate_id, a AS rank FROM base WHERE a <= 40 UNION ALL SELECT query_id, 'vector', doc_id, b FROM base WHERE b <= 40 UNION ALL SELECT query_id, 'graph', doc_id, CASE WHEN c = 7 THEN 6 WHEN c = 9 THEN 0 ELSE c END FROM base WHERE c <= 20),
marked AS (SELECT *, rank < 1 OR count(*) OVER (PARTITION BY query_id, retrieval_type, rank) > 1 AS bad FROM lists)"""
RRF = LISTS + """, fused AS (SELECT query_id, candidate_id, sum(1.0 / (60 + rank)) AS s, count(DISTINCT retrieval_type) AS n_types, min(rank) AS min_rank FROM marked WHERE NOT bad GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, n_types DESC, min_rank, candidate_id) AS fused_rank FROM fused)"""


def _lists(spark, d):
    w = Window.partitionBy("query_id")
    base = load(spark, d, "documents").select("doc_id", F.col("source").alias("query_id"), "n_chars", "text")
    base = base.select("doc_id", "query_id", F.row_number().over(w.orderBy(F.desc("n_chars"), "doc_id")).alias("a"), F.row_number().over(w.orderBy("doc_id")).alias("b"), F.row_number().over(w.orderBy("text", "doc_id")).alias("c"))
    one = lambda kind, c, k: base.where(F.col(c) <= k).select("query_id", F.lit(kind).alias("retrieval_type"), F.col("doc_id").alias("candidate_id"), F.col(c).alias("rank"))
    third = one("graph", "c", 20).withColumn("rank", F.when(F.col("rank") == 7, 6).when(F.col("rank") == 9, 0).otherwise(F.col("rank")))
    return one("bm25", "a", 40).unionByName(one("vector", "b", 40)).unionByName(third)


@query(f"WITH {RRF} SELECT query_id, candidate_id, round(s, 8) AS rrf_score, n_types, CAST(min_rank AS INTEGER) AS min_rank, CAST(fused_rank AS INTEGER) AS fused_rank FROM rr WHERE fused_rank <= 30")
def rrf_fuse(spark, d):
    return fusion.rrf(_lists(spark, d)).select("query_id", "candidate_id", F.round("rrf_score", 8).alias("rrf_score"), "n_types", "min_rank", "fused_rank")


@query(f"""WITH {LISTS}, m AS (SELECT query_id, candidate_id, count(*) AS n FROM marked WHERE NOT bad GROUP BY ALL)
SELECT query_id, (SELECT count(*) FROM lists l WHERE l.query_id = m.query_id) AS input_count, (SELECT count(*) FROM marked k WHERE k.query_id = m.query_id AND bad) AS invalid_count, CAST(0 AS BIGINT) AS conflict_count, count(*) AS unique_count, count(*) FILTER (n > 1) AS multi_source_count, count(*) AS output_count FROM m GROUP BY query_id""")
def rrf_diagnostics(spark, d):
    return fusion.rrf_diagnostics(_lists(spark, d))


@query(f"""WITH {RRF}, t AS (SELECT rr.*, (doc.n_chars % 97) / 97.0 AS score FROM rr JOIN documents doc ON doc.doc_id = rr.candidate_id WHERE fused_rank <= 30)
SELECT query_id, candidate_id, CAST(fused_rank AS INTEGER) AS pre_rank, round(score, 6) AS rerank_score, CAST(post_rank AS INTEGER) AS post_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, round(s, 12) DESC, candidate_id) AS post_rank FROM t) WHERE post_rank <= 12""")
def rerank_with_scores(spark, d):
    fused = fusion.rrf(_lists(spark, d))
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), ((F.col("n_chars") % 97) / 97.0).alias("score"))
    scores = fused.select("query_id", "candidate_id").join(docs, "candidate_id")
    return fusion.rerank(fused, scores).select("query_id", "candidate_id", "pre_rank", F.round("rerank_score", 6).alias("rerank_score"), "post_rank")


@query(f"WITH {RRF} SELECT query_id, candidate_id, CAST(fused_rank AS INTEGER) AS pre_rank, CAST(fused_rank AS INTEGER) AS post_rank FROM rr WHERE fused_rank <= 12")
def rerank_fallback(spark, d):
    return fusion.rerank(fusion.rrf(_lists(spark, d)), None).select("query_id", "candidate_id", "pre_rank", "post_rank")


CONTEXTS = """ctx AS (SELECT source AS query_id, doc_id AS arrival, text AS content, n_chars, (n_chars % 89) / 89.0 AS score, CASE doc_id % 4 WHEN 0 THEN 'graph' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'path' ELSE 'vector' END AS retrieval_type, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'text' END AS modality FROM documents)"""


def _contexts(spark, d):
    kind = lambda *names: F.when(F.col("doc_id") % 4 == 0, names[0]).when(F.col("doc_id") % 4 == 1, names[1]).when(F.col("doc_id") % 4 == 2, names[2]).otherwise(names[3])
    return load(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("arrival"), F.col("text").alias("content"), ((F.col("n_chars") % 89) / 89.0).alias("score"), kind("graph", "hybrid", "path", "vector").alias("retrieval_type"), kind("pdf", "table", "image", "text").alias("modality"))


def _merge_sql(weights: str, prefix: int, k: int | None) -> str:
    top = "" if k is None else f" WHERE rank <= {k}"
    return f"""WITH {CONTEXTS}, w AS (SELECT *, score * {weights} AS weighted, row_number() OVER (PARTITION BY query_id, substr(content, 1, {prefix}) ORDER BY arrival) AS nth FROM ctx)
SELECT query_id, arrival, round(weighted, 6) AS weighted, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(weighted, 9) DESC, arrival) AS rank FROM w WHERE nth = 1){top}"""


def _merge(df, weights, prefix, k):
    return fusion.merged(df, weights, prefix, k).select("query_id", "arrival", F.round("weighted", 6).alias("weighted"), "rank")


@query(_merge_sql("CASE retrieval_type WHEN 'graph' THEN 1.2 WHEN 'hybrid' THEN 1.1 ELSE 1.0 END", 100, 8))
def hybrid_legacy_rerank(spark, d):
    return _merge(_contexts(spark, d), fusion.HYBRID_WEIGHTS, 100, 8)


@query(_merge_sql("CASE retrieval_type WHEN 'path' THEN 1.25 ELSE 1.0 END", 80, None))
def dedupe_prefix_first(spark, d):
    return _merge(_contexts(spark, d), fusion.GRAPHRAG_WEIGHTS, 80, None)


@query(f"""WITH {CONTEXTS}, w AS (SELECT *, score * CASE modality WHEN 'pdf' THEN 0.95 WHEN 'table' THEN 0.9 WHEN 'image' THEN 0.85 ELSE 1.0 END AS weighted FROM ctx)
SELECT query_id, arrival, round(weighted, 6) AS weighted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(weighted, 9) DESC, arrival) AS INTEGER) AS rank FROM w""")
def modality_rerank(spark, d):
    return fusion.modality(_contexts(spark, d)).select("query_id", "arrival", F.round("weighted", 6).alias("weighted"), "rank")


@query(f"WITH {CONTEXTS} SELECT query_id, round(least(avg(score), 1.0), 6) AS confidence FROM ctx GROUP BY query_id")
def answer_confidence(spark, d):
    return fusion.confidence(_contexts(spark, d)).withColumn("confidence", F.round("confidence", 6))


# --- parents, budget --------------------------------------------------------------------------
# parents: every 4 windows of a document; a document with an id divisible by 5 has no current parents

EXPAND = CHUNKS + """, p AS (SELECT doc_id, chunk_index // 4 AS pi, string_agg(content, ' ' ORDER BY chunk_index) AS content, CAST(sum(length(content)) AS BIGINT) AS tokens FROM chunks GROUP BY ALL),
c AS (SELECT lang AS query_id, chunks.*, row_number() OVER (PARTITION BY lang ORDER BY length(content) DESC, doc_id, chunk_index) AS post_rank FROM chunks JOIN documents USING (doc_id)),
k AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN 'parent:' || doc_id || ':v1:p' || (chunk_index // 4) ELSE 'child:c' || doc_id || '-' || chunk_index END AS context_id, CASE WHEN doc_id % 5 <> 0 THEN 'parent' ELSE 'child_fallback' END AS kind FROM c WHERE post_rank <= 60),
x AS (SELECT query_id, context_id, kind, min(post_rank) AS final_rank, count(*) AS n_children, any_value(doc_id) AS doc_id, any_value(chunk_index // 4) AS pi, any_value(content) AS own, min_by(content, post_rank) AS best FROM k GROUP BY ALL)"""


def _candidates(spark, d):
    lang = load(spark, d, "documents").select("doc_id", F.col("lang").alias("query_id"))
    w = Window.partitionBy("query_id").orderBy(F.length("content").desc(), "doc_id", "chunk_index")
    c = _chunks(spark, d).join(lang, "doc_id").withColumn("post_rank", F.row_number().over(w)).where("post_rank <= 60")
    name = F.concat(F.lit("c"), F.col("doc_id").cast("string"), F.lit("-"), F.col("chunk_index").cast("string"))
    return c.select("query_id", name.alias("candidate_id"), "content", F.col("doc_id").alias("document_id"), F.lit(1).alias("document_version"), name.alias("chunk_id"), F.concat(F.lit("p"), F.floor(F.col("chunk_index") / 4).cast("string")).alias("parent_chunk_id"), F.array(F.lit("bm25")).alias("retrieval_types"), (1.0 / (60 + F.col("post_rank"))).alias("rrf_score"), "post_rank")


def _parents(spark, d):
    c = _chunks(spark, d)
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    p = c.groupBy("doc_id", F.floor(F.col("chunk_index") / 4).alias("pi")).agg(rows.alias("r"), F.sum(F.length("content")).alias("n"))
    return p.select(F.lit("parent").alias("kind"), F.lit("ready").alias("status"), (F.col("doc_id") % 5 != 0).alias("is_current"), F.col("doc_id").alias("document_id"), F.lit(1).alias("document_version"), F.concat(F.lit("p"), F.col("pi").cast("string")).alias("chunk_id"), F.array_join(F.col("r.content"), " ").alias("content"), F.col("n").alias("estimated_token_count"))


@query(f"WITH {EXPAND} SELECT query_id, context_id, x.kind, CAST(final_rank AS INTEGER) AS final_rank, n_children, CASE WHEN x.kind = 'parent' THEN p.content ELSE own END AS content FROM x LEFT JOIN p USING (doc_id, pi)")
def parent_expand(spark, d):
    got = context.expand(_candidates(spark, d), _parents(spark, d))
    return got.select("query_id", "context_id", "kind", "final_rank", F.size("supporting_candidate_ids").cast("long").alias("n_children"), "content")


BUDGET = EXPAND.replace("WITH", "") + """, t AS (SELECT query_id, context_id, row_number() OVER (PARTITION BY query_id ORDER BY final_rank, context_id) AS i, CASE WHEN x.kind = 'parent' THEN p.tokens ELSE CAST(len(regexp_extract_all(best, '[A-Za-z0-9_]+')) AS BIGINT) END AS t, CASE WHEN x.kind = 'parent' THEN CAST(len(regexp_extract_all(best, '[A-Za-z0-9_]+')) AS BIGINT) END AS f FROM x LEFT JOIN p USING (doc_id, pi)),
w AS (SELECT query_id, CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS context_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS position, FALSE AS accepted, CAST('' AS VARCHAR) AS reason FROM t GROUP BY query_id
  UNION ALL SELECT w.query_id, t.i, t.context_id,
    w.n + CASE WHEN w.n < 8 AND (t.t <= 6000 - w.used OR coalesce(t.f <= 6000 - w.used, FALSE)) THEN 1 ELSE 0 END,
    w.used + CASE WHEN w.n >= 8 THEN 0 WHEN t.t <= 6000 - w.used THEN t.t WHEN coalesce(t.f <= 6000 - w.used, FALSE) THEN t.f ELSE 0 END,
    CASE WHEN w.n < 8 AND (t.t <= 6000 - w.used OR coalesce(t.f <= 6000 - w.used, FALSE)) THEN w.n + 1 END,
    w.n < 8 AND (t.t <= 6000 - w.used OR coalesce(t.f <= 6000 - w.used, FALSE)),
    CASE WHEN w.n >= 8 THEN 'top_k_truncated' WHEN t.t <= 6000 - w.used THEN 'fits' WHEN coalesce(t.f <= 6000 - w.used, FALSE) THEN 'parent_to_child_fallback' ELSE 'budget_exceeded' END
  FROM w JOIN t ON t.query_id = w.query_id AND t.i = w.i + 1)"""


@query(f"WITH RECURSIVE {BUDGET} SELECT query_id, context_id, coalesce(position, 0) AS position, accepted, reason FROM w WHERE i > 0")
def context_budget(spark, d):
    got = context.budgeted(context.expand(_candidates(spark, d), _parents(spark, d)))
    return got.select("query_id", "context_id", F.coalesce("position", F.lit(0)).alias("position"), "accepted", "reason")


@query()
def context_build(spark, d):
    c = _candidates(spark, d)
    lists = c.select("query_id", "candidate_id", F.lit("bm25").alias("retrieval_type"), F.col("post_rank").alias("rank")).unionByName(
        c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("candidate_id"))).select("query_id", "candidate_id", F.lit("vector").alias("retrieval_type"), "rank"))
    details = c.select("candidate_id", "content", "document_id", "document_version", "chunk_id", "parent_chunk_id")
    return context.build(lists, details, _parents(spark, d))


# --- graph ------------------------------------------------------------------------------------
# suppliers and customers LOCATED_IN nations, nations PART_OF regions, orders RESPONSIBLE_FOR customers

EDGES = """e AS (SELECT 's' || s_suppkey AS edge_id, 'supplier:' || s_suppkey AS subject, 'LOCATED_IN' AS predicate, 'nation:' || s_nationkey AS object FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'nation:' || n_nationkey, 'PART_OF', 'region:' || n_regionkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'o' || o_orderkey, 'order:' || o_orderkey, 'RESPONSIBLE_FOR', 'customer:' || o_custkey FROM orders)"""
TWO_WAY = EDGES + ", b AS (SELECT edge_id, subject AS a, object AS z, 'forward' AS dir FROM e UNION ALL SELECT edge_id, object, subject, 'reverse' FROM e)"


def _edges(spark, d):
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))

    def of(table: str, letter: str, kind: str, key: str, predicate: str, to: str, other: str):
        edge = F.concat(F.lit(letter), F.col(key).cast("string"))
        return load(spark, d, table).select(edge.alias("edge_id"), name(kind, key).alias("subject"), F.lit(predicate).alias("predicate"), name(to, other).alias("object"))

    return (
        of("supplier", "s", "supplier", "s_suppkey", "LOCATED_IN", "nation", "s_nationkey").unionByName(of("nation", "n", "nation", "n_nationkey", "PART_OF", "region", "n_regionkey"))
        .unionByName(of("customer", "c", "customer", "c_custkey", "LOCATED_IN", "nation", "c_nationkey")).unionByName(of("orders", "o", "order", "o_orderkey", "RESPONSIBLE_FOR", "customer", "o_custkey"))
    )


@query(f"""WITH {TWO_WAY}, s AS (SELECT DISTINCT a AS start FROM b WHERE a LIKE 'nation:%'),
h1 AS (SELECT start, z AS node, [edge_id] AS ids, [dir] AS dirs FROM s JOIN b ON b.a = s.start),
h2 AS (SELECT start, b.z AS node, list_append(ids, edge_id) AS ids, list_append(dirs, dir) AS dirs FROM h1 JOIN b ON b.a = h1.node AND NOT list_contains(ids, edge_id)),
u AS (SELECT 1 AS hops, * FROM h1 UNION ALL SELECT 2, * FROM h2),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, ids, dirs) AS nth FROM u)
SELECT start, hops, node, array_to_string(ids, '>') AS edge_ids, array_to_string(dirs, '>') AS directions FROM r WHERE nth <= 50""")
def graph_neighbors_h2(spark, d):
    e = _edges(spark, d)
    starts = load(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name"))
    return graph.paths(e, starts, 2, 50).select("start", "hops", "node", F.array_join("edge_ids", ">").alias("edge_ids"), F.array_join("directions", ">").alias("directions"))


@query(f"""WITH RECURSIVE {TWO_WAY}, pr AS (SELECT 'supplier:' || s_suppkey AS source, 'order:' || o_orderkey AS target FROM orders JOIN supplier ON s_suppkey = 1 + o_orderkey % 50 WHERE o_orderkey % 50 = 0 OR o_orderkey % 50 = 7),
w AS (SELECT DISTINCT source AS start, source AS node, CAST([] AS VARCHAR[]) AS ids, 0 AS hops FROM pr UNION ALL SELECT start, z, list_append(ids, edge_id), hops + 1 FROM w JOIN b ON b.a = w.node AND NOT list_contains(ids, edge_id) WHERE hops < 5),
r AS (SELECT w.*, row_number() OVER (PARTITION BY start, node ORDER BY hops, ids) AS nth FROM w JOIN (SELECT DISTINCT * FROM pr) p ON p.source = start AND p.target = node WHERE hops > 0)
SELECT start AS source, node AS target, hops AS length, array_to_string(ids, '>') AS edge_ids FROM r WHERE nth <= 3""")
def graph_paths_between(spark, d):
    """From two suppliers to orders: up to five steps over the whole graph."""
    o = load(spark, d, "orders").where("o_orderkey % 50 in (0, 7)").select((1 + F.col("o_orderkey") % 50).alias("s_suppkey"), F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("target"))
    pairs = o.join(load(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("source"), "target")
    return graph.shortest_paths(_edges(spark, d), pairs, 5, 3).withColumn("edge_ids", F.array_join("edge_ids", ">"))


@query(f"WITH {EDGES} SELECT predicate, count(*) AS n_edges, count(DISTINCT subject) AS n_subjects, count(DISTINCT object) AS n_objects FROM e GROUP BY predicate")
def graph_stats(spark, d):
    return _edges(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("subject").alias("n_subjects"), F.countDistinct("object").alias("n_objects"))


@query("SELECT 'customer:' || c_custkey AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) AND c_acctbal < 0")
def orphan_entities(spark, d):
    name = lambda c: F.concat(F.lit("customer:"), F.col(c).cast("string"))
    c = load(spark, d, "customer").select(name("c_custkey").alias("name"), "c_acctbal")
    edges = load(spark, d, "orders").select(name("o_custkey").alias("subject"), F.col("o_orderkey").cast("string").alias("object"))
    return graph.orphans(c.select("name"), c.where("c_acctbal >= 0"), edges)


_ALIAS_ROWS = ", ".join(f"('{a}', '{p}')" for a, p in sorted({*graph.ALIASES.items(), *((p.lower().replace("_", " "), p) for p in graph.PREDICATES)}))


@query(f"""WITH al(alias, canonical) AS (VALUES {_ALIAS_ROWS}), x AS (SELECT p_partkey, ['depends_on', 'Depends-On', '依赖于', 'likes', 'PART_OF', ' uses ', '监控'][CAST(p_partkey % 7 AS INTEGER) + 1] AS predicate FROM part)
SELECT p_partkey, coalesce(canonical, 'RELATED_TO') AS canonical, substr(regexp_replace(trim(predicate), '\\s+', ' ', 'g'), 1, 160) AS raw_predicate FROM x LEFT JOIN al ON alias = regexp_replace(translate(lower(trim(predicate)), '_-', '  '), '\\s+', ' ', 'g')""")
def canonicalize_predicates(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("depends_on", "Depends-On", "依赖于", "likes", "PART_OF", " uses ", "监控")]), (F.col("p_partkey") % 7).cast("int") + 1)
    return graph.canonical(load(spark, d, "part").select("p_partkey", said.alias("predicate"))).select("p_partkey", "canonical", "raw_predicate")


@query("SELECT s_suppkey, lower(regexp_replace(s_name, '\\s', '', 'g')) AS match_key FROM supplier")
def entity_match_keys(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", T.match_key(F.col("s_name")).alias("match_key"))


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def entity_dedup(spark, d):
    return graph.first_of(load(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], ["o_orderkey"])


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS head FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_relations(spark, d):
    rel = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("head"), F.lit("x").alias("tail"))
    ent = load(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("name"))
    ent = ent.union(spark.createDataFrame([("x",)], "name string"))
    return graph.split_relations(rel, ent)[1].select("o_orderkey", "head")


@query("SELECT o_orderkey, sha256(CAST(o_custkey AS VARCHAR) || chr(31) || '1' || chr(31) || CAST(o_orderkey AS VARCHAR) || chr(31) || 'RESPONSIBLE_FOR' || chr(31) || o_orderpriority) AS evidence_key FROM orders")
def evidence_keys(spark, d):
    return load(spark, d, "orders").select("o_orderkey", T.evidence_key(F.col("o_custkey"), F.lit(1), F.col("o_orderkey"), F.lit("RESPONSIBLE_FOR"), F.col("o_orderpriority")).alias("evidence_key"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'legacy-child:' || sha256(CAST(o_custkey AS VARCHAR) || chr(31) || '') ELSE 'k' || o_orderkey END AS child_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'graph-legacy:' || sha256(o_orderpriority) WHEN 1 THEN 'graph:' || o_orderpriority ELSE 'graph-path:' || sha256(o_orderpriority || chr(31) || o_orderstatus) END AS graph_id FROM orders""")
def candidate_ids(spark, d):
    o = load(spark, d, "orders")
    m = F.col("o_orderkey") % 3
    keys = F.when(m == 0, F.array().cast("array<string>")).when(m == 1, F.array("o_orderpriority")).otherwise(F.array("o_orderpriority", "o_orderstatus"))
    return o.select("o_orderkey", T.child_candidate_id(F.when(m != 0, F.concat(F.lit("k"), F.col("o_orderkey").cast("string"))), F.col("o_custkey"), F.lit(None)).alias("child_id"), T.graph_candidate_id(keys, F.col("o_orderpriority")).alias("graph_id"))


@query("SELECT s_suppkey, substr(sha256(regexp_replace(trim(s_name), '\\s+', ' ', 'g') || chr(31) || 'LOCATED_IN' || chr(31) || CAST(s_nationkey AS VARCHAR) || chr(31) || 'forward'), 1, 24) AS fingerprint FROM supplier")
def edge_fingerprints(spark, d):
    return load(spark, d, "supplier").select("s_suppkey", T.edge_fingerprint(F.col("s_name"), F.lit("LOCATED_IN"), F.col("s_nationkey"), F.lit("forward")).alias("fingerprint"))


@query("""WITH n AS (SELECT c_name AS name, c_mktsegment AS description FROM customer UNION ALL SELECT s_name, NULL FROM supplier UNION ALL SELECT p_name, min(p_brand) FROM part GROUP BY p_name),
w AS (SELECT 'c' || c_custkey AS query_id, substr(c_name, 14) AS word FROM customer WHERE c_custkey % 50 = 0 UNION ALL SELECT 'p' || p_partkey, split_part(p_name, ' ', 2) FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'b' || p_partkey, p_brand FROM part WHERE p_partkey % 50 = 0 UNION ALL SELECT 'x', 'r'),
h AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rank FROM (SELECT DISTINCT query_id, name FROM n JOIN w ON word <> '' AND (contains(name, word) OR coalesce(contains(description, word), false))))
SELECT query_id, name, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 20""")
def entity_search(spark, d):
    """Names of customers, suppliers and parts, asked for ends of customers' numbers, words of parts' names, brands and a single letter."""
    c, p = load(spark, d, "customer"), load(spark, d, "part")
    names = c.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")).unionByName(load(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("description")))
    names = names.unionByName(p.groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("description")))
    ask = lambda df, letter, key, word: df.where(F.col(key) % 50 == 0).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("query_id"), word.alias("word"))
    words = ask(c, "c", "c_custkey", F.substr("c_name", F.lit(14))).unionByName(ask(p, "p", "p_partkey", F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))).unionByName(ask(p, "b", "p_partkey", F.col("p_brand")))
    return graph.search_entities(names, words.unionByName(spark.range(1).select(F.lit("x").alias("query_id"), F.lit("r").alias("word"))))


# --- evaluation -------------------------------------------------------------------------------
# ranking of each source's documents by length; relevant: labelled of good quality

IR = """rk AS (SELECT source AS query_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents),
rl AS (SELECT DISTINCT source AS query_id, doc_id AS item FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
sz AS (SELECT query_id, count(*) AS n FROM rl GROUP BY query_id),
ht AS (SELECT query_id, pos FROM rk JOIN rl USING (query_id, item) WHERE pos <= 10),
mt AS (SELECT query_id, count(*) FILTER (pos <= 1) AS h1, count(*) FILTER (pos <= 3) AS h3, count(*) FILTER (pos <= 5) AS h5, count(*) AS h10, min(pos) AS first, sum(1 / log2(pos + 1)) AS dcg FROM ht GROUP BY query_id),
ir AS (SELECT q.query_id, n, coalesce(h1, 0) / n AS r1, coalesce(h3, 0) / n AS r3, coalesce(h5, 0) / n AS r5, coalesce(h10, 0) / n AS r10, coalesce(1 / first, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM (SELECT DISTINCT source AS query_id FROM documents) q LEFT JOIN sz USING (query_id) LEFT JOIN mt USING (query_id))"""


def _ir(spark, d):
    docs = load(spark, d, "documents")
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "item")
    ranked = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), "n_chars").withColumn("rank", F.row_number().over(w))
    good = load(spark, d, "labels").where("quality = 1")
    return ranked.select("query_id", "item", "rank"), docs.join(good, "doc_id", "left_semi").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"))


@query(f"WITH {IR} SELECT query_id, round(r1, 6) AS recall_at_1, round(r3, 6) AS recall_at_3, round(r5, 6) AS recall_at_5, round(r10, 6) AS recall_at_10, round(CASE WHEN n IS NOT NULL THEN mrr END, 6) AS mrr, round(CASE WHEN n IS NOT NULL THEN ndcg END, 6) AS ndcg_at_10 FROM ir")
def ir_metrics(spark, d):
    return evaluation.ir_metrics(*_ir(spark, d))


@query(f"""WITH {IR}, l AS (SELECT source AS query_id, CASE WHEN count(*) % 2 = 0 THEN 'even' ELSE 'odd' END AS category FROM documents GROUP BY source)
SELECT 'length' AS mode, coalesce(category, 'overall') AS category, count(*) AS n, round(avg(round(r10, 6)), 5) AS mean_metric, count(*) < 30 AS small_sample FROM ir JOIN l USING (query_id) GROUP BY GROUPING SETS ((), (category))""")
def ir_summary_by_category(spark, d):
    n = load(spark, d, "documents").groupBy(F.col("source").alias("query_id")).agg(F.when(F.count(F.lit(1)) % 2 == 0, "even").otherwise("odd").alias("category"))
    m = evaluation.ir_metrics(*_ir(spark, d)).join(n, "query_id").select(F.lit("length").alias("mode"), "category", F.col("recall_at_10").alias("metric"))
    return evaluation.category_summary(m).withColumn("mean_metric", F.round("mean_metric", 5))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles_linear(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.round(evaluation.percentile_linear(F.col("value"), 0.5), 6).alias("p50"), F.round(evaluation.percentile_linear(F.col("value"), 0.95), 6).alias("p95"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles_nearest(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(evaluation.percentile_nearest("value", 0.5).alias("p50"), evaluation.percentile_nearest("value", 0.95).alias("p95"))


@query("""SELECT event_type AS mode, count(*) AS n, round(avg(CAST(value > 50 AS INTEGER)), 6) AS success_rate, round(avg(CAST(value < 1 AS INTEGER)), 6) AS zero_result_rate, round(avg(value), 4) AS mean_metric, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def mode_summary(spark, d):
    e = load(spark, d, "events").select(F.col("event_type").alias("mode"), (F.col("value") > 50).alias("success"), (F.col("value") < 1).alias("zero_result"), F.col("value").alias("metric"), F.col("value").alias("latency_ms"))
    got = evaluation.mode_summary(e)
    return got.select("mode", "n", *[F.round(c, 6).alias(c) for c in ("success_rate", "zero_result_rate", "p50", "p95")], F.round("mean_metric", 4).alias("mean_metric"))


FIDELITY = EDGES + """, x AS (SELECT split_part(object, ':', 2) AS query_id, subject, predicate, object, 'forward' AS direction FROM e WHERE predicate = 'LOCATED_IN'),
o AS (SELECT query_id, subject, CASE WHEN CAST(split_part(subject, ':', 2) AS BIGINT) % 3 = 0 THEN 'USES' ELSE predicate END AS predicate, object, CASE WHEN CAST(split_part(subject, ':', 2) AS BIGINT) % 5 = 0 THEN 'reverse' ELSE direction END AS direction FROM x WHERE CAST(split_part(subject, ':', 2) AS BIGINT) % 7 <> 0)"""


def _expected(spark, d):
    x = _edges(spark, d).where("predicate = 'LOCATED_IN'").select(F.split_part(F.col("object"), F.lit(":"), F.lit(2)).alias("query_id"), "subject", "predicate", "object", F.lit("forward").alias("direction"))
    n = F.split_part(F.col("subject"), F.lit(":"), F.lit(2)).cast("long")
    o = x.where(n % 7 != 0).withColumn("predicate", F.when(n % 3 == 0, "USES").otherwise(F.col("predicate"))).withColumn("direction", F.when(n % 5 == 0, "reverse").otherwise(F.col("direction")))
    return x, o


@query(f"WITH {FIDELITY} SELECT query_id, count(*) AS n_expected, count(o.subject) AS n_matched, round(count(o.subject) / count(*), 3) AS fidelity, count(*) = count(o.subject) AS complete FROM x LEFT JOIN o USING (query_id, subject, predicate, object, direction) GROUP BY query_id".replace("count(o.subject)", "count(m)").replace("LEFT JOIN o USING", "LEFT JOIN (SELECT *, 1 AS m FROM o) USING"))
def graph_fidelity(spark, d):
    return evaluation.relation_fidelity(*_expected(spark, d))


@query(f"""WITH {FIDELITY}, g AS (SELECT query_id, count(*) AS ends, count(*) FILTER (predicate = 'LOCATED_IN') AS named, count(*) FILTER (predicate = 'LOCATED_IN' AND direction = 'forward') AS full_ FROM o GROUP BY query_id), n AS (SELECT query_id, count(*) AS n FROM x GROUP BY query_id)
SELECT query_id, round(coalesce(full_, 0) / n, 6) AS edge_recall, CASE WHEN ends > 0 THEN round(full_ / ends, 6) ELSE 0 END AS direction_fidelity, CASE WHEN ends > 0 THEN round(named / ends, 6) ELSE 0 END AS predicate_fidelity, CASE WHEN ends > 0 THEN 1.0 ELSE 0.0 END AS provenance_coverage FROM n LEFT JOIN g USING (query_id)""")
def graph_metrics(spark, d):
    x, o = _expected(spark, d)
    return evaluation.graph_metrics(x, o.withColumn("document_id", F.col("subject")).withColumn("source", F.col("object")))


@query(f"""WITH {FIDELITY}, u AS (SELECT * FROM x UNION SELECT * FROM o) SELECT subject, object, direction, array_to_string(list_sort(list(DISTINCT predicate)), ',') AS predicates FROM u GROUP BY subject, object, direction HAVING count(DISTINCT predicate) > 1""")
def predicate_conflicts(spark, d):
    x, o = _expected(spark, d)
    return evaluation.predicate_conflicts(x.unionByName(o)).withColumn("predicates", F.array_join("predicates", ","))


_STAGE_ROWS = ", ".join(f"({i}, '{s}', '{evaluation.LOSSES[s]}')" for i, s in enumerate(evaluation.STAGES, 1))


@query(f"""WITH st(i, stage, loss) AS (VALUES {_STAGE_ROWS}), ex AS (SELECT o_custkey AS query_id, o_orderkey AS edge, o_orderkey % 11 AS depth FROM orders),
have AS (SELECT DISTINCT query_id, i FROM ex, st WHERE query_id % 10 <> 0 OR i <= 4),
l AS (SELECT ex.*, (SELECT min(i) FROM st WHERE i > depth) AS gone, (SELECT min(i) FROM st WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.query_id = ex.query_id AND h.i = st.i)) AS missing FROM ex)
SELECT query_id, edge, CASE WHEN missing IS NOT NULL AND (gone IS NULL OR missing <= gone) THEN 'insufficient_evidence' WHEN gone IS NULL THEN 'prompt_present' ELSE (SELECT loss FROM st WHERE i = gone) END AS first_loss, CAST(least(depth, 9) AS BIGINT) AS n_stages FROM l""")
def first_loss(spark, d):
    ex = load(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("edge"), (F.col("o_orderkey") % 11).alias("depth"))
    stages = F.posexplode(F.array(*[F.lit(s) for s in evaluation.STAGES])).alias("i", "stage")
    observed = ex.select("query_id", "edge", "depth", stages).where("i < depth")
    present = ex.select("query_id").distinct().select("query_id", stages).where((F.col("query_id") % 10 != 0) | (F.col("i") < 4))
    return evaluation.first_loss(ex.select("query_id", "edge"), observed, present)


AB = """a AS (SELECT source AS query_id, doc_id AS item, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS ra, row_number() OVER (PARTITION BY source ORDER BY text, doc_id) AS rb FROM documents)"""


def _arms(spark, d):
    docs = load(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("item"), "n_chars", "text")
    w = Window.partitionBy("query_id")
    both = docs.select("query_id", "item", F.row_number().over(w.orderBy(F.desc("n_chars"), "item")).alias("ra"), F.row_number().over(w.orderBy("text", "item")).alias("rb"))
    return both.select("query_id", "item", F.col("ra").alias("rank")), both.select("query_id", "item", F.col("rb").alias("rank"))


@query(f"WITH {AB} SELECT query_id, min_by(item, ra) <> min_by(item, rb) AS top1_changed, bool_or((ra <= 8) <> (rb <= 8)) AS top_changed, round(avg(abs(ra - rb)), 6) AS mean_rank_delta FROM a GROUP BY query_id")
def paired_ab_delta(spark, d):
    return evaluation.paired(*_arms(spark, d)).withColumn("mean_rank_delta", F.round("mean_rank_delta", 6))


@query(f"""WITH {AB}, g AS (SELECT query_id, bool_or(ra <= 1 AND quality = 1) AS was, bool_or(rb <= 1 AND quality = 1) AS now FROM (SELECT a.*, coalesce(quality, 0) AS quality FROM a LEFT JOIN labels ON doc_id = item) GROUP BY query_id)
SELECT query_id, CASE WHEN now THEN 'improvement' ELSE 'regression' END AS outcome FROM g WHERE was <> now""")
def improvements_regressions(spark, d):
    a, b = _arms(spark, d)
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("item"), F.col("source").alias("query_id"))
    rel = docs.join(load(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("item")), "item", "left_semi")
    return evaluation.flips(evaluation.hit_at(a, rel, 1), evaluation.hit_at(b, rel, 1))


@query(f"WITH {AB} SELECT query_id, item, CASE WHEN ra <= 5 THEN 'left' ELSE 'right' END AS side FROM a WHERE (ra <= 5) <> (rb <= 5)")
def set_differences(spark, d):
    a, b = _arms(spark, d)
    return evaluation.set_differences(a.where("rank <= 5"), b.where("rank <= 5"), ["query_id", "item"])


# --- changes, versions ------------------------------------------------------------------------

EVENTS = "ev AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation, CAST(floor(value) AS BIGINT) AS added FROM events)"


def _changes(spark, d):
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return load(spark, d, "events").select("event_id", "ts", "user_id", op.alias("operation"), F.floor("value").cast("long").alias("added"))


@query("""WITH p AS (SELECT doc_id, source, string_split(text, chr(10)) AS a, lag(string_split(text, chr(10))) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
f AS (SELECT doc_id, CASE WHEN a = [''] THEN [] WHEN a[-1] = '' THEN a[1:-2] ELSE a END AS a, CASE WHEN b IS NULL OR b = [''] THEN [] WHEN b[-1] = '' THEN b[1:-2] ELSE b END AS b FROM p),
g AS (SELECT doc_id, len(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS added, len(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS gone, len(a) + len(b) AS n FROM f)
SELECT doc_id, CAST(added AS BIGINT) AS added_count, CAST(gone AS BIGINT) AS removed_count, round((added + gone) / greatest(n, 1), 4) AS change_ratio, (added + gone) / greatest(n, 1) > 0.3 AS is_major_change FROM g""")
def line_diff(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.col("text").alias("after"), F.lag("text").over(Window.partitionBy("source").orderBy("doc_id")).alias("before"))
    return cdc.line_diff(docs).select("doc_id", "added_count", "removed_count", "change_ratio", "is_major_change")


@query(f"WITH {EVENTS} SELECT event_id, CASE operation WHEN 'DELETE' THEN -1 WHEN 'INSERT' THEN 1 ELSE CASE WHEN added > 50 THEN added ELSE greatest(1, added // 10) END END AS chunks_affected FROM ev")
def cdc_impact(spark, d):
    return _changes(spark, d).select("event_id", cdc.impact(F.col("operation"), F.col("added"), F.col("added") > 50, F.lit(True)).alias("chunks_affected"))


@query(f"WITH {EVENTS} SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM ev")
def cdc_versions(spark, d):
    return cdc.versions(_changes(spark, d), "user_id", "ts").select("event_id", "user_id", "version")


@query(f"WITH {EVENTS} SELECT count(*) AS total_events, count(DISTINCT user_id) AS tracked_resources FROM ev")
def cdc_statistics(spark, d):
    return cdc.statistics(_changes(spark, d), "user_id")


@query("SELECT DISTINCT event_id, event_type FROM events")
def cdc_dedupe(spark, d):
    e = load(spark, d, "events").select("event_id", "event_type")
    return e.unionByName(e.where("event_type = 'error'")).dropDuplicates(["event_id"])


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def cdc_history(spark, d):
    return cdc.history(load(spark, d, "events").select("event_id", "ts"), 50, "ts")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def cdc_stream_tumbling(spark, d):
    """A stream over the file, kept in full."""
    from ..storage import folder
    from ..streaming import cdc as stream

    events = stream.event_stream(spark, f"{d}/event[s].parquet", load(spark, d, "events").schema)
    return stream.complete_table(stream.tumbling(events), folder(spark, "tumbling")).withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minute AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def cdc_stream_session(spark, d):
    """A stream over the file, kept in full."""
    from ..storage import folder
    from ..streaming import cdc as stream

    events = stream.event_stream(spark, f"{d}/event[s].parquet", load(spark, d, "events").schema)
    return stream.complete_table(stream.sessions(events), folder(spark, "sessions"))


@query("""WITH u AS (SELECT coalesce(nullif(source, ''), 'unnamed') AS source, doc_id, sha256(coalesce(text, '')) AS h FROM documents), f AS (SELECT source, h, min(doc_id) AS first FROM u GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS version FROM f)
SELECT u.source AS logical_key, doc_id AS arrival, h AS content_hash, version, CASE WHEN doc_id = first THEN 'reserved' ELSE 'unchanged' END AS outcome FROM u JOIN n USING (source, h)""")
def version_reserve(spark, d):
    up = load(spark, d, "documents").select(F.lit("default").alias("namespace"), F.col("source").alias("logical_key"), F.col("doc_id").alias("arrival"), versions.content_hash(F.col("text")).alias("content_hash"))
    none = spark.createDataFrame([], "namespace string, logical_key string, version int, content_hash string")
    return versions.reserve(none, up).drop("namespace")


@query("""WITH v AS (SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ready' END AS status FROM events) SELECT document_id, max(version) AS version FROM v WHERE status = 'ready' GROUP BY document_id""")
def current_versions(spark, d):
    v = cdc.versions(load(spark, d, "events"), "user_id", "ts").select(F.col("user_id").alias("document_id"), "version", F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"))
    return versions.current(v).select("document_id", "version")


_STATES = "['processing', 'ready', 'failed', 'deleting', 'deleted']"
_ALLOWED = " OR ".join(f"(s.now = '{a}' AND x.status = '{b}')" for a, bs in versions.TRANSITIONS.items() for b in bs)


@query(f"""WITH RECURSIVE x AS (SELECT user_id AS document_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {_STATES}[CAST(event_id % 5 AS INTEGER) + 1] AS status FROM events),
s AS (SELECT document_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS now, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS before, FALSE AS ok FROM x GROUP BY document_id
 UNION ALL SELECT s.document_id, x.seq, CASE WHEN coalesce({_ALLOWED}, FALSE) OR (s.now IS NULL AND x.status = 'processing') THEN x.status ELSE s.now END, x.status, s.now, coalesce({_ALLOWED}, FALSE) OR (s.now IS NULL AND x.status = 'processing') FROM s JOIN x ON x.document_id = s.document_id AND x.seq = s.seq + 1)
SELECT document_id, seq, status, before, ok FROM s WHERE seq > 0""")
def state_transitions(spark, d):
    e = cdc.versions(load(spark, d, "events"), "user_id", "ts")
    status = F.element_at(F.array(*[F.lit(s) for s in versions.TRANSITIONS]), (F.col("event_id") % 5).cast("int") + 1)
    return versions.replay(e.select(F.col("user_id").alias("document_id"), F.col("version").alias("seq"), status.alias("status")))


@query("""WITH c AS (SELECT o_orderkey AS document_id, o_custkey % 3 AS n FROM orders) SELECT document_id, n + 1 AS chunk_count, n + 1 AS n_catalog, CASE WHEN document_id % 4 = 0 THEN n ELSE n + 1 END AS n_vectors, CAST(CASE WHEN document_id % 6 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_graph, document_id % 4 <> 0 AND document_id % 6 <> 0 AS consistent FROM c""")
def verify_storage_consistency(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("version"), F.lit(True).alias("is_current"), (F.col("o_custkey") % 3 + 1).alias("chunk_count"))
    rows = o.select("document_id", "version", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunk_count"))).alias("i"))
    vectors = rows.where((F.col("document_id") % 4 != 0) | (F.col("i") > 1))
    return versions.consistency(rows, vectors, o.where(F.col("document_id") % 6 != 0), o).drop("version")


@query("""WITH j AS (SELECT user_id AS operation_id, event_id % 9 AS k, event_type FROM events), d AS (SELECT DISTINCT operation_id, k + 1 AS n FROM j WHERE event_type <> 'error'), f AS (SELECT operation_id, bool_or(event_type = 'error') AS failed FROM j GROUP BY operation_id),
s(n, step) AS (VALUES (1, 'prepare'), (2, 'catalog_staged'), (3, 'vector_staged'), (4, 'graph_staged'), (5, 'verified'), (6, 'vector_active'), (7, 'graph_active'), (8, 'catalog_active'), (9, 'ready'))
SELECT f.operation_id, failed, coalesce(string_agg(step, ',' ORDER BY n), '') AS completed, CASE WHEN failed THEN coalesce(string_agg(step, ',' ORDER BY n DESC), '') END AS compensation FROM f LEFT JOIN d USING (operation_id) LEFT JOIN s USING (n) GROUP BY f.operation_id, failed""")
def saga_journal(spark, d):
    e = load(spark, d, "events")
    step = F.element_at(F.array(*[F.lit(s) for s in versions.SAGA]), (F.col("event_id") % 9).cast("int") + 1)
    got = versions.saga_state(e.select(F.col("user_id").alias("operation_id"), step.alias("step"), F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("status")))
    return got.select("operation_id", F.col("compensation").isNotNull().alias("failed"), F.array_join("completed", ",").alias("completed"), F.array_join("compensation", ",").alias("compensation"))


# --- memory -----------------------------------------------------------------------------------

@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS updated_at, min_by(text, turn) AS title FROM conversations GROUP BY conv_id ORDER BY updated_at DESC, conv_id LIMIT 20 OFFSET 5")
def conversation_list(spark, d):
    return memory.conversation_list(load(spark, d, "conversations"), 20, 5)


@query("SELECT conv_id, count(*) AS n_hits, min(turn) AS first_turn FROM conversations WHERE contains(lower(text), 'tion') GROUP BY conv_id")
def conversation_search(spark, d):
    return memory.conversation_search(load(spark, d, "conversations"), "TION")


@query("SELECT conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3")
def last_n_messages(spark, d):
    return memory.last_n(load(spark, d, "conversations"), 3, "conv_id")


@query("""WITH m AS (SELECT vec_id AS memory_id, embedding, (label + 1) / 10.0 AS importance FROM embeddings ORDER BY vec_id DESC LIMIT 100),
p AS (SELECT q.vec_id AS query_id, memory_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])) * importance AS s FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, m)
SELECT query_id, memory_id, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, memory_id) AS rank FROM p) WHERE rank <= 5""")
def memory_topk(spark, d):
    m = load(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), "embedding", ((F.col("label") + 1) / 10.0).alias("importance"), F.col("vec_id").alias("timestamp"))
    return memory.long_term(m, _vector_queries(spark, d)).withColumn("score", F.round("score", 6))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n % 2 = 0")
def stored_interactions(spark, d):
    return memory.stored_interactions(load(spark, d, "conversations"), "conv_id").select("conv_id", "turn")


# --- safe text --------------------------------------------------------------------------------

@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(text, 'mongodb(\+srv)?://[^\s]+', '[redacted]', 'gi'), 'Bearer\s+\S+', '[redacted]', 'gi'), '(api[_-]?key|password|token)\s*[=:]\s*\S+', '[redacted]', 'gi'), 1, 300) AS message FROM documents""")
def error_redaction(spark, d):
    return load(spark, d, "documents").select("doc_id", T.safe_error(F.col("text")).alias("message"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(string_split(replace(url, '\', '/'), '/')[-1], '[<>:"|?*]', '_', 'g') AS v FROM pages), b AS (SELECT page_id, trim(regexp_replace(trim(regexp_replace(v, '\.{2,}', '_', 'g'), ' .'), '\s+', ' ', 'g')) AS v FROM a)
SELECT page_id, CASE WHEN replace(v, '_', '') = '' THEN 'unnamed' ELSE substr(v, 1, 180) END AS filename FROM b""")
def safe_filename(spark, d):
    return load(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("filename"))


@query(r"""SELECT page_id, CASE regexp_extract(lower(url), '(\.[^./\\]+)$', 1) WHEN '.pdf' THEN 'pdf' WHEN '.csv' THEN 'table' WHEN '.txt' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.png' THEN 'image' WHEN '.jpg' THEN 'image' ELSE 'unknown' END AS kind, substr(sha256(url), 1, 16) AS legacy_id FROM pages""")
def file_kinds(spark, d):
    return load(spark, d, "pages").select("page_id", files.kind_of(F.col("url")).alias("kind"), files.legacy_doc_id(F.col("url")).alias("legacy_id"))


@query("SELECT doc_id, sha256(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', '')) AS payload_sha256 FROM documents")
def payload_hashes(spark, d):
    return load(spark, d, "documents").select("doc_id", T.upload_payload_hash(F.col("text")).alias("payload_sha256"))
