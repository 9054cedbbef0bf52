"""More registered queries: traces, scores, plans, migration, profiles, and other small operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import contain, context, evaluation, graph, hybrid, memory
from ..session import load
from ..sources import files, journal
from . import versions
from .catalog import CHUNKS, EDGES, _chunks, _edges, query


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index // 4 AS parent_index, count(*) AS n_children, min(chunk_index) AS first_child FROM chunks GROUP BY ALL")
def parent_stats(spark, d):
    got = _chunks(spark, d).groupBy("doc_id", F.floor(F.col("chunk_index") / 4).alias("parent_index"))
    return got.agg(F.count(F.lit(1)).alias("n_children"), F.min("chunk_index").alias("first_child"))


@query(f"WITH {EDGES} SELECT (SELECT count(*) FROM (SELECT subject FROM e UNION SELECT object FROM e)) AS n_entities, (SELECT count(*) FROM e) AS n_relations, (SELECT count(*) FROM embeddings) AS n_vectors")
def store_totals(spark, d):
    e = _edges(spark, d)
    one = e.select(F.explode(F.array("subject", "object")).alias("x")).agg(F.countDistinct("x").alias("n_entities"))
    return one.crossJoin(e.agg(F.count(F.lit(1)).alias("n_relations"))).crossJoin(load(spark, d, "embeddings").agg(F.count(F.lit(1)).alias("n_vectors")))  # one row each


ANSWERS = """ans AS (SELECT doc_id, lang AS mode, text AS answer, [source] AS sources, regexp_extract_all(lower(substr(text, 1, 200)), '[a-z]{4,}')[1:2] AS req, ['pathetic', 'trash'] AS forb, doc_id % 7 = 0 AS abst FROM documents),
s AS (SELECT *, len(list_filter(req, lambda w: contains(lower(answer), w))) AS hits, len(req) AS total, len(list_filter(forb, lambda w: contains(lower(answer), w))) AS bad FROM ans)"""


def _answers(spark, d):
    words = F.slice(F.regexp_extract_all(F.lower(F.substr(F.col("text"), F.lit(1), F.lit(200))), F.lit("[a-z]{4,}"), 0), 1, 2)
    none = F.array().cast("array<string>")
    return load(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("mode"), F.col("text").alias("answer"), F.array("source").alias("sources"), words.alias("required_keywords"), F.array(F.lit("pathetic"), F.lit("trash")).alias("forbidden_keywords"), F.array("source").alias("expected_sources"),
        (F.col("doc_id") % 7 == 0).alias("requires_abstention"), F.lit(0).alias("graph_context_count"), none.alias("negation_target_terms"), none.alias("positive_claim_patterns"))


@query(f"WITH {ANSWERS} SELECT doc_id, CASE WHEN total > 0 THEN round(hits / total, 3) ELSE 1.0 END AS keyword_fact_score, NOT abst AS source_hit, CASE WHEN abst THEN FALSE ELSE hits = total AND bad = 0 END AS question_correct FROM s")
def answer_scores(spark, d):
    return evaluation.score_answers(_answers(spark, d)).select("doc_id", "keyword_fact_score", "source_hit", "question_correct")


@query(f"WITH {ANSWERS} SELECT doc_id, CASE WHEN abst THEN CAST(coalesce(list_bool_or(list_transform(req, lambda w: contains(answer, w))), FALSE) AS DOUBLE) WHEN bad > 0 THEN 0.0 WHEN total > 0 THEN round(hits / total, 3) ELSE 1.0 END AS answer_semantic_score, 1.0 AS source_coverage_score FROM s")
def answer_scores_v2(spark, d):
    return evaluation.score_answers_2(_answers(spark, d)).select("doc_id", "answer_semantic_score", "source_coverage_score")


@query(f"""WITH {ANSWERS}, t AS (SELECT mode, CASE WHEN abst THEN FALSE ELSE hits = total AND bad = 0 END AS a, CASE WHEN abst THEN coalesce(list_bool_or(list_transform(req, lambda w: contains(answer, w))), FALSE) ELSE bad = 0 AND (total = 0 OR hits = total) END AS b FROM s)
SELECT mode, count(*) AS n, round(avg(CAST(a AS INTEGER)), 6) AS accuracy_v1, round(avg(CAST(b AS INTEGER)), 6) AS accuracy_v2, count(*) FILTER (NOT a AND b) AS now_correct, count(*) FILTER (a AND NOT b) AS now_wrong FROM t GROUP BY mode""")
def rescore_summary(spark, d):
    got = evaluation.rescore_summary(evaluation.score_answers_2(evaluation.score_answers(_answers(spark, d))))
    return got.withColumns({c: F.round(c, 6) for c in ("accuracy_v1", "accuracy_v2")})


def _diagnosed(spark, d):
    from .catalog import _expected

    x, o = _expected(spark, d)
    n = x.select("query_id").distinct()
    rows = n.select("query_id", F.lit("graph_rag").alias("mode"), (F.col("query_id").cast("int") % 4 != 0).alias("graph_called"), (F.col("query_id").cast("int") % 3 == 0).alias("answer_correct"), F.lit(False).alias("forbidden"), F.lit(False).alias("requires_abstention"), F.lit(None).cast("boolean").alias("abstention_correct"), F.lit(1.0).alias("source_coverage"), F.lit(True).alias("question_correct"))
    return evaluation.diagnose(x, o, rows)


@query()
def failure_diagnosis(spark, d):
    return _diagnosed(spark, d).withColumn("failures", F.array_join("failures", ","))


@query()
def failure_priorities(spark, d):
    return evaluation.priorities(_diagnosed(spark, d))


@query()
def predicate_confusion(spark, d):
    return evaluation.confusion(_diagnosed(spark, d))


@query("SELECT o_orderpriority AS stage, o_custkey AS fingerprint, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS sources FROM orders GROUP BY ALL")
def merged_traces(spark, d):
    t = load(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_custkey").alias("fingerprint"), F.col("o_orderstatus").alias("source"))
    return evaluation.merged_traces(t).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT stage, candidate_id, CAST(pos AS INTEGER) AS pos, n > 50 AS truncated FROM (SELECT o_orderpriority AS stage, o_orderkey AS candidate_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS pos, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE pos <= 50""")
def trace_snapshots(spark, d):
    o = load(spark, d, "orders").select(F.col("o_orderpriority").alias("stage"), F.col("o_orderkey").alias("candidate_id"), (-F.col("o_totalprice")).alias("rank"))
    return evaluation.clipped(o).select("stage", "candidate_id", "pos", "truncated")


@query("SELECT event_type AS variant, user_id AS component, count(*) AS n FROM events WHERE (event_type = 'error' AND user_id % 2 = 0) OR (event_type = 'click' AND user_id < 10) GROUP BY ALL")
def forbidden_calls(spark, d):
    e = load(spark, d, "events").groupBy(F.col("event_type").alias("variant"), F.col("user_id").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    u = load(spark, d, "events").select(F.col("user_id").alias("component")).distinct()
    rules = u.where("component % 2 = 0").select(F.lit("error").alias("variant"), "component").unionByName(u.where("component < 10").select(F.lit("click").alias("variant"), "component"))
    return evaluation.forbidden_calls(e, rules)


@query("SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def result_determinism(spark, d):
    return evaluation.same_results(load(spark, d, "events"), ["user_id"], "event_type")


@query("SELECT (SELECT count(*) FROM embeddings) AS source_rows, (SELECT count(*) FROM embeddings WHERE vec_id % 3 = 0) AS done_rows, (SELECT count(*) FROM embeddings WHERE vec_id % 3 <> 0) AS left_rows")
def migration_dry_run(spark, d):
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    left = versions.migration_plan(v, v.where("id % 3 = 0"))
    return v.agg(F.count(F.lit(1)).alias("source_rows")).crossJoin(v.where("id % 3 = 0").agg(F.count(F.lit(1)).alias("done_rows"))).crossJoin(left.agg(F.count(F.lit(1)).alias("left_rows")))  # one row each


@query("SELECT event_id FROM events WHERE event_type <> 'error'")
def journal_append(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type")
    return journal.new_events(e.unionByName(e), e.where("event_type = 'error'")).select(F.col("event_id").cast("long").alias("event_id"))


@query("""SELECT c_custkey AS user_id, least(100, greatest(0, 50 + CAST(floor(c_acctbal / 100) AS INTEGER))) AS warmth FROM customer""")
def personality_adjust(spark, d):
    c = load(spark, d, "customer")
    base = c.select(F.col("c_custkey").alias("user_id"), *[F.lit(50).alias(t) for t in ("warmth", "expertise", "humor", "empathy")])
    change = c.select(F.col("c_custkey").alias("user_id"), F.lit("warmth").alias("trait"), F.floor(F.col("c_acctbal") / 100).cast("int").alias("delta"))
    return memory.adjusted(base, change).select("user_id", F.col("warmth").cast("int").alias("warmth"))


@query("SELECT c_custkey, CASE WHEN c_nationkey * 4 > 70 THEN 1 WHEN c_nationkey * 4 < 30 THEN 1 ELSE 0 END + CASE WHEN c_nationkey * 4 > 80 THEN 1 WHEN c_nationkey * 4 < 40 THEN 1 ELSE 0 END AS n_rules FROM customer")
def style_rules(spark, d):
    t = F.col("c_nationkey") * 4
    c = load(spark, d, "customer").select("c_custkey", t.alias("warmth"), t.alias("expertise"), F.lit(50).alias("humor"), F.lit(50).alias("empathy"))
    said = memory.style_instructions()
    return c.select("c_custkey", F.when(said == memory.NEUTRAL, 0).otherwise(F.size(F.split(said, "\n"))).alias("n_rules"))


@query("""WITH p AS (SELECT conv_id, turn, text AS u, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations), w AS (SELECT conv_id, turn, '用户：' || u || chr(10) || '助手：' || a AS x FROM p WHERE a IS NOT NULL)
SELECT conv_id, turn, CASE WHEN length(x) > 200 THEN substr(x, 1, 200) || '...' ELSE x END AS summary FROM w""")
def memory_summaries(spark, d):
    c = load(spark, d, "conversations").withColumn("a", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null")
    return c.select("conv_id", "turn", T.summary(F.col("text"), F.col("a")).alias("summary"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'distractor%' THEN 'distractor' ELSE lower(trim(p_type)) END AS category FROM part")
def report_categories(spark, d):
    return load(spark, d, "part").select("p_partkey", T.report_category(F.col("p_type")).alias("category"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'provider_rate_limit' WHEN o_orderkey % 7 = 1 THEN 'provider_auth' WHEN o_orderkey % 7 = 2 THEN 'provider_http' WHEN o_orderkey % 7 = 3 THEN 'provider_timeout' ELSE 'unknown' END AS category FROM orders")
def failure_categories(spark, d):
    m = F.col("o_orderkey") % 7
    status = F.when(m == 0, 429).when(m == 1, 403).when(m == 2, 500)
    return load(spark, d, "orders").select("o_orderkey", T.failure_category(status, F.when(m == 3, "ReadTimeout").otherwise("Other")).alias("category"))


_KEY_SQL = "lower(replace(replace(replace({}, ' ', ''), '-', ''), '_', ''))"


@query(f"""WITH one AS (SELECT DISTINCT c_name AS one FROM customer UNION SELECT p_name FROM part UNION SELECT n_name FROM nation),
two AS (SELECT replace(p_name, ' ', '-') AS two FROM part UNION SELECT split_part(p_name, ' ', 2) FROM part UNION SELECT upper(p_name) || '_' || p_size FROM part WHERE p_partkey % 50 = 0 UNION SELECT substr(c_name, 1, 17) FROM customer WHERE c_custkey % 50 = 0 UNION SELECT 'N'),
k AS (SELECT one, {_KEY_SQL.format('one')} AS x FROM one), l AS (SELECT two, {_KEY_SQL.format('two')} AS y FROM two)
SELECT one, two FROM k JOIN l ON length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x))""")
def alias_endpoints(spark, d):
    """Names of customers, parts and nations against other spellings: with hyphens, in part, longer ones, cut ones."""
    c, p = load(spark, d, "customer"), load(spark, d, "part")
    name = lambda df, column, as_: df.select(column.alias(as_))
    one = name(c, F.col("c_name"), "one").union(name(p, F.col("p_name"), "one")).union(name(load(spark, d, "nation"), F.col("n_name"), "one"))
    some = p.where("p_partkey % 50 = 0")
    two = name(p, F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), "two").union(name(p, F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), "two"))
    two = two.union(name(some, F.concat(F.upper("p_name"), F.lit("_"), F.col("p_size").cast("string")), "two")).union(name(c.where("c_custkey % 50 = 0"), F.substr("c_name", F.lit(1), F.lit(17)), "two")).union(spark.range(1).select(F.lit("N")))
    return contain.aliases(one.distinct(), two.distinct())


@query("SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system') GROUP BY conv_id")
def conversation_delete(spark, d):
    c = load(spark, d, "conversations")
    return memory.without(c, c.where("role = 'system'")).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_by_key(spark, d):
    return memory.latest(load(spark, d, "events"), ["user_id"], "ts", "event_id").select("user_id", "event_type")


@query("SELECT vec_id AS question_id, 'f' || (vec_id % 7) AS source, CASE WHEN vec_id % 7 > 1 THEN vec_id % 7 ELSE -1 END AS document_id, CASE WHEN vec_id % 7 = 0 THEN 'unmapped' WHEN vec_id % 7 = 1 THEN 'ambiguous' ELSE 'mapped' END AS status FROM embeddings")
def source_mapping(spark, d):
    q = load(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), F.concat(F.lit("f"), (F.col("vec_id") % 7).cast("string")).alias("source"))
    docs = spark.range(1, 7).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"), F.col("id").alias("document_id"))
    docs = docs.unionByName(docs.where("document_id = 1").withColumn("document_id", F.lit(99).cast("long")))
    return files.source_documents(q, docs).withColumn("document_id", F.coalesce("document_id", F.lit(-1).cast("long")))


@query(f"WITH {EDGES} SELECT edge_id, subject || ' --' || predicate || '--> ' || object || ' [direction: forward]' AS evidence FROM e")
def evidence_text(spark, d):
    edge = F.struct("subject", "predicate", "object", F.lit("forward").alias("direction"))
    return _edges(spark, d).select("edge_id", T.edges_text(F.array(edge)).alias("evidence"))


@query("SELECT lang, string_agg('[' || i || '] (' || source || ', vector, ' || printf('%.2f', i / 4.0) || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) WHERE i <= 4 GROUP BY lang")
def prompt_contexts(spark, d):
    w = Window.partitionBy("query_id").orderBy("doc_id")
    c = load(spark, d, "documents").select(F.col("lang").alias("query_id"), "doc_id", "source", F.col("text").alias("content"), F.lit("vector").alias("retrieval_type")).withColumn("rank", F.row_number().over(w)).where("rank <= 4")
    return context.prompt(c.withColumn("score", F.col("rank") / 4.0)).withColumnRenamed("query_id", "lang")


@query("SELECT item_id, len(list_distinct(list_filter(string_split(text, ' '), lambda x: trim(x) <> ''))) AS n_keywords FROM benchmark")
def query_plans(spark, d):
    b = load(spark, d, "benchmark").select("item_id", F.split("text", " ", -1).alias("keywords"))
    return context.query_plans(b).select("item_id", F.size("keywords").cast("long").alias("n_keywords"))


@query(f"WITH {EDGES} SELECT split_part(object, ':', 2) AS query_id, 'LOCATED_IN ' || object AS content, array_to_string(list_sort(list(DISTINCT CAST(CAST(split_part(subject, ':', 2) AS BIGINT) % 3 AS VARCHAR))), ',') AS sources FROM e WHERE predicate = 'LOCATED_IN' GROUP BY ALL")
def graph_facts(spark, d):
    e = _edges(spark, d).where("predicate = 'LOCATED_IN'")
    f = e.select(F.split_part(F.col("object"), F.lit(":"), F.lit(2)).alias("query_id"), F.concat_ws(" ", "predicate", "object").alias("content"), (F.split_part(F.col("subject"), F.lit(":"), F.lit(2)).cast("long") % 3).cast("string").alias("source"))
    return hybrid.facts(f).withColumn("sources", F.array_join("sources", ","))


@query()
def graphrag_contexts(spark, d):
    n = load(spark, d, "nation")
    ents = n.select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name")).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("name")))
    hits = load(spark, d, "benchmark").select((F.col("item_id") % 5).cast("int").alias("query_id"), F.col("text").alias("content"), F.lit(0.7).alias("score"))
    return hybrid.graphrag(hits, ents, _edges(spark, d).withColumn("source", F.col("predicate")))


@query(f"""WITH {EDGES}, ent AS (SELECT n_regionkey AS query_id, 'nation:' || n_nationkey AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY 'nation:' || n_nationkey) AS pos FROM nation)
SELECT a.query_id, a.name AS source, b.name AS target FROM ent a JOIN ent b ON a.query_id = b.query_id AND b.pos > a.pos AND b.pos < a.pos + 3""")
def entity_pairs(spark, d):
    ents = load(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name")).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("name")))
    return hybrid.entity_pairs(ents)


@query()
def graph_recall(spark, d):
    ents = load(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("name")).withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("name")))
    e = _edges(spark, d).select("*", F.lit("d").alias("document_id"), F.lit("ready").alias("status"), F.lit(True).alias("is_current"))
    return hybrid.graph_recall(ents, e).withColumn("edge_ids", F.array_join("edge_ids", ">"))


@query("SELECT c_mktsegment AS name, min_by(c_name, c_custkey) AS type, max_by(c_name, c_custkey) AS description FROM customer GROUP BY c_mktsegment")
def entity_upsert(spark, d):
    c = load(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_name").alias("type"), F.col("c_name").alias("description"), F.col("c_custkey").alias("arrival"))
    return graph.upserted(c)


@query("SELECT o_custkey AS document_id, 'c' || (o_orderkey % 3) AS name FROM orders UNION SELECT o_custkey, 'p' || (o_orderkey % 2) FROM orders")
def entity_mentions(spark, d):
    o = load(spark, d, "orders")
    name = lambda p, k: F.concat(F.lit(p), (F.col("o_orderkey") % k).cast("string"))
    return graph.mentions(o.select(F.col("o_custkey").alias("document_id"), name("c", 3).alias("name")), o.select(F.col("o_custkey").alias("document_id"), name("c", 3).alias("head"), name("p", 2).alias("tail")))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1800 second ORDER BY ts DESC, event_id LIMIT 500")
def cache_lifetime(spark, d):
    e = load(spark, d, "events").select(F.col("event_id").alias("key"), F.col("ts").alias("stored_at"))
    top = e.agg(F.max("stored_at").alias("now"))
    got = evaluation.fresh(e.crossJoin(F.broadcast(top)), F.col("now"))  # one row
    return got.select(F.col("key").alias("event_id"), F.col("stored_at").alias("ts"))
