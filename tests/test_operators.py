import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, context, evaluation, fusion, graph, memory, retrieval
from siltstone.plans import versions
from siltstone.sources import cdc, files, journal


def test_windows_at_the_edges(spark):
    df = spark.createDataFrame([(1, "a" * 449), (2, ""), (3, None), (4, "a" * 448), (5, " " * 500 + "b" * 600)], "doc_id long, text string")
    got = {}
    for r in chunking.fixed_windows(df).collect():
        got.setdefault(r.doc_id, []).append((r.chunk_index, r.char_start, r.char_end, len(r.content)))
    assert got == {1: [(0, 0, 512, 449), (1, 448, 960, 1)], 4: [(0, 0, 512, 448)], 5: [(0, 0, 512, 12), (1, 448, 960, 460), (2, 896, 1408, 204)]}


def test_parents_and_children(spark):
    text = "one two three. four five six. " * 4 + "\n\n" + "seven eight nine ten"
    got = chunking.parent_child(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), limits=(12, 18, 5, 1)).collect()
    parents = [r for r in got if r.kind == "parent"]
    children = [r for r in got if r.kind == "child"]
    assert [r.chunk_index for r in children] == list(range(len(children)))
    assert {r.parent_chunk_id for r in children} == {r.chunk_id for r in parents}
    assert all(r.doc_id == 1 for r in got)
    assert list(chunking.parents_of([("table", "h\n1\n\n2"), ("text", "x")])) == ["h\n1\n\n2", "x"]
    assert "".join(chunking.cut_to("a" * 30, 10)) == "a" * 30  # one word is one token: stays whole
    assert all(len(p) <= 10 for p in chunking.cut_to("防" * 35, 10))


def test_markdown(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n\n## B\n\n# C\ny"), (2, "plain"), (3, "")], "doc_id long, text string")
    got = [(r.doc_id, r.title, r.content) for r in chunking.markdown_blocks(df).orderBy("doc_id", "block").collect()]
    assert got == [(1, None, "intro"), (1, "A", "x"), (1, "C", "y"), (2, None, "plain")]


def lists(spark, rows):
    return spark.createDataFrame([("q", *r) for r in rows], "query_id string, retrieval_type string, candidate_id string, rank int, source string")


def test_rrf(spark):
    got = fusion.rrf(lists(spark, [("bm25", "A", 1, "s"), ("bm25", "B", 2, "s"), ("vector", "A", 3, "s"), ("vector", "C", 1, "s")])).orderBy("fused_rank").collect()
    assert got[0].candidate_id == "A" and abs(got[0].rrf_score - (1 / 61 + 1 / 63)) < 1e-12
    assert got[0].source_ranks == {"bm25": 1, "vector": 3} and [r.candidate_id for r in got] == ["A", "C", "B"]


def test_rrf_rejections(spark):
    rows = [("bm25", "A", 1, "s"), ("vector", "A", 1, "other"), ("bm25", "B", 2, "s"), ("bm25", "C", 2, "s"), ("web", "D", 1, "s"), ("bm25", "E", 0, "s"), ("graph", "F", 1, "s"), ("graph", "F", 2, "s"), ("graph", "G", 3, "s")]
    assert [r.candidate_id for r in fusion.rrf(lists(spark, rows)).collect()] == ["G"]
    d = fusion.rrf_diagnostics(lists(spark, rows)).first()
    assert (d.input_count, d.invalid_count, d.conflict_count, d.unique_count, d.output_count) == (9, 4, 1, 2, 1)


def test_rerank_needs_whole_scores(spark):
    fused = fusion.rrf(lists(spark, [("bm25", "A", 1, "s"), ("bm25", "B", 2, "s")]))
    score = lambda *rows: spark.createDataFrame([("q", *r) for r in rows], "query_id string, candidate_id string, score double")
    assert [r.candidate_id for r in fusion.rerank(fused, score(("A", 0.1), ("B", 0.9))).orderBy("post_rank").collect()] == ["B", "A"]
    for bad in (score(("B", 0.9)), score(("A", math.nan), ("B", 0.9)), score(("A", 0.1), ("B", 0.9), ("C", 1.0)), None):
        got = fusion.rerank(fused, bad).orderBy("post_rank").collect()
        assert [r.candidate_id for r in got] == ["A", "B"] and got[0].rerank_score is None


def test_scope_fails_closed(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta"), (2, 0, "alpha")], "doc_id long, chunk_index int, content string")
    q = spark.createDataFrame([(7, "alpha alpha")], "query_id long, query string")
    none = spark.createDataFrame([], "doc_id long")
    assert retrieval.bm25(q, chunks, 5).count() == 2
    assert retrieval.bm25(q, chunks, 5, allowed=none).count() == 0
    once = retrieval.bm25(q.withColumn("query", F.lit("alpha")), chunks, 5).orderBy("doc_id").first().score
    assert abs(retrieval.bm25(q, chunks, 5).orderBy("doc_id").first().score - 2 * once) < 1e-7


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [math.nan, 1.0]), (5, None), (6, [1.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.vec_id, round(r.score, 6)) for r in retrieval.vector_topk(q, v, 3).orderBy("rank").collect()] == [(1, 1.0), (6, 1.0), (3, 0.707107)]
    assert retrieval.vector_topk(q, v, 3, allowed=spark.createDataFrame([], "vec_id long")).count() == 0
    assert retrieval.vector_topk(q.limit(0), v, 3).count() == 0


def test_budget_skips_and_falls_back(spark):
    rows = [("q", "a", 1, 50, None), ("q", "b", 2, 60, 30), ("q", "c", 3, 60, None), ("q", "d", 4, 20, None), ("q", "e", 5, 1, None)]
    df = spark.createDataFrame(rows, "query_id string, context_id string, final_rank int, estimated_token_count long, fallback_tokens long")
    got = {r.context_id: (r.position, r.reason) for r in context.budgeted(df, top=3, budget=100).collect()}
    assert got == {"a": (1, "fits"), "b": (2, "parent_to_child_fallback"), "c": (None, "budget_exceeded"), "d": (3, "fits"), "e": (None, "top_k_truncated")}


def test_expand_keeps_scope_and_kinds(spark):
    c = spark.createDataFrame(
        [("q", "k1", "child one", 1, 1, "k1", "p0", ["bm25"], 0.1, 1), ("q", "k2", "child two", 1, 1, "k2", "p0", ["vector"], 0.2, 2), ("q", "k3", "x", 2, 1, "k3", "p9", ["bm25"], 0.1, 3), ("q", "g", "a --b--> c", 1, 1, None, None, ["graph"], 0.1, 4)],
        "query_id string, candidate_id string, content string, document_id long, document_version int, chunk_id string, parent_chunk_id string, retrieval_types array<string>, rrf_score double, post_rank int")
    p = spark.createDataFrame([("parent", "ready", True, 1, 1, "p0", "whole", 7)], "kind string, status string, is_current boolean, document_id long, document_version int, chunk_id string, content string, estimated_token_count long")
    got = {r.context_id: (r.kind, r.content, r.final_rank) for r in context.expand(c, p).collect()}
    assert got == {"parent:1:v1:p0": ("parent", "whole", 1), "child:k3": ("child_fallback", "x", 3), "graph:g": ("graph_evidence", "a --b--> c", 4)}
    assert context.expand(c, p, allowed=spark.createDataFrame([], "doc_id long")).count() == 0
    assert {r.kind for r in context.expand(c, p, enabled=False).collect()} == {"child_fallback", "graph_evidence"}


def test_paths_use_an_edge_once(spark):
    e = spark.createDataFrame([("1", "a", "USES", "b"), ("2", "b", "USES", "c"), ("3", "c", "USES", "a")], "edge_id string, subject string, predicate string, object string")
    got = graph.paths(e, spark.createDataFrame([("a",)], "name string"), 5, None).collect()
    assert max(r.hops for r in got) == 3 and all(len(set(r.edge_ids)) == len(r.edge_ids) for r in got)
    s = graph.shortest_paths(e, spark.createDataFrame([("a", "c")], "source string, target string"), 5, 2).orderBy("length").collect()
    assert [(r.length, r.edge_ids) for r in s] == [(1, ["3"]), (2, ["1", "2"])]


def test_paths_through_a_hub(spark):
    """A hub of 400 neighbours: a start stops as soon as it has its paths, and the first are kept."""
    e = spark.createDataFrame([(f"{k:04d}", f"n{k}", "USES", "hub") for k in range(400)], "edge_id string, subject string, predicate string, object string")
    got = graph.paths(e, spark.createDataFrame([("n7",), ("hub",), ("alone",)], "name string"), 5, 50).collect()
    assert sorted(r.edge_ids for r in got if r.start == "hub") == [[f"{k:04d}"] for k in range(50)]
    assert sorted(r.edge_ids for r in got if r.start == "n7") == [["0007"], *[["0007", f"{k:04d}"] for k in range(50) if k != 7]]
    every = graph.paths(e, spark.createDataFrame([("n7",)], "name string"), 3, None).collect()
    assert len(every) == 400


def test_entities(spark):
    ent = spark.createDataFrame([("a", "org", "", 1), ("a", "person", "first", 2), ("a", "x", None, 3)], "name string, type string, description string, arrival int")
    r = graph.upserted(ent).first()
    assert (r.type, r.description) == ("org", "first")
    linked = graph.link_entities(spark.createDataFrame([(1, "who runs North Star now")], "query_id long, query string"), spark.createDataFrame([("north star",), ("south",)], "name string"))
    assert [(r.query_id, r.name) for r in linked.collect()] == [(1, "north star")]


def test_metrics_variants(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("r", "a", 1)], "query_id string, item string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, item string")
    m = {r.query_id: r for r in evaluation.ir_metrics(ranked, rel).collect()}
    assert m["q"].recall_at_3 == 1.0 and m["q"].recall_at_1 == 0.5 and m["q"].ndcg_at_10 == 1.0 and m["q"].mrr == 1.0
    assert m["r"].mrr is None and m["r"].recall_at_1 is None
    assert {r.query_id: r.recall_at_3 for r in evaluation.ir_metrics(ranked, rel, dedupe=False).collect()}["q"] == 1.5
    assert {r.query_id: r.recall_at_10 for r in evaluation.ir_metrics(ranked, rel, available=5).collect()}["q"] is None


def test_scorers(spark):
    base = dict(sources=["a.txt"], required_keywords=["Blue"], forbidden_keywords=["red"], expected_sources=["a.txt"], requires_abstention=False, mode="vector_only", graph_context_count=0, negation_target_terms=[], positive_claim_patterns=[])
    cases = [dict(base, answer="it is blue"), dict(base, answer="blue and red"), dict(base, answer="blue", mode="graph_rag"), dict(base, answer="无法确定", requires_abstention=True, sources=[]), dict(base, answer="周宁并不负责北极星", negation_target_terms=["周宁", "北极星"], positive_claim_patterns=["周宁负责"])]
    schema = "answer string, sources array<string>, required_keywords array<string>, forbidden_keywords array<string>, expected_sources array<string>, requires_abstention boolean, mode string, graph_context_count int, negation_target_terms array<string>, positive_claim_patterns array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(c[n] for n in names) for c in cases], schema)
    assert [r.question_correct for r in evaluation.score_answers(df).collect()][:4] == [True, False, False, True]
    got = evaluation.score_answers_2(df).collect()
    assert [r.question_correct_v2 for r in got] == [True, False, True, True, True] and got[4].answer_rule == "negation_supported"


def test_diagnosis(spark):
    e = spark.createDataFrame([("q", "a", "USES", "b", "forward"), ("q", "b", "USES", "c", "forward")], "query_id string, subject string, predicate string, object string, direction string")
    o = spark.createDataFrame([("q", "a", "OWNS", "b", "forward"), ("q", "b", "USES", "c", "reverse"), ("q", "x", "OWNS", "y", "forward")], e.schema)
    rows = spark.createDataFrame([("q", "graph_rag", True, False, False, False, None, 1.0, False), ("z", "vector_only", False, True, True, True, True, 1.0, False)], "query_id string, mode string, graph_called boolean, answer_correct boolean, forbidden boolean, requires_abstention boolean, abstention_correct boolean, source_coverage double, question_correct boolean")
    got = {r.query_id: r for r in evaluation.diagnose(e, o, rows).collect()}
    assert got["q"].n_exact == 0
    assert got["q"].failures == ["direction_reversed", "expected_edge_missing_from_prompt", "incomplete_multi_hop_path", "insufficient_evidence", "irrelevant_graph_evidence", "predicate_mismatch", "subject_object_mismatch"] or set(got["q"].failures) >= {"direction_reversed", "predicate_mismatch", "irrelevant_graph_evidence"}
    assert set(got["z"].failures) == {"forbidden_fact_generated", "scorer_false_negative", "scorer_not_applicable"}


def test_gaps(spark):
    t = spark.createDataFrame([("1", "a1", "USES", "b1"), ("2", "a1", "USES", "b1"), ("3", "a1", "USES", "b1"), ("4", "a1", "USES", "b1"), ("5", "a1", "USES", "b1")], "query_id string, subject string, predicate string, object string")
    x = spark.createDataFrame([("1", "a1", "USES", "b1"), ("2", "b1", "USES", "a1"), ("3", "a1x", "OWNS", "b1"), ("4", "a1x", "USES", "b1")], t.schema)
    assert [r.gap for r in evaluation.extraction_gap(t, x).orderBy("query_id").collect()] == ["extracted", "direction_reversed", "canonicalization_gap", "endpoint_alias_mismatch", "no_relation_extracted"]


def test_scope_loss_needs_a_record(spark):
    ex = spark.createDataFrame([("q", 1), ("q", 2)], "query_id string, edge int")
    ob = spark.createDataFrame([("q", s, e) for e in (1, 2) for s in evaluation.STAGES[:4]], "query_id string, stage string, edge int")
    have = spark.createDataFrame([("q", s) for s in evaluation.STAGES], "query_id string, stage string")
    refused = spark.createDataFrame([("q", 1)], "query_id string, edge int")
    assert {r.edge: r.first_loss for r in evaluation.first_loss(ex, ob, have, refused).collect()} == {1: "scope_filtered", 2: "insufficient_evidence"}


def test_versions(spark):
    reg = spark.createDataFrame([("n", "k", 1, "h1", True)], "namespace string, logical_key string, version int, content_hash string, is_current boolean")
    up = spark.createDataFrame([("n", "k", 1, "h1"), ("n", "k", 2, "h2"), ("n", "k", 3, "h2"), ("n", "new", 1, "h1")], "namespace string, logical_key string, arrival int, content_hash string")
    got = [(r.logical_key, r.arrival, r.version, r.outcome) for r in versions.reserve(reg, up).orderBy("logical_key", "arrival").collect()]
    assert got == [("k", 1, 1, "unchanged"), ("k", 2, 2, "reserved"), ("k", 3, 2, "unchanged"), ("new", 1, 1, "reserved")]
    back = spark.createDataFrame([("n", "k", i, h) for i, h in enumerate("ABACB")], "namespace string, logical_key string, arrival int, content_hash string")
    got = [(r.version, r.outcome) for r in versions.reserve(reg.limit(0), back).orderBy("arrival").collect()]
    assert got == [(1, "reserved"), (2, "reserved"), (1, "unchanged"), (3, "reserved"), (2, "unchanged")]  # content of any version counts
    ptr = spark.createDataFrame([("d1", 1), ("d2", 1)], "document_id string, version int")
    ch = spark.createDataFrame([("d1", 2, 1), ("d1", 3, 2), ("d2", None, 3), ("d3", 1, 4)], "document_id string, version int, seq int")
    assert sorted((r.document_id, r.version) for r in versions.activated(ptr, ch).collect()) == [("d1", 3), ("d3", 1)]
    now = F.lit(dt.datetime(2024, 1, 1))
    locks = spark.createDataFrame([("d1", "o1", dt.datetime(2024, 1, 2)), ("d2", "o1", dt.datetime(2023, 1, 1))], "document_id string, operation_id string, expires_at timestamp")
    wants = spark.createDataFrame([("d1", "o2"), ("d2", "o2"), ("d2", "o3"), ("d1", "o1")], "document_id string, operation_id string")
    assert {(r.document_id, r.operation_id): r.granted for r in versions.leased(locks, wants, now).collect()} == {("d1", "o2"): False, ("d1", "o1"): True, ("d2", "o2"): True, ("d2", "o3"): False}


def test_memory(spark):
    m = spark.createDataFrame([("s", 1, "我叫小明，你好"), ("s", 2, "我叫小红"), ("t", 1, "是工程师。")], "session_id string, turn int, text string")
    assert {r.session_id: (r.name, r.role) for r in memory.profile(m).collect()} == {"s": ("小明", None), "t": (None, "工程师")}
    p = spark.createDataFrame([("u", 95, 10, 50, 50)], "user_id string, warmth int, expertise int, humor int, empathy int")
    c = spark.createDataFrame([("u", "warmth", 20), ("u", "expertise", -30)], "user_id string, trait string, delta int")
    r = memory.adjusted(p, c).withColumn("style", memory.style_instructions()).first()
    assert (r.warmth, r.expertise) == (100, 0) and len(r.style.split("\n")) == 2


def test_change_events(spark):
    raw = spark.createDataFrame([('{"op":"u","ts_ms":1000,"source":{"connector":"pg","table":"t"},"before":{"content":"a"},"after":{"content":"b"}}',), ('{"op":"d","ts_ms":2000}',)], "value string")
    got = cdc.decoded(raw).orderBy("timestamp").collect()
    assert [r.operation for r in got] == ["UPDATE", "DELETE"] and got[0].after == {"content": "b"}
    raw = spark.createDataFrame([('{"id":"e1","ts_ms":1500,"source":{}}',), ('{"id":"e1","ts_ms":1501}',)], "value string")
    assert [(r.event_id, r.operation, r.resource_path, r.timestamp) for r in cdc.decoded(raw).orderBy("timestamp").collect()] == [("e1", "UPDATE", "unknown", 1.5), ("e1", "UPDATE", "unknown", 1.501)]
    r = cdc.line_diff(spark.createDataFrame([("a\rb\x0bc", "a\nb\u2028d\r\n")], "before string, after string")).first()
    assert (r.added_count, r.removed_count) == (1, 1)
    d = cdc.line_diff(spark.createDataFrame([("a\nb", "a\nc\nc"), (None, "x"), ("", "")], "before string, after string")).collect()
    assert [(r.added_count, r.removed_count, r.change_ratio) for r in d] == [(1, 1, 0.4), (1, 0, 1.0), (0, 0, 0.0)]


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody\r\nmore")
    (tmp_path / "b.txt").write_text("  plain ")
    docs = files.read_texts(spark, str(tmp_path)).select(F.col("path").alias("doc_id"), "path", "text")
    assert sorted((r.title or "", r.content) for r in files.structured(docs).collect()) == [("", "plain"), ("T", "body\nmore")]
    assert files.tree_hash(files.file_hashes(spark, str(tmp_path))).first().tree_sha256 is not None
    assert files.uploads(files.read_binary(spark, str(tmp_path))).count() == 2
    files.write_report(docs.select("path"), str(tmp_path / "out"), "csv")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_journal(spark, tmp_path):
    rows = [("s1", "e1", "extracted"), ("s1", "e2", "bad"), ("s0", "e3", "ranked"), ("s1", "e1", "extracted")]
    df = spark.createDataFrame(rows, "schema string, event_id string, stage string")
    assert sorted((r.event_id, r.problem) for r in journal.problems(df, "s1").distinct().collect()) == [("e1", "repeated"), ("e2", "stage"), ("e3", "schema"), ("e3", "stage")]
    assert {r.event_id for r in journal.new_events(df, df.where("event_id = 'e1'")).collect()} == {"e2", "e3"}


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fuse", "graph_neighbors_h2"])
def test_partitions_do_not_matter(spark, data, name):
    from siltstone.plans import catalog

    a = catalog.QUERIES[name](spark, data).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        b = catalog.QUERIES[name](spark, data).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, a)) == sorted(map(str, b))


def _brute_counts(e, o):
    same = lambda x, y, f: all(x[c] == y[c] and x[c] is not None for c in f)
    by = lambda *f: {x for x in e if any(same(x, y, f) for y in o)}
    exact, ends, named, pred = by(0, 1, 2, 3), by(0, 2), by(0, 1, 2), by(1)
    near = {y for y in o if any(same(x, y, [0]) or same(x, y, [2]) for x in e)}
    found = {"expected_edge_missing_from_prompt": e - o, "insufficient_evidence": e - o, "predicate_mismatch": ends - named, "direction_reversed": named - exact, "subject_object_mismatch": pred - ends, "irrelevant_graph_evidence": o - near}
    found |= {"incomplete_multi_hop_path": e - exact if len(e) > 1 else (), "graph_top_k_dilution": o if not near else (), "no_graph_evidence": () if o else e, "correct_evidence_but_wrong_answer": () if e - exact else e}
    return len(e), len(o), len(exact), sorted(k for k, v in found.items() if v) if e else ["no_expected_relation", "scorer_not_applicable"]


def test_diagnosis_counts_edges_instead_of_comparing_them(spark):
    """Against brute force, with nulls and repeated edges; no query's edges are put into one row, where they were compared pair by pair."""
    rng = random.Random(5)
    pick = lambda x: rng.choice([*x, None] if rng.random() < 0.3 else x)
    edge = lambda: (pick("abcd"), pick("UVW"), pick("abcd"), pick(["forward", "reverse"]))
    sets = {f"q{k}": ([edge() for _ in range(rng.randrange(5))], [edge() for _ in range(rng.randrange(5))]) for k in range(120)}
    sets |= {f"s{k}": (x, rng.sample(x, len(x)) + [edge() for _ in range(k % 2)]) for k, x in enumerate([[edge() for _ in range(rng.randrange(1, 4))] for _ in range(40)])}
    schema = "query_id string, subject string, predicate string, object string, direction string"
    e, o = (spark.createDataFrame([(q, *x) for q, s in sets.items() for x in s[i] + s[i][:1]], schema) for i in (0, 1))
    rows = spark.createDataFrame([(q, "graph_rag", True, False, False, False, None, 1.0, False) for q in sets], "query_id string, mode string, graph_called boolean, answer_correct boolean, forbidden boolean, requires_abstention boolean, abstention_correct boolean, source_coverage double, question_correct boolean")
    df = evaluation.diagnose(e, o, rows)
    got = {r.query_id: (r.n_expected, r.n_observed, r.n_exact, r.failures) for r in df.collect()}
    assert got == {q: _brute_counts(set(x), set(y)) for q, (x, y) in sets.items()}
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()


def _brute_of_nations(duck):
    """Failures of each nation's edges as more._diagnosed makes them."""
    out = []
    for q, names in duck.sql("SELECT k, list(n) FROM (SELECT s_nationkey AS k, 'supplier:' || s_suppkey AS n FROM supplier UNION ALL SELECT c_nationkey, 'customer:' || c_custkey FROM customer) GROUP BY k").fetchall():
        e = {(x, "LOCATED_IN", f"nation:{q}", "forward") for x in names}
        key = lambda x: int(x[0].split(":")[1])
        o = {(x[0], "USES" if key(x) % 3 == 0 else x[1], x[2], "reverse" if key(x) % 5 == 0 else x[3]) for x in e if key(x) % 7}
        out += [f for f in _brute_counts(e, o)[3] if f != "correct_evidence_but_wrong_answer" or q % 3]
    return out


def test_failure_priorities_of_nations(spark, data, duck):
    from siltstone.plans import catalog, more  # noqa: F401

    df, found = catalog.QUERIES["failure_priorities"](spark, data), _brute_of_nations(duck)
    assert {tuple(r) for r in df.collect()} == {(i, f, found.count(f)) for i, f in enumerate(evaluation.PRIORITIES) if f in found}
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_predicate_confusion_of_nations(spark, data, duck):
    from siltstone.plans import catalog, more  # noqa: F401

    df, found = catalog.QUERIES["predicate_confusion"](spark, data), _brute_of_nations(duck)
    assert {tuple(r) for r in df.collect()} == {(name, found.count(f)) for f, name in evaluation.CONFUSION.items() if f in found}
    assert "collect_set" not in df._jdf.queryExecution().optimizedPlan().toString()
