"""Search, containment, paths and frozen vectors against brute force in plain Python; plans where they matter."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exact
from siltstone.operators import chunking, contain, graph, provenance, retrieval
from siltstone.sources import cdc

WORDS = ["alpha", "beta", "straße", "STRASSE", "ﬁne", "fine", "/srv/App_1.log", "x-ray", "天枢平台", "平台", "é", "Ⅷ", "b"]


def brute_bm25(queries, chunks, k, allowed=None):
    toks = {c: exact.tokens(t) for c, t in chunks.items()}
    n, avg = len(chunks), max(1.0, sum(map(len, toks.values())) / len(chunks))
    df = Counter(t for x in toks.values() for t in set(x))
    out = {}
    for q, text in queries.items():
        asked, scores = Counter(exact.tokens(text)), []
        for c, own in toks.items():
            tf, s = Counter(own), 0.0
            for t, times in asked.items():
                if tf[t]:
                    s += times * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / avg))
            if s > 0 and (allowed is None or c[0] in allowed):
                scores.append((-round(s, 8), c))
        out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_bm25_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", block)
    rng = random.Random(block)
    chunks = {(d, c): " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 12))) for d in range(60) for c in range(3)}
    queries = {q: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))) for q in range(90)}
    q = spark.createDataFrame(list(queries.items()), "query_id long, query string")
    c = spark.createDataFrame([(*k, v) for k, v in chunks.items()], "doc_id long, chunk_index int, content string").repartition(5)
    for allowed in (None, set(range(0, 60, 7)), set()):
        scope = None if allowed is None else spark.createDataFrame([(d,) for d in allowed], "doc_id long")
        got = {}
        for r in retrieval.bm25(q, c, 4, allowed=scope).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(((r.doc_id, r.chunk_index), r.score))
        want = {k: v for k, v in brute_bm25(queries, chunks, 4, allowed).items() if v}
        assert got.keys() == want.keys()
        for k in want:
            assert [x for x, _ in got[k]] == [x for x, _ in want[k]] and all(abs(a - b) < 2e-8 for (_, a), (_, b) in zip(got[k], want[k]))


def test_bm25_reads_chunks_once(spark, data, monkeypatch):
    """The index is made by one pass; the plan that ranks reads the index, never the texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    q = spark.createDataFrame([(1, "de la en")], "query_id long, query string")
    seen = []
    whole = retrieval.staged
    monkeypatch.setattr(retrieval, "staged", lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or whole(df, name))
    plan = retrieval.bm25(q, chunking.fixed_windows(docs), 3)._jdf.queryExecution().executedPlan().toString()
    made = [p for name, p in seen if name == "bm25"]
    assert len(made) == 1 and made[0].count("FileScan") == 1 and "Exchange" not in made[0]
    assert plan.count("FileScan") == 1 and "documents.parquet" not in plan and plan.count("Exchange hash") == 1


def test_tokens_fold_exactly():
    pattern = re.compile(r"/(?:[A-Za-z0-9_.-]+/)*[A-Za-z0-9_.-]+|[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*|[㐀-鿿豈-﫿]+")
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        text = f"a{chr(c)}b"
        want = [t for p in pattern.findall(unicodedata.normalize("NFKC", text).casefold()) for t in [p, *([p[i : i + 2] for i in range(len(p) - 1)] if "㐀" <= p[0] <= "鿿" or "豈" <= p[0] <= "﫿" else [])]]
        if exact.tokens(text) != want:
            raise AssertionError((hex(c), exact.tokens(text), want))


def test_windows_equal_slices(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "é🎉x" * 700, "a" * 448, "a" * 449, "a" * 512, " " * 600 + "b", "\n".join("wx yz" for _ in range(400))] + ["".join(rng.choice("ab \n🎉é") for _ in range(rng.randrange(3000))) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size, overlap in ((512, 64), (10, 4), (10, 0), (7, 6)):
        want = []
        for i, t in enumerate(texts if size > 50 else texts[-8:], 0 if size > 50 else len(texts) - 8):
            cut = [(s, (t or "")[s : s + size].strip(" \t\n\r\x0b\x0c")) for s in range(0, len(t or ""), size - overlap)]
            want += [(i, k, s, s + size, x) for k, (s, x) in enumerate(c for c in cut if c[1])]
        own = df if size > 50 else df.where(F.col("doc_id") >= len(texts) - 8)
        assert sorted(tuple(r) for r in chunking.fixed_windows(own, size=size, overlap=overlap).collect()) == sorted(want)


def test_lines_equal_splitlines(spark):
    texts = ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\r\n\r\n", "a\r\n", "a\n\rb"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", cdc.lines(F.col("t")).alias("l")).orderBy("i").collect()
    assert [list(r.l) for r in got] == [t.splitlines() for t in texts]


def test_containing_equals_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abc é%_\n") for _ in range(n))
    texts = [(i % 40, word(rng.randrange(0, 30))) for i in range(60)] + [(99, None)]
    needles = [(i, word(rng.randrange(0, 6))) for i in range(80)] + [(98, None), (97, "zzz")]
    a = spark.createDataFrame(texts, "id long, text string").repartition(3)
    b = spark.createDataFrame(needles, "needle_id long, needle string")
    want = {(i, j) for i, t in texts for j, n in needles if t is not None and n and n in t}
    rows = contain.containing(a, b).collect()
    assert {(r.id, r.needle_id) for r in rows} == want and len(rows) == len(want)
    assert contain.containing(a, b.limit(0)).count() == 0 and contain.containing(a.limit(0), b).count() == 0
    key = lambda t: re.sub(r"[\s_-]", "", t).lower()
    one, two = {t for _, t in texts if t}, {n for _, n in needles if n}
    got = {tuple(r) for r in contain.aliases(spark.createDataFrame([(x,) for x in one], "one string"), spark.createDataFrame([(x,) for x in two], "two string")).collect()}
    assert got == {(x, y) for x in one for y in two if len(key(x)) > 1 and len(key(y)) > 1 and (key(x) in key(y) or key(y) in key(x))}


def brute_paths(edges, source, target, hops, limit):
    both = {}
    for e, a, b in edges:
        both.setdefault(a, []).append((e, b))
        if a != b:
            both.setdefault(b, []).append((e, a))
    found, now = [], [(source, ())]
    for n in range(1, hops + 1):
        now = [(b, (*ids, e)) for node, ids in now for e, b in both.get(node, []) if e not in ids]
        found += sorted((n, ids) for node, ids in now if node == target)
    return found[:limit]


@pytest.mark.parametrize("seed,hops,limit", [(1, 5, 3), (2, 4, 1), (3, 5, 10), (4, 1, 2), (5, 3, 4)])
def test_paths_equal_brute_force(spark, seed, hops, limit):
    """Few nodes, double edges and loops, so that paths cross themselves."""
    rng = random.Random(seed)
    edges = [(f"e{k:02d}", f"n{rng.randrange(7)}", f"n{rng.randrange(7)}") for k in range(13)]
    pairs = [(f"n{a}", f"n{b}") for a in range(7) for b in range(7)] + [("n1", "nowhere")]
    df = spark.createDataFrame(edges, "edge_id string, subject string, object string")
    got = {}
    for r in graph.shortest_paths(df, spark.createDataFrame(pairs, "source string, target string"), hops, limit).collect():
        got.setdefault((r.source, r.target), []).append((r.length, tuple(r.edge_ids)))
    for p in pairs:
        assert sorted(got.get(p, [])) == brute_paths(edges, *p, hops, limit)


def test_paths_through_a_hub(spark):
    """A hub of 100,000 edges: its neighbours aren't paired."""
    hub = spark.range(100_000).select(F.col("id").alias("edge_id"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("subject"), F.lit("hub").alias("object"))
    more = spark.createDataFrame([(100_000, "n5", "far"), (100_001, "far", "n7"), (100_002, "n9", "n5")], "edge_id long, subject string, object string")
    pairs = spark.createDataFrame([("n5", "n7"), ("n9", "n7"), ("n1", "n2"), ("n3", "far")], "source string, target string")
    got = {(r.source, r.target, r.length, tuple(r.edge_ids)) for r in graph.shortest_paths(hub.unionByName(more), pairs, 5, 2).collect()}
    assert {("n5", "n7", 2, (5, 7)), ("n5", "n7", 2, (100_000, 100_001)), ("n9", "n7", 2, (9, 7)), ("n1", "n2", 2, (1, 2)), ("n3", "far", 3, (3, 5, 100_000)), ("n3", "far", 3, (3, 7, 100_001))} <= got and len(got) <= 8


def test_frozen_vectors_hold_identity(spark):
    plans = spark.createDataFrame([("q1", "p1", ["one", "two"]), ("q2", "p2", ["x"])], "question_id string, plan_hash string, queries array<string>")
    planned = provenance.planned_queries(plans)
    v = spark.createDataFrame([("q1", 0, [1.0, 0.0]), ("q1", 1, [0.0, 1.0]), ("q2", 0, [0.5, 0.5])], "question_id string, query_ordinal int, vector array<double>")
    space = F.lit("space")
    records = provenance.frozen(planned, v, "run", space)
    root = provenance.root_hash(records).first().root
    ask = lambda planned=planned, records=records, run="run", space=space, dimension=2, root=root: {(r.question_id, r.query_ordinal): r.status for r in provenance.frozen_vectors(planned, records, run, space, dimension, root).collect()}
    assert set(ask().values()) == {"ok"} and set(ask(root=None).values()) == {"incomplete"}
    assert set(ask(records=records.where("question_id = 'q1'")).values()) == {"root_mismatch"}
    for change in ({"run": "other"}, {"space": F.lit("other")}, {"dimension": 4}):
        assert set(ask(**change).values()) == {"mismatch"}
    changed = provenance.planned_queries(plans.withColumn("queries", F.array(F.lit("changed"), F.lit("two"))))
    assert ask(planned=changed) == {("q1", 0): "mismatch", ("q1", 1): "ok", ("q2", 0): "mismatch", ("q2", 1): "missing"}
    nine = records.withColumn("vector", F.when(F.col("question_id") == "q2", F.array(F.lit(9.0), F.lit(0.5))).otherwise(F.col("vector")))
    assert ask(records=nine)["q2", 0] == "mismatch" and ask(records=nine)["q1", 0] == "ok"


def test_selection_is_whole_or_nothing(spark):
    docs = spark.createDataFrame([(i, f"f{i}", i) for i in range(4)], "document_id long, filename string, position int")
    q = spark.createDataFrame([(1, ["f0", "f1"], 0), (2, ["f3"], 1)], "question_id long, expected_sources array<string>, position int")
    ids = lambda name, *xs: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    a, b = provenance.selected(docs, q, ids("document_id", 1, 0), ids("question_id", 1))
    assert [r.document_id for r in a.collect()] == [0, 1] and [r.question_id for r in b.collect()] == [1]
    for d, k in ((ids("document_id", 0), ids("question_id", 1)), (ids("document_id", 0, 1, 77), ids("question_id", 1)), (ids("document_id", 0, 1), ids("question_id"))):
        assert all(x.count() == 0 for x in provenance.selected(docs, q, d, k))


def test_uploads_without_a_name_share_one(spark):
    from siltstone.plans import versions

    none = spark.createDataFrame([], "namespace string, logical_key string, version int, content_hash string")
    up = spark.createDataFrame([("n", None, 1, "a"), ("n", None, 2, "b"), ("n", "", 3, "a"), (None, "k", 4, "c")], "namespace string, logical_key string, arrival long, content_hash string")
    got = {r.arrival: (r.namespace, r.logical_key, r.version, r.outcome) for r in versions.reserve(none, up).collect()}
    assert got == {1: ("n", "unnamed", 1, "reserved"), 2: ("n", "unnamed", 2, "reserved"), 3: ("n", "unnamed", 1, "unchanged"), 4: ("unnamed", "k", 1, "reserved")}


def test_strict_join_accounts_for_all(spark):
    from siltstone.operators import strict

    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, "w"), (None, "n"), (5, "v")], "k int, a string")
    b = spark.createDataFrame([(1, "X"), (2, "Y"), (4, "Q"), (None, "N"), (5, "V"), (5, "U")], "k int, b string")
    got = {(r.k, r.status, r.n_left, r.n_right): (r.left and r.left.a, r.right and r.right.b) for r in strict.one_to_one(a, b, ["k"]).collect()}
    assert got == {(1, "matched", 1, 1): ("x", "X"), (2, "repeated", 2, 1): (None, None), (3, "missing_right", 1, 0): (None, None), (4, "missing_left", 0, 1): (None, None),
                   (5, "repeated", 1, 2): (None, None), (None, "no_key", 1, 0): (None, None), (None, "no_key", 0, 1): (None, None)}
    assert strict.whole(strict.one_to_one(a, b, ["k"])).count() == 0 and strict.whole(strict.one_to_one(a.where("k = 1"), b.where("k = 1"), ["k"])).count() == 1
    plan = strict.accounted(strict.one_to_one(a, b, ["k"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one of the keys, one of the four statuses


def test_hash_trees(spark):
    from siltstone.sources import files

    one = spark.createDataFrame([(f"f{i}", f"h{i}") for i in range(300)], "path string, sha256 string")
    two = one.where("path <> 'f7'").withColumn("sha256", F.when(F.col("path") == "f9", "other").otherwise(F.col("sha256"))).union(spark.createDataFrame([("g", "h")], one.schema))
    root = lambda df: files.tree_roots(df.withColumn("tree", F.lit(1))).first().root
    assert root(one) == root(one.repartition(7)) != root(two)
    assert {tuple(r) for r in files.tree_changes(one, two).collect()} == {("f7", "removed"), ("f9", "changed"), ("g", "added")} and files.tree_changes(one, one).count() == 0


def test_point_reads_open_one_bucket(spark, tmp_path):
    from siltstone.plans.points import ChunkTable

    rows = spark.range(4000).select(
        (F.col("id") % 200).alias("document_id"), F.lit(1).cast("long").alias("version"), F.concat(F.lit("p"), (F.floor(F.col("id") / 200) % 4).cast("string")).alias("parent_id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("chunk_id"),
        F.floor(F.col("id") / 200).cast("int").alias("chunk_index"), F.lit("ready").alias("status"), (F.col("id") % 200 != 3).alias("is_current"))
    t = ChunkTable(spark, "points_test", f"file://{tmp_path}/t", 8)
    t.write(rows)
    assert [r.chunk_index for r in t.children(5, 1, "p1").collect()] == [1, 5, 9, 13, 17]
    assert t.get(5, 1, "c205").count() == 1 and t.get(5, 1, "c206").count() == 0
    parts = lambda df: df._jdf.queryExecution().toRdd().getNumPartitions()
    assert parts(t.get(5, 1, "c205")) == 1 == parts(t.rows().where("document_id = 5 and parent_id = 'p1'")) < parts(t.rows())  # of eight files one is opened
    assert t.current(3).count() == 0 and [(r.document_id, r.chunk_index) for r in t.current().limit(2).collect()] == [(0, 0), (0, 1)]
    wants = rows.where("document_id % 50 = 0").select("document_id", "version", "parent_id")
    got = t.of(wants)
    assert got.count() == 80 and {r.nth for r in got.collect()} == {1, 2, 3, 4, 5}
    t.drop()


def test_confusion_counts_graph_rows(spark):
    from siltstone.operators import evaluation

    rows = [("a", "graph_rag", 1, ["predicate_mismatch", "direction_reversed"]), ("b", "graph_rag", 2, ["predicate_mismatch"]), ("c", "graph_rag", 0, ["predicate_mismatch"]), ("d", "vector_only", 1, ["predicate_mismatch"])]
    got = evaluation.confusion(spark.createDataFrame(rows, "query_id string, mode string, n_expected int, failures array<string>"))
    assert {tuple(r) for r in got.collect()} == {("expected_predicate_vs_observed_same_endpoint", 2), ("same_predicate_endpoint_direction_reversed", 1)}


def test_paths_of_many_pairs_through_one_hub(spark):
    """Two sources beside a hub, 20,000 targets two steps behind it: the hub's edges are followed for each source, not for each pair."""
    import threading

    n = 20_000
    name = lambda letter, c="id": F.concat(F.lit(letter), F.col(c).cast("string"))
    hub = spark.range(n).select(name("h").alias("edge_id"), name("c").alias("subject"), F.lit("hub").alias("object"))
    leaf = spark.range(n).select(name("l").alias("edge_id"), name("o").alias("subject"), name("c").alias("object"))
    far = spark.createDataFrame([("a", "s1", "hub"), ("b", "s2", "hub")], "edge_id string, subject string, object string")
    pairs = spark.range(n).select(F.concat(F.lit("s"), (1 + F.col("id") % 2).cast("string")).alias("source"), name("o").alias("target"))
    clock = threading.Timer(150, spark.sparkContext.cancelAllJobs)
    clock.start()
    try:
        got = graph.shortest_paths(hub.unionByName(leaf).unionByName(far), pairs, 5, 3).collect()
    finally:
        clock.cancel()
    assert {(r.source, r.target, r.length, tuple(r.edge_ids)) for r in got} == {(f"s{1 + i % 2}", f"o{i}", 3, ("ab"[i % 2], f"h{i}", f"l{i}")) for i in range(n)} and len(got) == n
    assert graph.shortest_paths(far, pairs.limit(0), 5, 3).count() == 0


def test_entity_search_asks_each_word_once(spark, monkeypatch):
    """Against brute force, with queries of several words, repeated names and one without; a word that many queries ask is searched once."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = [(word(rng.randrange(1, 9)), rng.choice([None, word(3)])) for _ in range(60)] + [(None, "abc")]
    words = [(f"q{i}", word(rng.randrange(1, 4))) for i in range(300)] + [(f"q{i}", word(2)) for i in range(20)] + [("q400", None), ("q401", "")]
    asked, whole = [], graph.containing
    monkeypatch.setattr(graph, "containing", lambda texts, needles, *a: asked.append(needles.count()) or whole(texts, needles, *a))
    got = graph.search_entities(spark.createDataFrame(names, "name string, description string"), spark.createDataFrame(words, "query_id string, word string"), 5).collect()
    want = set()
    for q in {q for q, _ in words}:
        hit = {n for n, t in names for x, w in words if x == q and w and (w in (n or "") or w in (t or ""))}
        want |= {(q, n, i) for i, n in enumerate(sorted(hit, key=lambda n: (n is None, n or "")), 1) if i <= 5}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert asked == [len({w for _, w in words if w})]


def test_containing_with_many_strings(spark, monkeypatch):
    """Too many strings to be broadcast, and more of them than text: those that no text can hold go first; also many texts with as many strings."""
    monkeypatch.setattr(contain, "BEST_ROWS", 3)
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé\\n") for _ in range(n))
    for n_texts, n_needles in ((6, 200), (80, 30)):
        texts = [(i % 50, word(rng.randrange(0, 40))) for i in range(n_texts)] + [(99, None)]
        needles = [(i, word(rng.randrange(0, 12))) for i in range(n_needles)] + [(400 + i, texts[i % n_texts][1][2:20]) for i in range(6)]
        staged, rows = contain.staged, {}
        monkeypatch.setattr(contain, "staged", lambda df, name: (lambda x: rows.setdefault(name, []).append(x.count()) or x)(staged(df, name)))  # noqa: B023
        got = contain.containing(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(needles, "needle_id long, needle string")).collect()
        monkeypatch.setattr(contain, "staged", staged)
        want = {(i, j) for i, t in texts for j, n in needles if t is not None and n and n in t}
        assert {(r.id, r.needle_id) for r in got} == want and len(got) == len(want)
        assert n_texts > n_needles or rows["asked"][1] < rows["asked"][0] / 2
