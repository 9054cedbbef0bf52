"""Evaluation as aggregates: retrieval metrics, percentiles, scorers, relation fidelity, loss diagnosis, paired arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged

GRAPH_MODES = ("graph_only", "vector_graph", "bm25_graph", "hybrid", "graph_rag")
#: Phrases by which an answer abstains or denies.
ABSTAINS = ("无法回答", "无法确定", "信息不足", "未提供", "未找到", "没有相关")
ABSTAINS_2 = (*ABSTAINS, "未提及", "未找到相关", "没有相关信息")
DENIES = ("否", "不负责", "并非", "不是负责人", "没有负责", "并不负责", "无法得出")


def ir_metrics(ranked: DataFrame, relevant: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10), dedupe: bool = True, bounded: bool = True, available: int | None = None) -> DataFrame:
    """(query_id, recall_at_k ..., mrr, ndcg_at_10). ranked: query_id, item, rank; relevant: query_id, item.

    With dedupe an item counts at its first rank and ranks close up; without, repeats count, so that recall may exceed 1.
    bounded limits the reciprocal rank to the first ten. Queries without relevant items, and cutoffs over `available`, are null."""
    top = max(*cutoffs, 10)
    r = ranked.select("query_id", "item", "rank")
    if dedupe:
        r = r.groupBy("query_id", "item").agg(F.min("rank").alias("rank"))
    r = r.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "item")))
    rel = relevant.select("query_id", "item").distinct()
    size = rel.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    kept = r.where(F.col("pos") <= top) if bounded else r
    hit = kept.join(rel, ["query_id", "item"])
    got = hit.groupBy("query_id").agg(
        *[F.count(F.when(F.col("pos") <= k, 1)).alias(f"h{k}") for k in cutoffs],
        F.min(F.when(F.col("pos") <= 10, F.col("pos")) if bounded else F.col("pos")).alias("first"),
        F.sum(F.when(F.col("pos") <= 10, 1 / F.log2(F.col("pos") + 1))).alias("dcg"),
    )
    all_q = ranked.select("query_id").union(relevant.select("query_id")).distinct()
    both = all_q.join(size, "query_id", "left").join(got, "query_id", "left")
    n = F.col("n_relevant")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(10))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    na = lambda k, c: F.lit(None).cast("double") if available is not None and available < k else F.when(n.isNotNull(), F.round(c, 6))
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return both.select(
        "query_id", *[na(k, zero(f"h{k}") / n).alias(f"recall_at_{k}") for k in cutoffs],
        na(10, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), na(10, F.coalesce(zero("dcg") / F.when(n > 0, ideal), F.lit(0.0))).alias("ndcg_at_10"),
    )


def hit_at(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, hit): whether a relevant item is among the first k."""
    hit = ranked.where(F.col("rank") <= k).join(relevant.distinct(), ["query_id", "item"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(True))
    return ranked.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def percentile_linear(c: Column, p: float) -> Column:
    return F.percentile(c, p)


def percentile_nearest(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def mode_summary(results: DataFrame) -> DataFrame:
    """Per mode: rows, success and zero-result rates, mean metric, latency percentiles."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return results.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), rate("success").alias("success_rate"), rate("zero_result").alias("zero_result_rate"), F.avg("metric").alias("mean_metric"),
        percentile_linear(F.col("latency_ms"), 0.5).alias("p50"), percentile_linear(F.col("latency_ms"), 0.95).alias("p95"),
    )


def category_summary(results: DataFrame, least: int = 30) -> DataFrame:
    """Overall and by category in one pass; groups under `least` rows are marked small."""
    got = results.groupingSets([["mode"], ["mode", "category"]], "mode", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean_metric"))
    return got.select("mode", F.coalesce("category", F.lit("overall")).alias("category"), "n", "mean_metric", (F.col("n") < least).alias("small_sample"))


def source_coverage(found: Column, expected: Column) -> Column:
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(found, expected)) / F.size(F.array_distinct(expected))).otherwise(F.lit(1.0))


def _holds(answer: Column, words: Column) -> Column:
    return F.filter(words, lambda w: F.contains(F.lower(answer), F.lower(w)))


def _any(answer: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(answer, F.lit(m))
    return out


def score_answers(rows: DataFrame) -> DataFrame:
    """First scorer. rows: answer, sources, required_keywords, forbidden_keywords, expected_sources (arrays), requires_abstention, mode, graph_context_count."""
    hits = F.size(_holds(F.col("answer"), F.col("required_keywords")))
    total = F.size("required_keywords")
    facts = (hits == total) & (F.size(_holds(F.col("answer"), F.col("forbidden_keywords"))) == 0)
    source = F.when(F.col("requires_abstention"), F.size("sources") == 0).otherwise(F.size(F.array_except("expected_sources", "sources")) == 0)
    graph = (F.col("mode") != "graph_rag") | F.col("requires_abstention") | (F.col("graph_context_count") > 0)
    abstains = _any(F.col("answer"), ABSTAINS)
    return rows.withColumns({
        "keyword_fact_score": F.when(total > 0, F.round(hits / total, 3)).otherwise(F.lit(1.0)), "source_hit": source,
        "abstention_correct": F.when(F.col("requires_abstention"), abstains), "graph_participation_pass": graph,
        "question_correct": F.when(F.col("requires_abstention"), abstains & source & graph).otherwise(facts & source & graph),
    })


def score_answers_2(rows: DataFrame) -> DataFrame:
    """Second scorer: meaning apart from sources; also needs negation_target_terms and positive_claim_patterns (arrays)."""
    a = F.col("answer")
    claims = F.exists("positive_claim_patterns", lambda p: F.regexp_like(a, F.concat(F.lit("(?i)"), p)))
    abstains = (_any(a, ABSTAINS_2) | F.exists("required_keywords", lambda w: F.contains(a, w))) & ~claims
    denies = _any(a, DENIES) & F.forall("negation_target_terms", lambda w: F.contains(a, w)) & ~claims
    total, hits = F.size("required_keywords"), F.size(_holds(a, F.col("required_keywords")))
    plain = F.when(F.size(_holds(a, F.col("forbidden_keywords"))) > 0, F.lit(0.0)).when(total > 0, F.round(hits / total, 3)).otherwise(F.lit(1.0))
    meaning = F.when(F.col("requires_abstention"), abstains.cast("double")).when(F.size("negation_target_terms") > 0, denies.cast("double")).otherwise(plain)
    rule = F.when(F.col("requires_abstention"), F.when(claims, "invented_target_fact").when(abstains, "abstention_marker").otherwise("missing_abstention_marker")).when(
        F.size("negation_target_terms") > 0, F.when(denies, "negation_supported").otherwise("negation_not_established")).otherwise("keyword_rules")
    cover = F.when(F.col("requires_abstention"), F.lit(1.0)).otherwise(F.round(source_coverage(F.col("sources"), F.col("expected_sources")), 3))
    return rows.withColumns({"answer_semantic_score": meaning, "source_coverage_score": cover, "answer_rule": rule, "question_correct_v2": meaning == 1.0})


EDGE = ["subject", "predicate", "object", "direction"]


def relation_fidelity(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(query_id, n_expected, n_matched, fidelity, complete): exact directed recall of expected edges."""
    e, o = expected.select("query_id", *EDGE).distinct(), observed.select("query_id", *EDGE).distinct()
    hit = e.join(o.withColumn("hit", F.lit(1)), ["query_id", *EDGE], "left")
    got = hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.count("hit").alias("n_matched"))
    return got.withColumn("fidelity", F.round(F.col("n_matched") / F.col("n_expected"), 3)).withColumn("complete", F.col("n_matched") == F.col("n_expected"))


def graph_metrics(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(query_id, edge_recall, direction_fidelity, predicate_fidelity, provenance_coverage) of observed edges with document_id and source."""
    e, o = expected.select("query_id", *EDGE).distinct(), observed.select("query_id", *EDGE).distinct()
    ends = e.select("query_id", "subject", "object").distinct().withColumn("ends", F.lit(1))
    named = e.select("query_id", "subject", "predicate", "object").distinct().withColumn("named", F.lit(1))
    full = e.withColumn("full", F.lit(1))
    marked = o.join(ends, ["query_id", "subject", "object"], "left").join(named, ["query_id", "subject", "predicate", "object"], "left").join(full, ["query_id", *EDGE], "left")
    per = marked.groupBy("query_id").agg(F.count("ends").alias("n_ends"), F.count("named").alias("n_named"), F.count("full").alias("n_full"))
    size = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"))
    complete = (F.coalesce(F.col("document_id").cast("string"), F.lit("")) != "") & (F.coalesce("source", F.lit("")) != "")
    prov = observed.groupBy("query_id").agg(F.avg(complete.cast("double")).alias("provenance_coverage"))
    both = size.join(per, "query_id", "left").join(prov, "query_id", "left")
    share = lambda c: F.when(F.col("n_ends") > 0, F.round(F.col(c) / F.col("n_ends"), 6)).otherwise(F.lit(0.0))
    return both.select("query_id", F.round(F.coalesce("n_full", F.lit(0)) / F.col("n_expected"), 6).alias("edge_recall"), share("n_full").alias("direction_fidelity"), share("n_named").alias("predicate_fidelity"), F.round(F.coalesce("provenance_coverage", F.lit(0.0)), 6).alias("provenance_coverage"))


def predicate_conflicts(edges: DataFrame) -> DataFrame:
    """(subject, object, direction, predicates): ordered pairs that carry more than one predicate."""
    got = edges.groupBy("subject", "object", "direction").agg(F.array_sort(F.collect_set("predicate")).alias("predicates"))
    return got.where(F.size("predicates") > 1)


#: Stages of a trace in order.
STAGES = ("extracted", "normalized", "persisted", "retrieved_raw", "scope_accepted", "relevance_scored", "ranked", "entered_final_top_k", "entered_prompt")
#: What is lost where a stage no longer has an edge that the one before had.
LOSSES = dict(zip(STAGES, ("extraction_missing", "normalization_changed", "persistence_missing", "retrieval_missing", "scope_filtered", "relevance_filtered", "relevance_filtered", "top_k_truncated", "top_k_truncated"), strict=True))


def first_loss(expected: DataFrame, observed: DataFrame, present: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(query_id, edge, first_loss, n_stages) per expected edge. observed: query_id, stage, edge; present: query_id, stage, the
    stages with a snapshot. A missing snapshot before the loss means insufficient_evidence, never a loss; so does a loss
    at the scope without a record (query_id, edge) in `rejected`."""
    seen = expected.join(observed.select("query_id", "edge", "stage").distinct(), ["query_id", "edge"], "left")
    wide = seen.groupBy("query_id", "edge").agg(*[F.max(F.col("stage") == s).alias(f"s_{s}") for s in STAGES], F.count("stage").cast("long").alias("n_stages"))
    have = present.groupBy("query_id").agg(*[F.max(F.col("stage") == s).alias(f"p_{s}") for s in STAGES])
    both = wide.join(have, "query_id", "left")
    if rejected is not None:
        both = both.join(rejected.select("query_id", "edge").distinct().withColumn("refused", F.lit(True)), ["query_id", "edge"], "left")
    out = None
    for s in STAGES:
        gone, missing = ~F.coalesce(F.col(f"s_{s}"), F.lit(False)), ~F.coalesce(F.col(f"p_{s}"), F.lit(False))
        loss = F.lit(LOSSES[s])
        if s == "scope_accepted" and rejected is not None:
            loss = F.when(F.col("refused"), loss).otherwise(F.lit("insufficient_evidence"))
        out = F.when(missing, F.lit("insufficient_evidence")) if out is None else out.when(missing, F.lit("insufficient_evidence"))
        out = out.when(gone, loss)
    return both.select("query_id", "edge", out.otherwise(F.lit("prompt_present")).alias("first_loss"), "n_stages")


def loss_counts(diagnosed: DataFrame) -> DataFrame:
    return diagnosed.groupBy("first_loss").agg(F.count(F.lit(1)).alias("n"))


def _edge_counts(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per query, counts of distinct edges: n_expected and n_observed; of expected ones those that are observed (n_same: nulls equal; n_exact: without
    nulls) and those with an observed edge of the same ends (n_ends), ends and predicate (n_named), or predicate but not ends (n_pred_only); and
    observed ones that share no end with an expected one (n_far). Edges are grouped and summed, never compared pair by pair."""
    side = lambda df, e, o: df.select("query_id", *EDGE, F.lit(e).alias("e"), F.lit(o).alias("o"))
    edges = side(expected, 1, 0).unionByName(side(observed, 0, 1)).where("query_id is not null").groupBy("query_id", *EDGE).agg(F.max("e").alias("e"), F.max("o").alias("o"))
    sums = lambda *names: [F.sum(c).alias(c) for c in names]
    both = F.col("e") * F.col("o")
    known = F.when(_all(*[F.col(c).isNotNull() for c in EDGE]), both).otherwise(0)
    named = edges.groupBy("query_id", *EDGE[:3]).agg(F.sum("e").alias("n_expected"), F.sum("o").alias("n_observed"), F.sum(both).alias("n_same"), F.sum(known).alias("n_exact"))
    named = staged(named, "edges")
    ends = _all(*[F.col(c).isNotNull() for c in ("subject", "object")])
    seen = F.max("n_observed").over(Window.partitionBy("query_id", "subject", "object")) > 0
    hit = named.withColumn("n_ends", F.when(ends & seen, F.col("n_expected")).otherwise(0))
    hit = hit.withColumn("n_named", F.when(ends & F.col("predicate").isNotNull() & (F.col("n_observed") > 0), F.col("n_expected")).otherwise(0))
    counts = ("n_expected", "n_observed", "n_same", "n_exact", "n_ends", "n_named")
    by = hit.groupBy("query_id", "predicate").agg(*sums(*counts))
    only = F.when(F.col("predicate").isNotNull() & (F.col("n_observed") > 0), F.col("n_expected") - F.col("n_ends")).otherwise(0)
    per = by.withColumn("n_pred_only", only).groupBy("query_id").agg(*sums(*counts, "n_pred_only"))
    # an observed edge is far if no expected edge has its subject, nor, among the rest, its object
    subjects = named.where("n_expected > 0").select("query_id", "subject").distinct()
    rest = named.where("n_observed > 0").join(subjects, ["query_id", "subject"], "left_anti").select("query_id", "object", F.lit(0).cast("long").alias("n_expected"), "n_observed")
    far = rest.unionByName(named.where("n_expected > 0").select("query_id", "object", "n_expected", F.lit(0).cast("long").alias("n_observed"))).groupBy("query_id", "object").agg(*sums("n_expected", "n_observed"))
    far = far.where("n_expected = 0 or object is null").groupBy("query_id").agg(F.sum("n_observed").alias("n_far"))
    return per.join(far, "query_id", "left").na.fill(0, ["n_far"])


def diagnose(expected: DataFrame, observed: DataFrame, rows: DataFrame) -> DataFrame:
    """Failure categories per result row. rows: query_id, mode, graph_called, answer_correct, forbidden, requires_abstention,
    abstention_correct, source_coverage, question_correct."""
    counts = _edge_counts(expected, observed)
    both = rows.join(counts, "query_id", "left").na.fill(0, counts.columns[1:])
    n = lambda c: F.col(f"n_{c}")
    graph, some, path = F.col("mode") == "graph_rag", n("expected") > 0, (F.col("mode") == "graph_rag") & (n("expected") > 0)
    # the names of the categories are fixed values
    rules = {
        "scorer_not_applicable": ~graph | ~some, "no_expected_relation": graph & ~some, "graph_not_called": path & ~F.col("graph_called"),
        "no_graph_evidence": path & F.col("graph_called") & (n("observed") == 0), "expected_edge_missing_from_prompt": path & (n("same") < n("expected")), "insufficient_evidence": path & (n("same") < n("expected")),
        "predicate_mismatch": path & (n("named") < n("ends")), "direction_reversed": path & (n("exact") < n("named")), "subject_object_mismatch": path & (n("pred_only") > 0),
        "incomplete_multi_hop_path": path & (n("expected") > 1) & (n("exact") < n("expected")), "irrelevant_graph_evidence": path & (n("far") > 0), "graph_top_k_dilution": path & (n("observed") > 0) & (n("far") == n("observed")),
        "correct_evidence_but_wrong_answer": path & (n("exact") == n("expected")) & ~F.col("answer_correct"), "forbidden_fact_generated": F.col("forbidden"),
        "abstention_error": F.col("requires_abstention") & ~F.coalesce("abstention_correct", F.lit(False)), "source_coverage_error": ~F.col("requires_abstention") & (F.col("source_coverage") < 1.0),
        "scorer_false_negative": F.col("answer_correct") & ~F.col("question_correct"),
    }
    found = F.array_sort(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))
    return both.select("query_id", "mode", *[n(c).cast("int").alias(f"n_{c}") for c in ("expected", "observed", "exact")], found.alias("failures"))


#: What a failure of a graph row says about predicates and ends.
CONFUSION = {
    "predicate_mismatch": "expected_predicate_vs_observed_same_endpoint",
    "direction_reversed": "same_predicate_endpoint_direction_reversed",
    "subject_object_mismatch": "same_predicate_subject_object_mismatch",
}


def confusion(diagnosed: DataFrame) -> DataFrame:
    """(confusion, count) over graph rows that expect edges: one for each row and failure."""
    named = F.create_map(*[F.lit(x) for kv in CONFUSION.items() for x in kv])
    rows = diagnosed.where("mode = 'graph_rag' and n_expected > 0").select(F.explode("failures").alias("failure")).select(named[F.col("failure")].alias("confusion")).where("confusion is not null")
    return rows.groupBy("confusion").agg(F.count(F.lit(1)).alias("count"))


def _all(*terms: Column) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out & t
    return out


def failure_matrix(diagnosed: DataFrame, grid: DataFrame) -> DataFrame:
    """(mode, category, failure, n) over the whole grid of (mode, category): cells without rows are 0."""
    got = diagnosed.select("mode", "category", F.explode_outer("failures").alias("failure")).groupBy("mode", "category", "failure").agg(F.count("failure").alias("n"))
    return grid.join(got, ["mode", "category"], "left").na.fill(0, ["n"])


def extraction_gap(target: DataFrame, extracted: DataFrame) -> DataFrame:
    """(query_id, gap): why a target edge is not among the extracted ones. Both: query_id, subject, predicate, object."""
    from ..functions.text import alias_match

    t = target.select("query_id", *[F.col(c).alias(f"t_{c}") for c in EDGE[:3]])
    both = t.join(extracted.select("query_id", *EDGE[:3]), "query_id", "left")
    same = (F.col("subject") == F.col("t_subject")) & (F.col("object") == F.col("t_object"))
    back = (F.col("subject") == F.col("t_object")) & (F.col("object") == F.col("t_subject"))
    alias = alias_match(F.col("subject"), F.col("t_subject")) & alias_match(F.col("object"), F.col("t_object"))
    named = F.col("predicate") == F.col("t_predicate")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    got = both.groupBy("query_id", "t_subject", "t_predicate", "t_object").agg(some(same & named).alias("exact"), some(back & named).alias("back"), some(alias & ~named).alias("other"), some(alias & named).alias("alias"))
    gap = F.when(F.col("exact"), "extracted").when(F.col("back"), "direction_reversed").when(F.col("other"), "canonicalization_gap").when(F.col("alias"), "endpoint_alias_mismatch").otherwise("no_relation_extracted")
    return got.select("query_id", F.col("t_subject").alias("subject"), F.col("t_predicate").alias("predicate"), F.col("t_object").alias("object"), gap.alias("gap"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, top1_changed, top_changed, mean_rank_delta) of two rankings (query_id, item, rank) of the same pool."""
    both = a.select("query_id", "item", F.col("rank").alias("ra")).join(b.select("query_id", "item", F.col("rank").alias("rb")), ["query_id", "item"])
    return both.groupBy("query_id").agg(
        (F.min_by("item", "ra") != F.min_by("item", "rb")).alias("top1_changed"), F.bool_or((F.col("ra") <= 8) != (F.col("rb") <= 8)).alias("top_changed"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("mean_rank_delta"),
    )


def flips(before: DataFrame, after: DataFrame) -> DataFrame:
    """(query_id, outcome): improvement or regression where `hit` changed between two runs."""
    both = before.select("query_id", F.col("hit").alias("was")).join(after.select("query_id", F.col("hit").alias("now")), "query_id")
    return both.where("was <> now").select("query_id", F.when(F.col("now"), "improvement").otherwise("regression").alias("outcome"))


def set_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has; empty means that both hold the same set."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def same_results(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys whose value differs between runs: none if results are deterministic."""
    return runs.groupBy(*keys).agg(F.countDistinct(value).alias("n")).where("n > 1")


def forbidden_calls(audit: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls (variant, component, n) that a variant must not make: rules (variant, component)."""
    return audit.where("n > 0").join(F.broadcast(rules.distinct()), ["variant", "component"], "left_semi")


def merged_traces(traces: DataFrame) -> DataFrame:
    """(stage, fingerprint, sources): the sources of an edge over all of its records."""
    return traces.groupBy("stage", "fingerprint").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def clipped(rows: DataFrame, most: int = 50) -> DataFrame:
    """Per stage the first `most` candidates and whether there were more."""
    w = Window.partitionBy("stage")
    df = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy("rank", "candidate_id")))
    return df.where(F.col("pos") <= most).withColumn("truncated", F.col("n") > most).drop("n")


def rescore_summary(rows: DataFrame) -> DataFrame:
    """Per mode: accuracy by either scorer and how many answers change. rows: mode, question_correct, question_correct_v2."""
    yes = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n"), yes("question_correct").alias("accuracy_v1"), yes("question_correct_v2").alias("accuracy_v2"),
        F.count(F.when(~F.col("question_correct") & F.col("question_correct_v2"), 1)).alias("now_correct"), F.count(F.when(F.col("question_correct") & ~F.col("question_correct_v2"), 1)).alias("now_wrong"),
    )


#: Failure categories by priority of what to repair first.
PRIORITIES = ("scorer_not_applicable", "irrelevant_graph_evidence", "predicate_mismatch", "incomplete_multi_hop_path", "correct_evidence_but_wrong_answer", "forbidden_fact_generated", "insufficient_evidence")


def priorities(diagnosed: DataFrame) -> DataFrame:
    """(priority, failure, n) of the categories that occur; no-path rows of other modes than graph_rag aren't defects."""
    f = diagnosed.select("mode", "query_id", F.explode("failures").alias("failure")).where((F.col("failure") != PRIORITIES[0]) | (F.col("mode") == "graph_rag"))
    order = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("failure"))
    return f.withColumn("priority", order - 1).where("priority >= 0").groupBy("priority", "failure").agg(F.count(F.lit(1)).alias("n"))


def micro_summary(diagnosed: DataFrame) -> DataFrame:
    """One row: edges expected and found over all questions with a path, and their ratio."""
    g = diagnosed.where("mode = 'graph_rag' and n_expected > 0")
    return g.agg(F.count(F.lit(1)).alias("questions"), F.sum("n_expected").alias("expected"), F.sum("n_exact").alias("exact")).withColumn("edge_recall", F.round(F.col("exact") / F.col("expected"), 3))


def invalid_arms(arms: DataFrame, pool: int = 20) -> DataFrame:
    """(query_id, reason) of paired arms that can't be compared. arms: query_id, arm, item, pre_rank, score."""
    finite = F.col("score").isNotNull() & ~F.isnan("score")
    per = arms.groupBy("query_id", "arm").agg(F.count(F.lit(1)).alias("n"), F.bool_and(finite).alias("finite"), F.xxhash64(F.array_sort(F.collect_list(F.struct("pre_rank", "item")))).alias("same"))
    got = per.groupBy("query_id").agg(F.count(F.lit(1)).alias("arms"), F.max("n").alias("n"), F.bool_and("finite").alias("finite"), F.countDistinct("same").alias("kinds"))
    reason = F.when(F.col("arms") != 2, "missing_arm").when(F.col("n") > pool, "pool_size").when(~F.col("finite"), "score").when(F.col("kinds") > 1, "pre_ranks")
    return got.withColumn("reason", reason).where("reason is not null").select("query_id", "reason")


def table_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: a hash of a table's rows whatever their order, to see that frozen inputs are the same."""
    row = F.sha2(F.to_json(F.struct(*keys)), 256)
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substr("h", F.lit(1), F.lit(12)), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest"))


def fresh(entries: DataFrame, now, seconds: int = 1800, most: int = 500) -> DataFrame:
    """What a cache with a lifetime and a size still holds. entries: key, stored_at."""
    live = entries.where(F.col("stored_at") > now - F.make_dt_interval(secs=F.lit(seconds)))
    return live.orderBy(F.col("stored_at").desc(), "key").limit(most)
