"""Evidence graphs as edge tables: canonical predicates, deduplication, neighbourhoods, paths, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_key
from ..storage import staged
from .contain import containing
from .retrieval import SMALL_ROWS, small

RELATED = "RELATED_TO"
#: Reviewed spellings and what each means.
ALIASES = {
    "provides index": "PROVIDES_INDEX",
    "provides index to": "PROVIDES_INDEX",
    "提供索引": "PROVIDES_INDEX",
    "提供检索索引": "PROVIDES_INDEX",
    "为其提供检索索引": "PROVIDES_INDEX",
    "为天枢提供检索索引": "PROVIDES_INDEX",
    "depends on": "DEPENDS_ON",
    "依赖": "DEPENDS_ON",
    "依赖于": "DEPENDS_ON",
    "not depends on": "NOT_DEPENDS_ON",
    "不依赖": "NOT_DEPENDS_ON",
    "不依赖于": "NOT_DEPENDS_ON",
    "并不依赖": "NOT_DEPENDS_ON",
    "未依赖": "NOT_DEPENDS_ON",
    "monitors": "MONITORS",
    "监控": "MONITORS",
    "监测": "MONITORS",
    "负责监控": "MONITORS",
    "responsible for": "RESPONSIBLE_FOR",
    "负责": "RESPONSIBLE_FOR",
    "共同负责": "CO_RESPONSIBLE_FOR",
    "co responsible for": "CO_RESPONSIBLE_FOR",
    "works at": "WORKS_AT",
    "任职于": "WORKS_AT",
    "隶属": "MEMBER_OF",
    "belongs to": "MEMBER_OF",
    "member of": "MEMBER_OF",
    "uses": "USES",
    "使用": "USES",
    "共同交付": "CO_DELIVERS",
    "co delivers": "CO_DELIVERS",
    "related to": "RELATED_TO",
    "相关": "RELATED_TO",
    "owns": "OWNS",
    "拥有": "OWNS",
    "developed by": "DEVELOPED_BY",
    "part of": "PART_OF",
    "located in": "LOCATED_IN",
}
#: Predicates that have no other spelling than their own name.
NAMED = (
    "AFFECTED", "AUTHENTICATES_VIA", "CALLS", "CO_LEADS", "CURRENTLY_USES", "DISTINCT_FROM", "EVALUATES", "HAS_ROLE", "HEAD_OF", "NOT_DIRECTLY_CALLS",
    "NOT_RESPONSIBLE_FOR", "NOT_USES", "NOT_YET_MIGRATED_TO", "PROVIDES_AUTH_TO", "PROVIDES_DATA_TO",
)
PREDICATES = (*dict.fromkeys(ALIASES.values()), *NAMED)
#: Raw labels that are read anew where the stored predicate is the unspecific one.
REINTERPRETED = {"监控": "MONITORS", "监测": "MONITORS", "负责监控": "MONITORS", "不依赖": "NOT_DEPENDS_ON", "并不依赖": "NOT_DEPENDS_ON", "未依赖": "NOT_DEPENDS_ON"}


def alias_key(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "_-", "  "), r"\s+", " ")


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, predicate): under a hundred rows."""
    rows = {*ALIASES.items(), *((p.lower().replace("_", " "), p) for p in PREDICATES)}
    return spark.createDataFrame(sorted(rows), "alias string, canonical string")


def canonical(df: DataFrame, predicate: str = "predicate", raw: str | None = None) -> DataFrame:
    """Adds canonical and raw_predicate (at most 160 characters). Unknown predicates become RELATED_TO; then a reviewed raw label decides."""
    own = F.regexp_replace(F.trim(F.coalesce(F.col(raw) if raw else F.col(predicate), F.lit(""))), r"\s+", " ")
    out = df.withColumn("_key", alias_key(F.col(predicate))).join(F.broadcast(alias_table(df.sparkSession)), F.col("_key") == F.col("alias"), "left").drop("_key", "alias")
    known = F.coalesce("canonical", F.lit(RELATED))
    if raw:
        again = F.create_map(*[F.lit(x) for kv in REINTERPRETED.items() for x in kv])[alias_key(own)]
        known = F.when(known == RELATED, F.coalesce(again, F.lit(RELATED))).otherwise(known)
    return out.withColumn("canonical", known).withColumn("raw_predicate", F.substr(own, F.lit(1), F.lit(160)))


def is_canonical(c: Column) -> Column:
    return c.isin(*PREDICATES)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by arrival."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def split_relations(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): relations with both ends among the entities' names, and the others."""
    names = entities.select("name").distinct()
    both = relations.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(names.withColumnRenamed("name", "tail"), "tail", "left_semi")
    lost = relations.join(names.withColumnRenamed("name", "head"), "head", "left_anti").unionByName(relations.join(names.withColumnRenamed("name", "head"), "head", "left_semi").join(names.withColumnRenamed("name", "tail"), "tail", "left_anti"))
    return both, lost


def mentions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, name): distinct names of a document's entities and ends of relations."""
    return entities.select("document_id", "name").union(relations.select("document_id", "head")).union(relations.select("document_id", "tail")).distinct()


def upserted(entities: DataFrame, order: str = "arrival") -> DataFrame:
    """One row per name: the first type; the last description that isn't empty."""
    said = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.struct(order, "description"))
    return entities.groupBy("name").agg(F.min(F.struct(order, "type")).alias("f"), F.max(said).alias("l")).select("name", F.col("f.type").alias("type"), F.col("l.description").alias("description"))


def evidence(relations: DataFrame) -> DataFrame:
    """Edges with evidence keys; variants of one identity collapse."""
    key = evidence_key(F.col("document_id"), F.col("document_version"), F.col("subject"), F.col("predicate"), F.col("object"))
    return relations.withColumn("evidence_key", key).dropDuplicates(["evidence_key"])


def usable(edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Edges that retrieval may follow: no mentions, and without a document or of a ready, current one; within the scope if there is one."""
    out = edges.where((F.col("predicate") != "MENTIONS") & (F.col("document_id").isNull() | ((F.col("status") == "ready") & F.col("is_current"))))
    return out if allowed is None else out.where(is_canonical(F.col("predicate"))).join(allowed.select(F.col("doc_id").alias("document_id")).distinct(), "document_id", "left_semi")


def paths(edges: DataFrame, starts: DataFrame, hops: int = 2, limit: int | None = 50) -> DataFrame:
    """(start, hops, node, edge_ids, directions): undirected paths of 1 to `hops` edges (1 to 5) from each start; an edge is used
    once per path, nodes may come again. Each step is a join of the frontier with the two-way edge table; with a limit,
    each start keeps its first paths by (hops, edge_ids). Shorter paths come first, so a start that has its paths goes no further, and
    one that goes on has fewer than `limit`: no frontier is larger. Without a limit all paths are made, however many."""
    hops = max(1, min(5, hops))
    e = edges.select(F.col("edge_id"), F.col("subject").alias("a"), F.col("object").alias("b"))
    both = e.withColumn("direction", F.lit("forward")).unionByName(e.select("edge_id", F.col("b").alias("a"), F.col("a").alias("b")).withColumn("direction", F.lit("reverse")))
    kind = edges.schema["edge_id"].dataType.simpleString()
    none = [F.array().cast(f"array<{kind}>").alias("edge_ids"), F.array().cast("array<string>").alias("directions")]
    frontier = starts.select(F.col("name").alias("start")).distinct().select("start", F.col("start").alias("node"), *none, F.lit(limit).cast("long").alias("room"))
    per, out = Window.partitionBy("start"), None
    for n in range(1, hops + 1):
        longer = [F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.concat("directions", F.array("direction")).alias("directions")]
        frontier = frontier.join(both, (frontier.node == both.a) & ~F.array_contains(frontier.edge_ids, both.edge_id)).select("start", F.col("b").alias("node"), *longer, "room")
        if limit is not None:
            # row_number first, so that each task keeps no more than a start can have
            frontier = frontier.withColumn("nth", F.row_number().over(per.orderBy("edge_ids", "directions"))).where(F.col("nth") <= limit)
            frontier = frontier.withColumn("found", F.max("nth").over(per))
            step = frontier.where(F.col("nth") <= F.col("room"))
            frontier = frontier.where(F.col("found") < F.col("room")).withColumn("room", F.col("room") - F.col("found")).drop("nth", "found")
        else:
            step = frontier
        step = step.select("start", F.lit(n).alias("hops"), "node", "edge_ids", "directions")
        out = step if out is None else out.unionByName(step)
    return out


class _Trails:
    """Trails (end, node, edge_ids) from ends, written, with their number."""

    def __init__(self, df: DataFrame, name: str):
        self.df, self.name = staged(df, name), name
        self.n = self.df.count()

    def hinted(self, df: DataFrame) -> DataFrame:
        """Marks df, which has no more rows than this, for broadcast if these are few."""
        return F.broadcast(df) if self.n <= SMALL_ROWS else df

    def onward(self, both: DataFrame) -> DataFrame:
        """By one more edge, at the head or, from targets, before the tail; an edge is used once."""
        ids = F.concat(F.array("edge_id"), "edge_ids") if self.name == "target" else F.concat("edge_ids", F.array("edge_id"))
        grown = both.join(self.hinted(self.df), (F.col("a") == F.col("node")) & ~F.array_contains("edge_ids", F.col("edge_id")))
        return grown.select("end", F.col("b").alias("node"), ids.alias("edge_ids"))

    def width(self, both: DataFrame) -> int:
        """How many trails one more edge makes."""
        nodes = self.df.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        return both.join(self.hinted(nodes), F.col("a") == F.col("node")).agg(F.sum("n")).first()[0] or 0


def _met(pairs: DataFrame, heads: _Trails, tails: _Trails) -> DataFrame:
    """(source, target, found, edge_ids) of pairs whose head and tail come to one node and share no edge."""
    got = pairs.join(tails.hinted(tails.df.select(F.col("end").alias("target"), "node", F.col("edge_ids").alias("tail"))), "target")
    got = got.join(heads.hinted(heads.df.select(F.col("end").alias("source"), "node", F.col("edge_ids").alias("head"))), ["source", "node"])
    return got.where(~F.arrays_overlap("head", "tail")).select("source", "target", "found", F.concat("head", "tail").alias("edge_ids"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, hops: int = 5, limit: int = 1) -> DataFrame:
    """(source, target, length, edge_ids): the `limit` (1 to 10) shortest paths of 1 to `hops` (1 to 5) undirected edges of each pair; ties by edge ids. An
    edge is used once per path, nodes may come again.

    Lengths are tried one after the other, and a pair that has its paths leaves. Heads grow from the distinct sources and tails from the distinct targets,
    not from each pair, and for each length the side that one more edge makes fewer trails of grows by it: a hub's edges are followed once for each source
    or target near it. Pairs then look for heads and tails that meet.

    Until a pair has a path, the paths of the length at hand are shortest ones, so a node counts at its least distance from either end only, and of the
    trails that come to it the first `limit` will do. A pair that has some paths and wants longer ones, one whose ends are equal, and any pair if an id is
    that of several edges, asks all trails. Each step is written, which cuts lineage."""
    limit, hops = max(1, min(10, limit)), max(1, min(5, hops))
    e = staged(edges.select("edge_id", F.col("subject").alias("a"), F.col("object").alias("b")).where("edge_id is not null and subject is not null and object is not null"), "steps")
    both = e.where("a <> b").select("edge_id", F.col("b").alias("a"), F.col("a").alias("b")).unionByName(e)
    ends = F.struct("a", "b")
    shared = e.groupBy("edge_id").agg(F.min(ends).alias("x"), F.max(ends).alias("y")).where("x <> y").limit(1).count() > 0
    wanted = pairs.select("source", "target").where("source is not null and target is not null").distinct()
    every = (F.col("source") == F.col("target")) | F.lit(shared)
    open_ = staged(wanted.select("source", "target", F.lit(0).cast("long").alias("found"), every.alias("every"), every.alias("new")), "open")
    kind = edges.schema["edge_id"].dataType.simpleString()
    start = lambda df, side: _Trails(df.select(F.col(side).alias("end"), F.col(side).alias("node"), F.array().cast(f"array<{kind}>").alias("edge_ids")).distinct(), side)
    sides, order, width, all_, out = ("source", "target"), [], {}, {}, None
    near = {side: [start(open_.where("not every"), side)] for side in sides}
    for length in range(1, hops + 1):
        n = open_.agg(F.count_if(~F.col("every")).alias("first"), F.count_if("every").alias("rest"), F.count_if("new").alias("new")).first()
        if length > 1 and not n.first + n.rest:
            break
        first, rest = open_.where("not every"), open_.where("every")
        if n.first:
            for side in sides:
                width[side] = width[side] if side in width else near[side][-1].width(both)
            side = min(sides, key=width.get)
            last, zero = near[side][-1], near[side][0]
            grown = last.onward(both).join(zero.hinted(first.select(F.col(side).alias("end")).distinct()), "end", "left_semi")
            for x in near[side][-2:]:
                grown = grown.join(x.hinted(x.df.select("end", "node").distinct()), ["end", "node"], "left_anti")
            nth = F.row_number().over(Window.partitionBy("end", "node").orderBy("edge_ids"))
            near[side].append(_Trails(grown.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth"), side))
            width.pop(side)
            order.append(side)
        met = _met(first, near["source"][-1], near["target"][-1])
        if n.rest:
            if n.new or not all_:  # else those of the length before hold all ends
                all_, done = {side: start(rest, side) for side in sides}, 0
            for k in range(done, length):
                if k == len(order):
                    order.append(min(sides, key=lambda x: all_[x].width(both)))  # noqa: B023
                all_[order[k]] = _Trails(all_[order[k]].onward(both), order[k])
            done = length
            met = met.unionByName(_met(rest, all_["source"], all_["target"]))
        w = Window.partitionBy("source", "target").orderBy("edge_ids")
        made = met.withColumn("nth", F.row_number().over(w)).where(F.col("nth") + F.col("found") <= limit)
        made = staged(made.select("source", "target", F.lit(length).alias("length"), "edge_ids"), "paths")
        out = made if out is None else out.unionByName(made)
        count = made.groupBy("source", "target").agg(F.count(F.lit(1)).alias("more"))
        now = F.col("found") + F.coalesce("more", F.lit(0))
        more = open_.join(count, ["source", "target"], "left").select("source", "target", now.alias("found"), (F.col("every") | (now > 0)).alias("every"), (~F.col("every") & (now > 0)).alias("new"))
        open_ = staged(more.where(F.col("found") < limit), "open")
    return out


def orphans(entities: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that no document mentions and no edge touches."""
    ends = edges.select(F.col("subject").alias("name")).union(edges.select(F.col("object").alias("name"))).distinct()
    return entities.join(mentions.select("name").distinct(), "name", "left_anti").join(ends, "name", "left_anti")


def legacy_deletes(entities: DataFrame, mentions: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Entities (name, source) of the given sources that maintenance may delete: no document mentions them and no edge touches them."""
    return orphans(entities.join(sources.select("source").distinct(), "source", "left_semi"), mentions, edges)


def search_entities(entities: DataFrame, words: DataFrame, limit: int = 20) -> DataFrame:
    """(query_id, name, rank): entities whose name or description holds the query's word; the first by name, without a name last. Each distinct word is
    searched once and keeps its first entities; queries take them from there."""
    held = entities.select("name", F.col("name").alias("text")).unionByName(entities.select("name", F.col("description").alias("text")))
    asked = words.where("word <> ''").select("query_id", "word").distinct()
    both = containing(held, asked.select("word", F.col("word").alias("needle")).distinct(), "name", "text", "word", "needle")
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.asc_nulls_last("name")))
    first = staged(both.withColumn("rank", nth("word")).where(F.col("rank") <= limit).select("word", "name", "rank"), "first")
    got = asked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).join(small(first), "word")
    mixed = got.where("n > 1").select("query_id", "name").distinct().withColumn("rank", nth("query_id")).where(F.col("rank") <= limit)
    return got.where("n = 1").select("query_id", "name", "rank").unionByName(mixed.select("query_id", "name", "rank"))


def link_entities(texts: DataFrame, names: DataFrame, id: str = "query_id", text: str = "query") -> DataFrame:
    """(id, name): a dictionary linker; a name is linked where its match key is a run of the text's words."""
    from ..functions.text import lexical_tokens

    keyed = names.select("name", F.array_join(lexical_tokens(F.col("name")), " ").alias("key")).where("key <> ''").withColumn("n", F.size(F.split("key", " ")))
    longest = keyed.agg(F.max("n")).first()[0] or 1
    t = texts.select(id, lexical_tokens(F.col(text)).alias("t"))
    runs = None
    for n in range(1, longest + 1):
        grams = F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, F.lit(n)), " "))  # noqa: B023
        part = t.where(F.size("t") >= n).select(id, F.explode(F.array_distinct(grams)).alias("key"))
        runs = part if runs is None else runs.unionByName(part)
    return runs.join(keyed.select("name", "key"), "key").select(id, "name").distinct()
