"""N-gram Jaccard join by a token-group matrix (operator 7).

Two documents link when the Jaccard similarity of their sets of distinct n-word shingles reaches a
threshold; the result gives each document the smallest id that links reach from it.

1. Every text becomes a sorted array of shingle hashes. Equal sets are one class from here on, so
   copies are never expanded.
2. Similar classes are brought together: within a band of set sizes at most D tokens can differ
   between linked sets, so of D + 1 parts of the token space at least one is the same in both; some more parts are made,
   so that empty ones, which very many sets share, need not count. Classes
   that share a part are tied to the smallest of them (a star, not all pairs); components of these ties
   are the groups outside of which no link can be.
3. Inside, members form rows of a token-group matrix: runs of 32 similar sets, each with the union of
   its tokens. A query's overlap with the union bounds its overlap with any member; only groups whose
   bound reaches what the threshold needs are opened and compared exactly. Members already in the
   query's component are skipped. Components of more than CHUNK classes are cut into chunks, and every
   pair of chunks is a task of its own, so no task holds an unbounded group.

Null or blank text: empty set, linked with nothing. Fewer than n words: the whole sequence is the one
shingle. Rows with a null id get a null component. Repeated rows each get their own result; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, as_bytes, blocks, discard, lists, lowered, mix, prefix_hash, release, signed, slice_hash, staged, words, workers
from .graph import components

CHUNK = 512
GROUP = 32
#: A table of at most so many rows of four longs is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 400_000
_A, _B, _C = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_hashes(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    low = lowered(buf)
    s, e, at = words(low, off)
    h = slice_hash(prefix_hash(low), s, e)
    rolled = np.zeros(len(h), np.uint64)
    for j in range(n):
        if len(h) > j:
            rolled[: len(h) - j] = mix(rolled[: len(h) - j] * _A + h[j:])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            got = np.sort(rolled[a : b - n + 1])
            out.append(got[np.concatenate(([True], got[1:] != got[:-1]))] if len(got) > 1 else got)
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for x in range(a, b):
                whole = mix(whole * _B + h[x : x + 1])
            out.append(whole)
        else:
            out.append(h[:0])
    return out


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least intersection of linked sets of sizes a and b: den * i >= num * (a + b - i)."""
    return -(-num * (a + b) // (num + den))


def bands(n: int, num: int, den: int) -> list[int]:
    """Lower limits of the size bands, up to the one after the band of n; linked sizes are in the same or adjacent bands."""
    low = [max(1, num // (den - num))]
    while low[-1] <= n or len(low) < 3:
        low.append(low[-1] * den // num + 1)
    return [*low, low[-1] * den // num + 1, (low[-1] * den // num + 1) * den // num + 1]


def signatures(tokens: np.ndarray, low: list[int], num: int, den: int) -> np.ndarray:
    """A hash of each part of the token space, for the band of the set's size and the band below.

    At most D tokens differ between linked sets, so of D + 1 + m parts at least m + 1 are the same in both. Parts without tokens are the same in
    very many sets and say nothing: a set with up to m of them leaves them out, as then one of those m + 1 has tokens. A set with more
    gives them all; so does any set that it agrees with in empty parts alone."""
    n = len(tokens)
    band = int(np.searchsorted(low, n, "right")) - 1
    out = []
    for i in (band, band - 1):
        if i < 0:
            continue
        differ = (low[i + 1] + low[i + 2] - 2) * (den - num) // (den + num)
        if differ:
            spare = 1 + differ // 16
            k = differ + 1 + spare
            part = (((tokens >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
            total = np.zeros(k, np.uint64)
            np.add.at(total, part, mix(tokens ^ _C))
            full = np.bincount(part, minlength=k) > 0
            if k - int(full.sum()) > spare:
                full[:] = True
            out.append(mix(total + np.arange(k, dtype=np.uint64) * _A + np.full(k, i + 1, np.uint64) * _B)[full])
    return np.concatenate(out) if out else tokens[:0]


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    one, two = mix(tokens + _A).sum(dtype=np.uint64), mix(tokens ^ _B).sum(dtype=np.uint64)
    return tuple(int(x) for x in signed(np.array([one, two])))


def _describe(n: int, num: int, den: int):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            for a, b in blocks(off):
                sets = shingle_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a], n)
                low = bands(max([1, *map(len, sets)]), num, den)
                both = [_set_hash(x) for x in sets]
                sig = [signatures(x, low, num, den) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(a, b - a) for c in ("id", "of")],
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([x for x, _ in both], pa.int64()),
                        pa.array([x for _, x in both], pa.int64()),
                        lists(pa.array(signed(np.concatenate(sig))), np.cumsum([0, *map(len, sig)])),
                    ],
                    names=["id", "of", "n_shingles", "h1", "h2", "sigs"],
                )

    return run


def _tokens(n: int):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            for a, b in blocks(off):
                sets = shingle_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a], n)
                same = np.array([_set_hash(x)[0] for x in sets], np.int64) == batch.column("h1").slice(a, b - a).to_numpy()
                got = [x.tobytes() for x in sets]
                part = pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in ("grp", "chunk", "chunks", "id")], pa.array(got, pa.binary())], names=["grp", "chunk", "chunks", "id", "tokens"])
                yield part.filter(pa.array(same))

    return run


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def link_block(sets: list[np.ndarray], left: list[bool], right: list[bool], num: int, den: int) -> list[int]:
    """For each set the index of its component's first set, by links between a left and a right set."""
    n, uf = len(sets), _Union(len(sets))
    sizes = np.array([len(x) for x in sets])
    queries = [i for i in range(n) if left[i]]
    if n <= 8:
        for i in queries:
            for j in range(n):
                if right[j] and i != j and uf.root(i) != uf.root(j) and den * min(sizes[i], sizes[j]) >= num * max(sizes[i], sizes[j]):
                    if len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= needed(int(sizes[i]), int(sizes[j]), num, den):
                        uf.join(i, j)
        return [uf.root(i) for i in range(n)]
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate(([0], np.cumsum(sizes)))
    own = [dense[at[i] : at[i + 1]] for i in range(n)]
    rows = sorted((i for i in range(n) if right[i]), key=lambda i: (int(sets[i][0]), int(sizes[i]), i))
    groups = [np.array(rows[i : i + GROUP]) for i in range(0, len(rows), GROUP)]
    unions = [np.unique(np.concatenate([own[i] for i in g])) for g in groups]
    flat, starts = np.concatenate(unions), np.concatenate(([0], np.cumsum([len(x) for x in unions])))[:-1]
    members = [np.concatenate([own[i] for i in g]) for g in groups]
    inner = [np.concatenate(([0], np.cumsum(sizes[g])))[:-1] for g in groups]
    least, largest = np.array([sizes[g].min() for g in groups]), np.array([sizes[g].max() for g in groups])
    mark = np.zeros(len(dense), np.int32)
    for q in queries:
        a = int(sizes[q])
        mark[own[q]] = 1
        bound = np.add.reduceat(mark[flat], starts)
        b = np.maximum(least, -(-num * a // den))
        open_ = (bound >= -(-num * (a + b) // (num + den))) & (b <= largest) & (b * num <= den * a)
        for k in np.flatnonzero(open_).tolist():
            g, mine = groups[k], uf.root(q)
            if all(uf.root(i) == mine for i in g.tolist()):
                continue
            both = np.add.reduceat(mark[members[k]], inner[k])
            for i in g[den * both >= num * (a + sizes[g] - both)].tolist():
                uf.join(q, i)
        mark[own[q]] = 0
    return [uf.root(i) for i in range(n)]


def _linked(num: int, den: int):
    """Rows come sorted by block; a block ends where the next begins, whatever the batches."""

    def close(ids, chunks, tokens):
        sets = [np.frombuffer(x, np.uint64) for x in tokens]
        first, last = min(chunks), max(chunks)
        root = link_block(sets, [c == first for c in chunks], [c == last for c in chunks], num, den)
        return [(ids[i], ids[r]) for i, r in enumerate(root) if r != i]

    def run(batches):
        key, ids, chunks, tokens, out = None, [], [], [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("grp", "one", "two", "chunk", "id", "tokens")]
            for g, one, two, chunk, i, t in zip(*cols, strict=True):
                if (g, one, two) != key:
                    if len(ids) > 1:
                        out += close(ids, chunks, tokens)
                    key, ids, chunks, tokens = (g, one, two), [], [], []
                if not ids or ids[-1] != i:
                    ids.append(i), chunks.append(chunk), tokens.append(t)
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        if len(ids) > 1:
            out += close(ids, chunks, tokens)
        yield _edges(out)

    return run


def _edges(rows):
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.int64())], names=["u", "v"])


def _named(docs: DataFrame, id: str, text: str, n: int, num: int, den: int) -> DataFrame:
    """(id, of, n_shingles, component) of each row: `of` is the text's digest, component the smallest id that links reach, null without words or id."""
    spark = docs.sparkSession
    workers(spark)
    plain = docs.select(F.col(id).cast("long").alias("id"), digest(F.col(text)).alias("of"), F.col(text).alias("text"))
    told = staged(plain.mapInArrow(_describe(n, num, den), "id long, of binary, n_shingles long, h1 long, h2 long, sigs array<long>"), "op7-sets")
    # one row of each class brings its parts: classes are found by their hashes alone, so that parts aren't sent for that
    reps = staged(told.where("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep")), "op7-classes", narrow=True)
    side = F.broadcast(reps) if reps.count() <= SMALL_ROWS else reps
    classes = told.where("n_shingles > 0").join(side, (F.col("id") == F.col("rep")) & (told["h1"] == reps["h1"]) & (told["h2"] == reps["h2"]))
    parts = classes.select("rep", told["h1"], F.explode("sigs").alias("sig"))
    # parts are sent once: sorted by part and set, the first set of each part is the one that the others are tied to
    low = F.first("rep").over(Window.partitionBy("sig").orderBy("rep"))
    tied = staged(parts.withColumn("low", low).where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v"), "h1").distinct(), "op7-ties")
    release(spark)
    rows = staged(told.drop("sigs"), "op7-rows")
    discard(told)
    told = rows
    near = components(tied.select("u", "v"), "op7-groups")
    # members of each group with the chunk that each is in
    width = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    names = told.where("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("node"))
    members = near.join(width, "component").join(names, "node").select(
        F.col("node").alias("id"), "h1", F.col("component").alias("grp"), "chunks",
        F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"),
    )
    members = staged(members, "op7-members", narrow=True)
    side = F.broadcast(members) if members.count() <= SMALL_ROWS else members
    texts = plain.join(side, "id").select("grp", "chunk", "chunks", "id", "h1", "text")
    held = texts.mapInArrow(_tokens(n), "grp long, chunk int, chunks int, id long, tokens binary")
    # chunk c takes part in the blocks (c, d) and (d, c); c = d is the block of the chunk with itself
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    held = held.select("grp", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "id", "tokens")
    held = held.repartition("grp", "one", "two").sortWithinPartitions("grp", "one", "two", "id")
    links = staged(held.mapInArrow(_linked(num, den), "u long, v long"), "op7-links")
    found = components(links, "op7-linked").withColumnRenamed("node", "rep")
    names = names.withColumnRenamed("node", "rep").join(found, "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component_id"))
    names = staged(names, "op7-names", narrow=True)  # so that the last join can split a set that very many rows have
    rows = told.select("id", "of", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("h1")).alias("h1"), "h2")
    return rows.join(names, ["h1", "h2"], "left").select("id", "of", "n_shingles", F.col("component_id").alias("component"))


def digest(text: F.Column) -> F.Column:
    """16 bytes that tell texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """(id, n_shingles, component_id) per row of docs. Links: Jaccard >= num / den of distinct n-word shingles, A-Z in lower case."""
    return _named(docs, id, text, n, num, den).select(F.col("id").alias(id), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs without near copies: of the rows that links connect the one with the smallest id stays, of equal ids the one with the
    smallest digest of its text; of rows with that id and that text the one whose columns come first. Rows without words or without
    id link with nothing and stay, all of them. A row is known by id and text, so another text under the id of a dropped one stays.

    Copies are found among ids and digests; texts are joined by their digest only where one is dropped or repeated."""
    named = staged(_named(docs, id, text, n, num, den).where("component is not null").groupBy("component", "id", "of").agg(F.count(F.lit(1)).alias("n")), "op7-rows")
    first = named.groupBy("component").agg(F.min(F.struct("id", "of")).alias("first"))
    first = staged(first, "op7-first", narrow=True)
    fate = named.join(first, "component").select(F.col("id").alias("_id"), F.col("of").alias("_of"), "n", (F.struct("id", "of") == F.col("first")).alias("_stays")).where("not _stays or n > 1").drop("n")
    fate = staged(fate, "op7-fate", narrow=True)
    side = F.broadcast(fate) if fate.count() <= SMALL_ROWS else fate
    own = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id).cast("long").alias("_id"), digest(F.col(text)).alias("_of"))
    told = own.join(side, ["_id", "_of"], "left").where("_stays is null or _stays")
    once = told.where("_stays").groupBy("_id", "_of").agg(F.min("_row").alias("_row")).select("_row.*")
    return told.where("_stays is null").select("_row.*").unionByName(once)


def op7_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def components_sql(docs: str, before: str = "") -> str:
    """CTEs ending in `comps` (doc_id, n_shingles, component_id) of the relation `docs`."""
    return rf"""{before}jw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM {docs}),
js AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) END) AS g FROM jw),
jn AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM js GROUP BY doc_id),
jp AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM js a JOIN js b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
jl AS MATERIALIZED (SELECT a, b FROM jp JOIN jn x ON x.doc_id = a JOIN jn y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)),
jr(a, b) AS (SELECT doc_id, doc_id FROM jw UNION SELECT jr.a, jl.b FROM jr JOIN jl ON jr.b = jl.a),
comps AS MATERIALIZED (SELECT jw.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(jr.b) AS component_id FROM jw JOIN jr ON jr.a = jw.doc_id LEFT JOIN jn ON jn.doc_id = jw.doc_id GROUP BY jw.doc_id)"""


OP7_SQL = f"WITH RECURSIVE {components_sql('documents')} SELECT doc_id, n_shingles, component_id FROM comps"

QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
SQL = {"op7_ngram_jaccard_join": OP7_SQL}
