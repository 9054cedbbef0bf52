"""Sharding by balanced label propagation (operator 6), with the law `rows`: shard counts are at most one apart.

Nodes are the distinct texts, weighted by their rows, so that copies move together. Texts that share a
min-hash of their 5-word shingles are linked through it. Each starts in a shard drawn for itself. Each round joins nodes with
what the shards of their links' members are; a node wants the shard where most of them are. Moves between two shards are
let through as far as they balance each other or the target's quota has room (a share of them, chosen by
a hash that linked texts share); `parted` tells how many members are still away from most of their link. After the last round all rows are laid out by (shard wanted, link, text, id) and cut into equal
runs: that makes sizes exact, and only texts that a cut meets, or that exceed a shard, are parted.

Rounds touch keys and weights only, never texts. The places of the layout come from counts of at most
SHARDS * BUCKETS + HOT * SALTS buckets; a text with more than 1 / HOT of all rows (and FEW of them) is salted by id, so no
task holds an unbounded group. Other columns are not read. Null ids come last among equal texts. Null text: size 1 and the checksum of no bytes, one text like others.
Texts under 5 words are linked by the whole text. Repeated rows each get a slot. Empty: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, blocks, lists, lowered, mix, prefix_hash, signed, slice_hash, staged, text_of, words, workers

#: Quotas are loose at first and tighten by the last round. One more, without quotas, takes what they have kept away to its
#: links: sizes are near equal by then, and the layout makes them exact.
SHARDS, ROUNDS, SLACK, LOOSE = 8, 8, 0.03, 0.4
BUCKETS, HOT, SALTS, FEW = 1024, 256, 32, 500
SHINGLE, LINKS = 5, 4
_A = np.uint64(0xA24BAED4963EE407)


def _links(batches):
    """Adds LINKS min-hashes of the word shingles of each text."""
    for batch in batches:
        buf, off = as_bytes(batch.column("text"))
        others = [c for c in batch.schema.names if c != "text"]
        for a, b in blocks(off):
            low = lowered(buf[off[a] : off[b]])
            s, e, at = words(low, off[a : b + 1] - off[a])
            h = slice_hash(prefix_hash(low), s, e)
            g = np.zeros(len(h), np.uint64)
            for j in range(SHINGLE):
                if len(h) > j:
                    g[: len(h) - j] = mix(g[: len(h) - j] * _A + h[j:])
            room = np.repeat(at[1:], np.diff(at))
            g = np.where(np.arange(len(g)) + SHINGLE <= room, g, np.uint64(0xFFFFFFFFFFFFFFFF)) if len(g) else g
            some = np.flatnonzero(np.diff(at) >= SHINGLE)
            out = np.zeros((b - a, LINKS), np.uint64)
            for j in range(LINKS):
                if len(some):
                    key = np.where(g == np.uint64(0xFFFFFFFFFFFFFFFF), g, mix(g ^ np.uint64(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)))
                    # empty texts between those with words don't disturb: their ranges are empty
                    low_ = np.minimum.reduceat(key, at[:-1][np.diff(at) > 0]) if len(key) else key
                    full = np.flatnonzero(np.diff(at) > 0)
                    out[full, j] = low_
            few = np.ones(b - a, bool)
            few[some] = False
            own = batch.column("g").slice(a, b - a).to_numpy()
            made = signed(mix(out + np.arange(LINKS, dtype=np.uint64) * _A))
            made[few] = own[few, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in others], lists(pa.array(np.ascontiguousarray(made).ravel()), np.arange(b - a + 1) * LINKS)], names=[*others, "links"])


def _accepted(wanted: dict[tuple[int, int], int], sizes: list[int], shards: int, slack: float = SLACK) -> dict[tuple[int, int], float]:
    """The share of the moves a -> b that is let through: swaps, then what b's quota has room for."""
    room = [sum(sizes) / shards * (1 + slack) - x for x in sizes]
    out = {}
    for (a, b), n in wanted.items():
        rest = {x: max(0, m - wanted.get((b, x), 0)) for (x, y), m in wanted.items() if y == b}
        extra = max(0.0, room[b]) * rest[a] / max(1, sum(rest.values()))
        out[a, b] = min(1.0, (min(n, wanted.get((b, a), 0)) + extra) / n)
    return out


def homes(nodes: DataFrame, links: DataFrame, total: int, rounds: int = 2) -> DataFrame:
    """(g, home): a key that linked texts share, the least of what their links reach in two steps; links that more than
    1 / HOT of all rows (and FEW of them) share say nothing here, so homes stay small."""
    few = links.groupBy("link").agg(F.sum("w").alias("n")).where(F.col("n") <= max(total // HOT, FEW)).select("link")
    near = staged(links.select("g", "link").join(few, "link"), "op6-near", narrow=True)
    now = near.groupBy("g").agg(F.min("link").alias("home"))
    for _ in range(rounds):
        least = staged(near.join(now, "g").groupBy("link").agg(F.min("home").alias("home")), "op6-homes", narrow=True)
        now = near.join(least, "link").groupBy("g").agg(F.min("home").alias("home"))
    return staged(nodes.select("g", "w").join(now, "g", "left").withColumn("home", F.coalesce("home", "g")), "op6-homes", narrow=True)


def propagated(homed: DataFrame, links: DataFrame, shards: int, rounds: int) -> DataFrame:
    """(g, w, home, label) of nodes (g, w, home) with links (g, w, link)."""
    now = homed.withColumn("label", F.pmod(F.xxhash64("g", F.lit("start")), F.lit(shards)).cast("int"))
    for t in range(rounds + 1 if rounds else 0):
        held = links.join(now.select("g", "label"), "g").groupBy("link", "label").agg(F.sum("w").alias("n"))
        # ties go by a hash that the members of a link share, so that no shard is favoured
        most = held.groupBy("link").agg(F.max(F.struct("n", F.xxhash64("link", "label").alias("tie"), "label")).alias("top")).select("link", "top.n", F.col("top.label").alias("want"))
        wants = links.select("g", "link").join(staged(most, "op6-most", narrow=True), "link").groupBy("g", "want").agg(F.sum("n").alias("n"), F.min("link").alias("link"))
        wants = wants.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("link", "want").alias("tie"), "want")).alias("top")).select("g", "top.want")
        moves = staged(now.join(wants, "g", "left").withColumn("want", F.coalesce("want", "label")), "op6-wants", narrow=True)
        table = moves.groupBy("label", "want").agg(F.sum("w").alias("n")).collect()  # at most shards ** 2 rows
        sizes = [sum(r.n for r in table if r.label == k) for k in range(shards)]
        share = _accepted({(r.label, r.want): r.n for r in table if r.label != r.want}, sizes, shards, max(SLACK, LOOSE * (1 - (t + 1) / rounds)) if t < rounds else shards)
        luck = F.pmod(F.xxhash64("home", F.lit(t)), F.lit(1_000_000)) / 1e6  # linked texts go together
        goes = F.lit(False)
        for (a, b), p in share.items():
            goes = goes | ((F.col("label") == a) & (F.col("want") == b) & (luck < p))
        now = moves.select("g", "w", "home", F.when(goes, F.col("want")).otherwise(F.col("label")).alias("label"))
        if not share:
            break
    return now


def parted(placed: DataFrame, links: DataFrame) -> float:
    """The share of the members of links that are not in the shard where most of their link is."""
    held = links.join(placed.select("g", "label"), "g").groupBy("link", "label").agg(F.sum("w").alias("n"))
    got = held.groupBy("link").agg(F.sum("n").alias("n"), F.max("n").alias("most")).agg(F.sum("n").alias("n"), F.sum("most").alias("most")).first()
    return 1 - got.most / got.n if got.n else 0.0


def sharded(docs: DataFrame, id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) per row."""
    workers(docs.sparkSession)
    t = text_of(text)
    plain = docs.select(F.col(id).alias("id"), (F.octet_length(t) + F.lit(1)).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("crc"), F.xxhash64(F.col(text)).alias("g"), t.alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    rows = staged(plain.mapInArrow(_links, f"id {kind}, size long, crc long, g long, links array<long>"), "op6-rows")
    nodes = staged(rows.groupBy("g").agg(F.count(F.lit(1)).alias("w"), F.first("links").alias("links")), "op6-nodes")
    total = nodes.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    each = nodes.select("g", "w", F.explode(F.array_distinct("links")).alias("link"))
    shared = staged(each.groupBy("link").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("link"), "op6-shared", narrow=True)
    links = staged(each.join(shared, "link"), "op6-links", narrow=True)
    place = propagated(homes(nodes, links, int(total)), links, shards, rounds)
    # linked texts lie together: ordered by their home
    place = place.withColumn("hot", F.when(F.col("w") > max(int(total) // HOT, FEW), F.col("g"))).withColumnRenamed("home", "near")
    place = staged(place.select("g", "label", "near", F.pmod(F.shiftright(F.col("near"), 20), F.lit(BUCKETS)).cast("int").alias("bucket"), "hot"), "op6-place", narrow=True)
    at = ["label", "bucket", "hot", "salt"]
    laid = rows.select("id", "size", "crc", "g").join(place, "g")
    laid = staged(laid.withColumn("salt", F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")), "op6-laid", narrow=True)
    counts = laid.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, -1))).select(*at, F.coalesce("before", F.lit(0)).alias("before"))
    before = before.withColumnsRenamed({c: f"b_{c}" for c in at})
    on = [laid[c].eqNullSafe(before[f"b_{c}"]) for c in at]
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("near", "g", "id"))
    ranked = laid.withColumn("nth", inside).join(F.broadcast(before), on).withColumn("rank", F.col("before") + F.col("nth") - 1)
    shard = F.expr(f"cast(rank * {shards} div {max(int(total), 1)} as int)")
    first = F.expr(f"(shard * cast({int(total)} as long) + {shards - 1}) div {shards}")
    out = ranked.withColumn("shard", shard).withColumn("slot", (F.col("rank") - first).cast("long"))
    return out.select(F.col("id").alias(id), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_label_propagation_shards(spark, sf_dir: str) -> DataFrame:
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_label_propagation_shards": op6_label_propagation_shards}
SQL: dict = {}
