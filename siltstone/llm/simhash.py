"""SimHash near-dedup by multi-index hashing (operator 12).

A text's fingerprint has a bit for each of the 64 bits of its shingles' XXH64 (seed 42): 1 if it is set in over half of them, repeats
counted. Fingerprints link when at most RADIUS = 2 bits differ; each row gets the smallest id that links reach.

1. Equal fingerprints are one class, so copies are never expanded.
2. Each fingerprint is split into two segments of 32 bits. Of two that link, either the first segments differ in at most one bit, or the
   second segments are equal. So the table of first segments is asked for the ball of radius 1 around each first segment (33 values), the
   table of second segments for the segment itself; every fingerprint found is held against the whole one and linked if the distance is 2
   or less.
3. A segment value that over HOT fingerprints share isn't asked so, as all its pairs would be compared. Its members, and the fingerprints
   whose ball meets it, go to a second index instead: two fingerprints at distance 2 or less have a common neighbour within
   1 bit, so under each of the 65 values of their own balls of all 64 bits all that meet are within distance 2 of each other, and a star
   to the smallest of them stands for their pairs. That is exact and takes 65 rows for each fingerprint, whatever the size of the group.
4. Components of the links name the classes.

Null or blank text has no words and fingerprint zero, linked like any other. Texts under three words: the whole sequence is the one
shingle. Rows with a null id get a null component, unless rows with ids share their class. Repeated rows each get their own result; ids are
whole numbers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, lowered, staged, words, workers
from .graph import components

N, SEED, RADIUS = 3, 42, 2
#: Fingerprints that share a segment value at most for it to be asked pair by pair; rows of a table that is broadcast at most; shingles
#: whose bits are counted at once.
HOT, SMALL_ROWS, AT_ONCE = 16, 400_000, 1 << 16


def normal(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words joined by one space: bytes, start and end of each word, and the offsets of each text's words."""
    low = lowered(buf)
    s, e, at = words(low, off)
    size = e - s
    end = np.cumsum(size + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    solid = np.ones(len(out), bool)
    solid[end - 1] = False
    inside = np.zeros(len(low) + 1, np.int8)
    inside[s] += 1
    inside[e] -= 1
    out[solid] = low[np.cumsum(inside[:-1]).astype(bool)]
    return out, end - 1 - size, end - 1, at


def fingerprints(buf: np.ndarray, off: np.ndarray, n: int = N) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    body, s, e, at = normal(buf, off)
    data = memoryview(body.tobytes())
    out = np.zeros(len(off) - 1, np.uint64)
    count = np.diff(at)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    # shingles of all texts in order, as slices of the normal bytes
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    first = np.repeat(at[:-1], size) + nth
    last = first + np.repeat(np.where(count >= n, n - 1, np.maximum(count - 1, 0)), size)
    begin, end = s[first].tolist(), e[last].tolist()
    ones = np.zeros((len(size), 64), np.int64)
    text = np.repeat(np.arange(len(size)), size)
    of = xxhash.xxh64_intdigest
    for a in range(0, len(begin), AT_ONCE):
        b = min(a + AT_ONCE, len(begin))
        h = np.fromiter((of(data[x:y], SEED) for x, y in zip(begin[a:b], end[a:b], strict=True)), np.uint64, b - a)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        own = text[a:b]
        edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    over = (2 * ones > size[:, None]).astype(np.uint8)
    if len(out):
        out = np.packbits(over, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def _described(n: int):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            for a, b in blocks(off):
                got = fingerprints(buf[off[a] : off[b]], off[a : b + 1] - off[a], n)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(got.view(np.int64))], names=["id", "fp"])

    return run


def _high(x: str) -> Column:
    return F.shiftrightunsigned(x, 32)


def _low(x: str) -> Column:
    return F.col(x).bitwiseAND(F.lit((1 << 32) - 1))


def _ball(value: Column, bits: int) -> Column:
    """The value and all that differ from it in one of its lowest `bits` bits."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """(u, v) of distinct fingerprints, column fp, whose components are those of all links: pairs at distance RADIUS or less, or stars of such."""
    # the tables: (segment, value) with how many share it; those alone with their value in both segments are only asked
    table = fps.select("fp", F.explode(F.array(F.struct(F.lit(1).alias("seg"), _high("fp").alias("key")), F.struct(F.lit(2).alias("seg"), _low("fp").alias("key")))).alias("s")).select("fp", "s.*")
    crowd = staged(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("seg", "key"), "op12-hot", narrow=True)
    crowded = F.broadcast(crowd) if crowd.count() <= SMALL_ROWS else crowd
    probes = fps.select("fp", F.explode(F.concat(
        F.transform(_ball(_high("fp"), 32), lambda k: F.struct(F.lit(1).alias("seg"), k.alias("key"))), F.array(F.struct(F.lit(2).alias("seg"), _low("fp").alias("key")))
    )).alias("s")).select(F.col("fp").alias("q"), "s.*")
    cold = table.join(crowded, ["seg", "key"], "left_anti")
    met = probes.join(cold, ["seg", "key"]).where((F.col("q") != F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= RADIUS))
    pairs = met.select(F.greatest("q", "fp").alias("u"), F.least("q", "fp").alias("v")).distinct()
    some = probes.join(crowded, ["seg", "key"], "left_semi").select("q").distinct()
    near = some.select("q", F.explode(_ball(F.col("q"), 64)).alias("key"))
    stars = staged(near.groupBy("key").agg(F.min("q").alias("v"), F.max("q").alias("top")).where("v < top").select("key", "v"), "op12-stars")
    rest = near.join(stars, "key").where("q <> v").select(F.col("q").alias("u"), "v").distinct()
    return pairs.unionByName(rest)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = N, hot: int = HOT) -> DataFrame:
    """(id, fp as a signed 64-bit number, component_id) of each row of docs."""
    workers(docs.sparkSession)
    plain = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    told = staged(plain.mapInArrow(_described(n), "id long, fp long"), "op12-fingerprints")
    own = staged(told.groupBy("fp").agg(F.min("id").alias("least")), "op12-classes", narrow=True)
    near = components(staged(links(own.select("fp"), hot), "op12-links"), "op12-groups")
    joined = own.join(near, own["fp"] == near["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = staged(joined, "op12-joined", narrow=True)
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = staged(joined.select("fp", "component").join(least, "component").select("fp", "component_id"), "op12-names", narrow=True)  # so that the last join can split a fingerprint of very many rows
    return told.join(named, "fp").select(F.col("id").alias(id), "fp", "component_id")


def op12_simhash(spark, sf_dir: str) -> DataFrame:
    got = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op12_simhash": op12_simhash}
SQL: dict = {}
