"""Benchmark decontamination (operator 2): rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and freed of ASCII punctuation. Seeds are n-grams of a test item; where a text holds a seed, the item is
aligned with the words around by Smith-Waterman (match 2, mismatch -1, gap -1), unless too few of its words are there; a pair is
reported when the score reaches SIMILAR of the item's highest possible score. Which n-grams are seeds depends on the item's length alone,
never on the size of the corpus or on how often the item leaked:

* FULL = 20 words and more: of every NEAR = 2 neighbouring 3-grams the one that fewer training texts hold (ties: the lower
  hash), so the rare ones, yet spread over the whole item: four words of it in a row always hold one.
* SHORT = 12 to FULL words: all 3-grams.
* under SHORT words: all pairs of words that are neighbours or have one word between, in the item as in the text. That is
  exact: an alignment of m matches that scores n, half of the highest score of n words, has penalties of 2 m - n <= m, so two
  matches in a row have at most one word between.

A pair of a longer item whose text holds no seed of it is not found, whatever its score.

The test set goes to the executors in blocks of about ITEM_WORDS words, equal items once; texts are scanned twice for each block,
once to count 3-grams and once to align, and never exchanged. All sizes take this same way.

Null texts hold no words and are in no pair. Items under 3 words have no seed and are in no pair; empty tables give
no pairs. Repeated rows, and equal items, each get their own pairs. Null ids stay null; ids may have any type. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, mix, prefix_hash, slice_hash, staged, words, workers

N = 3
MATCH, MISMATCH, GAP, SIMILAR = 2, -1, -1, 0.5
#: Neighbouring 3-grams of which the rarest is a seed, in items of FULL words and more; items under SHORT words have pairs of words as
#: seeds; words of test items that are sent to the executors at once.
NEAR, FULL, SHORT, ITEM_WORDS = 2, 20, 12, 500_000
#: Digests of leaking texts that are broadcast at most; more are joined by shuffle.
SMALL_ROWS = 400_000
_A = np.uint64(0xA24BAED4963EE407)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and n + 1 offsets of each text's words."""
    plain = _PLAIN[buf]
    s, e, at = words(plain, off)
    return slice_hash(prefix_hash(plain), s, e), at


def grams(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams within texts, and the word that each starts at."""
    if len(h) < N:
        return h[:0], np.zeros(0, np.int64)
    g = np.zeros(len(h) - N + 1, np.uint64)
    for j in range(N):
        g = mix(g * _A + h[j : len(h) - N + 1 + j])
    room = np.repeat(at[1:], np.diff(at))[: len(g)]
    place = np.flatnonzero(np.arange(len(g)) + N <= room)
    return g[place], place


def pairs(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs of words at distance 1 and 2 within texts, and the word that each starts at."""
    room = np.repeat(at[1:], np.diff(at))
    out = []
    for step in (1, 2):
        place = np.flatnonzero(np.arange(len(h)) + step < room)
        out.append((mix(mix(h[place]) * _A + h[place + step]), place))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def smith_waterman(item: np.ndarray, body: np.ndarray) -> tuple[int, int, int]:
    """Best local score, and the last word of the alignment in item and body (-1: none)."""
    m = len(body)
    step = np.arange(m, dtype=np.int32) * -GAP
    above, best = np.zeros(m, np.int32), (0, -1, -1)
    for i, word in enumerate(item):
        cell = np.where(body == word, MATCH, MISMATCH).astype(np.int32)
        cell[1:] += above[:-1]
        np.maximum(cell, above + GAP, out=cell)
        np.maximum(cell, 0, out=cell)
        above = np.maximum.accumulate(cell + step) - step
        j = int(above.argmax())
        if above[j] > best[0]:
            best = (int(above[j]), i, j)
    return best


def align(item: np.ndarray, body: np.ndarray, hits: list[tuple[int, int]]) -> tuple[int, int, int]:
    """Best score around the seeds (place in body, place in item), and the first and last word aligned in body."""
    n = len(item)
    slack = n if n < SHORT else n // 4 + 4  # an alignment of half the highest score skips n words at most
    spans: list[list[int]] = []
    for lo, hi in sorted((max(0, p - q - slack), min(len(body), p - q + n + slack)) for p, q in hits):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    best = (0, -1, -1)
    for lo, hi in spans:
        if MATCH * int(np.isin(item, body[lo:hi]).sum()) < max(SIMILAR * MATCH * n, best[0] + 1):
            continue  # even if all of these matched
        score, i, j = smith_waterman(item, body[lo:hi])
        if score > best[0]:
            _, _, back = smith_waterman(item[: i + 1][::-1], body[lo : lo + j + 1][::-1])
            best = (score, lo + j - back, lo + j)
    return best


class Seeds:
    """Hashes with the items, and places in them, that each is from."""

    def __init__(self, gram: np.ndarray, item: np.ndarray, place: np.ndarray):
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.all = np.unique(gram)

    def met(self, g: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, number of the seed) wherever a hash of a text is a seed."""
        if not len(self.all):
            return place[:0], place[:0], place[:0]
        i = np.minimum(np.searchsorted(self.all, g), len(self.all) - 1)
        got = np.flatnonzero(self.all[i] == g)
        return np.searchsorted(at, place[got], "right") - 1, place[got], i[got]

    def of(self, seed: int) -> range:
        return range(int(np.searchsorted(self.gram, seed, "left")), int(np.searchsorted(self.gram, seed, "right")))


class Items:
    """The items of a block with their 3-grams, and the pairs of the short ones; `rare` makes seeds of some 3-grams, after which only
    these are left."""

    def __init__(self, ids: list, texts: list[str | None]):
        h, at = word_hashes(*as_bytes(pa.array(texts, pa.string())))
        self.ids, self.words = ids, [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.size = np.diff(at)

        def held(found: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> Seeds:
            item = np.searchsorted(at, found[1], "right") - 1
            keep = some[item]
            return Seeds(found[0][keep], item[keep], (found[1] - at[item])[keep])

        self.pairs = held(pairs(h, at), (self.size >= N) & (self.size < SHORT))
        self._take(held(grams(h, at), np.ones(len(self.size), bool)))

    def _take(self, seeds: Seeds) -> None:
        self.grams, self.gram, self.item, self.place, self.seeds = seeds, seeds.gram, seeds.item, seeds.place, seeds.all

    def rare(self, counts: np.ndarray, full: int = 0) -> Items:
        """Keeps, of every NEAR neighbouring 3-grams of an item, the one with the least count; counts follow `seeds`. Items under `full`
        words keep all."""
        order = np.lexsort((self.place, self.item))
        gram, item, place = self.gram[order], self.item[order], self.place[order]
        rank = np.empty(len(self.seeds), np.int64)
        rank[np.lexsort((self.seeds, counts))] = np.arange(len(self.seeds))
        own = rank[np.searchsorted(self.seeds, gram)]
        keep = self.size[item] < full
        first = np.searchsorted(item, np.arange(len(self.words) + 1))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            for i in range(a, max(a + 1, b - NEAR + 1)) if b > a else ():
                keep[i + int(own[i : min(i + NEAR, b)].argmin())] = True
        self._take(Seeds(gram[keep], item[keep], place[keep]))
        return self

    def met(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, word, number of the seed) wherever a text holds a 3-gram that is a seed."""
        return self.grams.met(*grams(h, at), at)

    def hits(self, h: np.ndarray, at: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """For each text and item that share a seed: (word of the text, word of the item)."""
        out: dict[int, dict[int, list]] = {}
        for seeds, found in ((self.grams, grams), (self.pairs, pairs)):
            if len(seeds.all):
                for d, p, seed in zip(*(x.tolist() for x in seeds.met(*found(h, at), at)), strict=True):
                    for r in seeds.of(seeds.all[seed]):
                        out.setdefault(d, {}).setdefault(int(seeds.item[r]), []).append((p - int(at[d]), int(seeds.place[r])))
        return out


PAIRS = "item string, n_seeds long, score long, similarity double, first_word long, last_word long"


def _pairs_of(items: Items, body: np.ndarray, hits: dict[int, list[tuple[int, int]]]):
    for k, found in hits.items():
        most = MATCH * len(items.words[k])
        score, first, last = align(items.words[k], body, found)
        if score >= SIMILAR * most:
            yield k, len({q for _, q in found}), score, score / most, first, last


def _holding(items: Items):
    """How many texts of a task hold each 3-gram of the items."""

    def run(batches):
        n = np.zeros(len(items.seeds), np.int64)
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            for a, b in blocks(off):
                doc, _, seed = items.met(*word_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a]))
                n += np.bincount(np.unique(doc * len(n) + seed) % len(n), minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["seed", "n"])

    return run


def _scan(items: Items):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            rows: list[tuple] = []
            for a, b in blocks(off):
                h, at = word_hashes(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                for d, found in items.hits(h, at).items():
                    rows += [(a + d, *x) for x in _pairs_of(items, h[at[d] : at[d + 1]], found)]
            yield _table(batch.column("id").take(pa.array([r[0] for r in rows], pa.int64())), [items.ids[r[1]] for r in rows], [r[2:] for r in rows])

    return run


def _table(ids: pa.Array, items: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    rest = [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([ids, pa.array(items, pa.string()), *rest], names=["id", *[c.split()[0] for c in PAIRS.split(", ")]])


def leaks(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = ITEM_WORDS) -> DataFrame:
    """(id, item_id, n_seeds, score, similarity, first_word, last_word) of each pair of a text and an item that it holds."""
    workers(docs.sparkSession)
    plain = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    tests = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("item_text")).where("item_text is not null").withColumn("item", F.md5("item_text"))
    once = tests.select("item", "item_text").distinct()
    kinds = f"id {docs.schema[id].dataType.simpleString()}, {PAIRS}"
    n_blocks = -(-once.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0] // (6 * most))
    out = docs.sparkSession.createDataFrame([], kinds)
    for n in range(n_blocks):
        rows = once.where(F.pmod(F.xxhash64("item_text"), F.lit(n_blocks)) == n).orderBy("item").collect()
        held = Items([r.item for r in rows], [r.item_text for r in rows])
        if not len(held.seeds):
            continue
        counts = np.zeros(len(held.seeds), np.int64)
        for r in plain.select("text").mapInArrow(_holding(held), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect():  # a row for each 3-gram of the block at most
            counts[r.seed] = r.n
        part = plain.mapInArrow(_scan(held.rare(counts, FULL)), kinds)
        out = part if n_blocks == 1 else out.unionByName(part)
    out = out.join(tests.select("item", "item_id"), "item")
    return out.select(F.col("id").alias(id), F.col("item_id").alias(item_id), *[c.split()[0] for c in PAIRS.split(", ")[1:]])


def clean(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = ITEM_WORDS) -> DataFrame:
    """The rows of docs whose text holds no item. A text decides for itself: rows that repeat an id with another text, and rows without id, count alone."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    named = docs.select(key.alias("_key"), F.col(text).alias("_text"))
    found = staged(leaks(named, items, "_key", "_text", item_id, item_text, most).select("_key").distinct(), "leaks")
    return docs.join(F.broadcast(found) if found.count() <= SMALL_ROWS else found, key == found["_key"], "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    got = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.withColumn("similarity", F.round("similarity", 6))


QUERIES = {"op2_decontamination": op2_decontamination}
SQL: dict = {}
