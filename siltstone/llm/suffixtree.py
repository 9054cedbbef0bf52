"""LM scoring by a probabilistic suffix tree (operator 1).

Texts are words and one end, A-Z in lower case. The tree reads a word as its bytes and a boundary, so it
can also score words that it has never seen; contexts are the up to DEPTH symbols before, across
words, and start anew with each text.

Learning: every task counts the (context, symbol) pairs of its training texts of full depth and sends
the counts; shorter contexts are sums of these. A context is retained if it occurs LEAST times, in a
corpus of any size, and its next-symbol distribution diverges from that of its longest proper suffix: the
log-likelihood gain must exceed GAIN for each symbol seen after it. Distributions are smoothed towards the longest retained
suffix (Witten-Bell), down to the root, which gives every byte some probability.

Scoring: a position takes the longest retained suffix of its context as its state. What depends on the
word before is scored once for each distinct (end of word before, start of word), the rest once for each
distinct word of a block. A tree of up to HELD entries is sent to the executors. A larger one is dealt
over hash buckets by the TOP nearest symbols of its contexts, only what is shallower is sent whole, and
the distinct grams of a block are asked from the buckets; the scores are the same.

Base: add-0.1 unigram over tokens. The corpus counts of a block's distinct words are asked from hash
buckets and come back in the block's order; no vocabulary is held in one place.

Null text counts as empty: just the end. A null id counts as held out, as its text form is empty.
Repeated rows are scored, and learnt from, each on its own. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, blocks, lists, lowered, mix, prefix_hash, signed, slice_hash, staged, text_of, words, workers

DEPTH = 5
LEAST = 4
GAIN = 1.0
#: Entries of a tree that is sent whole; depths of a larger one that still are (at most 256 ** TOP entries).
HELD, TOP = 4_000_000, 3
#: Bytes of text that are scored at once, and whose distinct words are asked for at once.
BLOCK, ASKED = 1 << 20, 12 << 20
END = np.uint64(0x5851F42D4C957F2D)
_PAD = DEPTH + 1


class Symbols:
    """The symbol stream of a block of texts. Before each text: zeros and a boundary, so that no context crosses texts."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        low = lowered(buf)
        s, e, self.at = words(low, off)
        size = e - s
        rows = np.repeat(np.arange(len(off) - 1), np.diff(self.at))
        ends = np.cumsum(size + 1) + _PAD * (rows + 1)
        self.n_words, self.p, self.size = len(s), ends - size - 1, size
        total = int(size.sum()) + len(s) + _PAD * len(off)
        self.x = np.zeros(total, np.uint8)
        lines = _PAD * np.arange(1, len(off)) + np.concatenate(([0], np.cumsum(size + 1)))[self.at[:-1]]
        self.x[lines - 1] = 0x20
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        to = np.repeat(self.p, size) + inside
        self.x[to] = np.maximum(low[np.repeat(s, size) + inside], 1)
        self.x[ends - 1] = 0x20
        self.ends = lines + (np.concatenate(([0], np.cumsum(size + 1)))[self.at[1:]] - np.concatenate(([0], np.cumsum(size + 1)))[self.at[:-1]])
        self.hash = slice_hash(prefix_hash(low), s, e)

    def keys(self, at: np.ndarray) -> np.ndarray:
        """Context, nearest symbol first, and symbol of each place, in DEPTH + 1 bytes."""
        out = np.zeros(len(at), np.uint64)
        for j in range(1, DEPTH + 1):
            out = (out << np.uint64(8)) | self.x[at - j]
        return (out << np.uint64(8)) | self.x[at]


def _grams(batches):
    for batch in batches:
        buf, off = as_bytes(batch.column("text"))
        for a, b in blocks(off, BLOCK):
            t = Symbols(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            place = np.concatenate([np.repeat(t.p, t.size + 1) + (np.arange(int((t.size + 1).sum())) - np.repeat(np.cumsum(t.size + 1) - t.size - 1, t.size + 1)), t.ends])
            yield t.keys(place)


def _counted(batches):
    """Counts of a whole task; blocks are folded in as they come."""
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for got in _grams(batches):
        got.sort()
        cut = np.flatnonzero(np.concatenate((got[1:] != got[:-1], [True]))) if len(got) else np.zeros(0, np.int64)
        k, n = got[cut], np.diff(np.concatenate(([-1], cut)))
        if len(keys):
            keys, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        else:
            keys, counts = k, n
        if len(keys) > 3_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts)], names=["gram", "n"])
            keys, counts = keys[:0], counts[:0]
    yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts.astype(np.int64))], names=["gram", "n"])


class Tree:
    """Retained contexts by depth: entries (context, symbol) with log10 probabilities, and what backing off costs."""

    def __init__(self, rows: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.entries, self.logp, self.states, self.back = [], [], [], []
        for d in range(DEPTH + 1):
            key, n = rows.get(d, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            order = np.argsort(key)
            key, n = key[order], n[order].astype(float)
            ctx, at = np.unique(key >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx)).astype(float)
            if d == 0:
                whole = n.sum()
                p = (n + 0.5) / (whole + 0.5 * 256)
                self.unseen = float(np.log10(0.5 / (whole + 0.5 * 256)))
                back = np.zeros(len(ctx))
            else:
                full = (key >> np.uint64(8)) << np.uint64(8 * (DEPTH - d) + 8) | (key & np.uint64(255))
                p = (n + kinds[at] * 10 ** self.score(full, d - 1)) / (total[at] + kinds[at])
                back = np.log10(kinds / (total + kinds))
            self.entries.append(key), self.logp.append(np.log10(p)), self.states.append(ctx), self.back.append(back)

    def score(self, keys: np.ndarray, deepest: int = DEPTH) -> np.ndarray:
        """log10 probability of each key's symbol in the longest retained suffix of its context."""
        out, left = np.zeros(len(keys)), np.arange(len(keys))
        ctx, sym = keys >> np.uint64(8), keys & np.uint64(255)
        for d in range(deepest, -1, -1):
            if not len(self.entries[d]) or not len(left):
                continue
            c = ctx[left] >> np.uint64(8 * (DEPTH - d)) if d else np.zeros(len(left), np.uint64)
            k = (c << np.uint64(8)) | sym[left]
            i = np.minimum(np.searchsorted(self.entries[d], k), len(self.entries[d]) - 1)
            hit = self.entries[d][i] == k
            out[left[hit]] += self.logp[d][i[hit]]
            left, c = left[~hit], c[~hit]
            if d:
                j = np.minimum(np.searchsorted(self.states[d], c), len(self.states[d]) - 1)
                known = self.states[d][j] == c
                out[left[known]] += self.back[d][j[known]]
        out[left] += self.unseen
        return out


def retained(texts: DataFrame) -> DataFrame:
    """(d, key, n): depth, context with symbol, and count of each entry of the tree of a column `text`."""
    grams = staged(texts.mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "op1-grams")
    part = lambda d: F.shiftrightunsigned("gram", 8 * (DEPTH - d) + 8) if d else F.lit(0).cast("long")
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), part(d).alias("ctx")) for d in range(DEPTH + 1)])).alias("c")
    table = grams.select(each, F.col("gram").bitwiseAND(F.lit(255)).alias("sym"), "n")
    table = staged(table.groupBy(F.col("c.d").alias("d"), F.col("c.ctx").alias("ctx"), "sym").agg(F.sum("n").alias("n")), "op1-contexts")
    totals = table.groupBy("d", "ctx").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    above = table.join(totals, ["d", "ctx"]).select((F.col("d") + 1).alias("d"), F.col("ctx").alias("up"), "sym", (F.col("n") / F.col("total")).alias("q"))
    frequent = totals.where(F.col("total") >= LEAST)
    each = table.where("d > 0").join(frequent, ["d", "ctx"]).withColumn("up", F.when(F.col("d") == 1, F.lit(0)).otherwise(F.shiftrightunsigned("ctx", 8)))
    gain = each.join(above, ["d", "up", "sym"]).groupBy("d", "ctx").agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain"), F.first("kinds").alias("kinds"))
    kept = gain.where(F.col("gain") > GAIN * F.col("kinds")).select("d", "ctx")
    return staged(table.join(kept, ["d", "ctx"]).unionByName(table.where("d = 0")).select("d", ((F.shiftleft("ctx", 8)).bitwiseOR(F.col("sym"))).alias("key"), "n"), "op1-states", narrow=True)


def _by_depth(states: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    got = states.toArrow()
    d, key, n = (got.column(c).to_numpy() for c in ("d", "key", "n"))
    return {k: (key[d == k].view(np.uint64), n[d == k]) for k in range(DEPTH + 1)}


def learn(texts: DataFrame) -> Tree:
    """The tree of a column `text`."""
    return Tree(_by_depth(retained(texts)))


BLOCKS = "block long, id array<long>, held array<boolean>, n_tokens array<long>, score array<double>, place binary, hashes binary, counts binary"
#: For a tree that is asked by shuffle: each token's start, and grams in bucket order, with those of each distinct token.
ASKS = BLOCKS + ", starts binary, start binary, grams binary, rest binary, width binary"


def _starts(t: Symbols) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Places of words and ends, their first symbols, and these in one number with those of the word before."""
    # the first symbols of a word, which depend on the word before; 0 after the boundary and for the end
    heads = np.concatenate([t.p, t.ends])
    seen = [t.x[heads]]
    for j in range(1, DEPTH - 1):
        goes_on = (seen[-1] > 0) & (seen[-1] != 0x20)
        seen.append(np.where(goes_on, t.x[np.minimum(heads + j, len(t.x) - 1)], 0))
    start = np.zeros(len(heads), np.uint64)
    for byte in (*[t.x[heads - j] for j in range(2, DEPTH + 1)], *seen):
        start = (start << np.uint64(8)) | byte
    return heads, seen, start


def _opening(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of distinct starts, and which start each belongs to."""
    byte = [(start >> np.uint64(8 * k)) & np.uint64(255) for k in range(2 * DEPTH - 3, -1, -1)]
    before, seen = [np.full(len(start), 0x20, np.uint64), *byte[: DEPTH - 1]], byte[DEPTH - 1 :]
    keys, of = [], []
    for j in range(DEPTH - 1):
        key = np.zeros(len(start), np.uint64)
        for x in (*[*seen[:j][::-1], *before][:DEPTH], seen[j]):
            key = (key << np.uint64(8)) | x
        used = np.flatnonzero(seen[j] > 0) if j else np.arange(len(start))
        keys.append(key[used]), of.append(used)
    return np.concatenate(keys), np.concatenate(of)


def _rest(t: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each token's word, how many grams depend on a word alone, and these."""
    known, index, word = np.unique(t.hash, return_index=True, return_inverse=True)
    size, p = np.maximum(t.size[index] - DEPTH + 2, 0), t.p[index]
    spread = np.repeat(p + DEPTH - 1, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    return known, word, size, t.keys(spread)


def _block_scores(tree: Tree, t: Symbols) -> np.ndarray:
    """log10 probability of each text of a block."""
    heads, seen, start = _starts(t)
    _, first, of = np.unique(start, return_index=True, return_inverse=True)
    place = heads[first]
    opening = tree.score(t.keys(place))
    for j in range(1, DEPTH - 1):
        used = seen[j][first] > 0
        opening[used] += tree.score(t.keys(place[used] + j))
    known, word, size, grams = _rest(t)
    keys, back = np.unique(grams, return_inverse=True)
    rest = np.bincount(np.repeat(np.arange(len(known)), size), tree.score(keys)[back], len(known)) if len(known) else np.zeros(0)
    each = np.concatenate(([0.0], np.cumsum(opening[of[: t.n_words]] + rest[word])))
    return each[t.at[1:]] - each[t.at[:-1]] + opening[of[t.n_words :]]


def _block_row(block: int, parts: list[tuple]) -> pa.RecordBatch:
    """One row for the texts of some blocks, with their distinct tokens in the order of hashes."""
    ids, held = pa.concat_arrays([x[0] for x in parts]), pa.concat_arrays([x[1] for x in parts])
    n, score, token = (np.concatenate([x[j] for x in parts]) for j in (2, 3, 4))
    known, place = np.unique(token, return_inverse=True)
    trained = np.repeat(~np.asarray(held.to_numpy(zero_copy_only=False), bool), n)
    counts = np.bincount(place[trained], minlength=len(known)).astype(np.int64)
    at = np.array([0, len(n)])
    blob = lambda v: pa.array([v.tobytes()], pa.binary())
    asks = [blob(v) for v in _block_asks(known, [x[5] for x in parts])] if parts[0][5] else []
    return pa.RecordBatch.from_arrays(
        [pa.array([block], pa.int64()), lists(ids, at), lists(held, at), lists(pa.array(n), at), lists(pa.array(score), at), blob(place.astype(np.int32)), blob(known), blob(counts), *asks],
        names=[c.split()[0] for c in (ASKS if asks else BLOCKS).split(", ")],
    )


def _bucket_hash(grams: np.ndarray) -> np.ndarray:
    """A hash of the TOP nearest symbols."""
    return mix(grams >> np.uint64(8 * (DEPTH - TOP) + 8))


def _part_asks(t: Symbols) -> tuple:
    """Each token's start, and the grams that depend on a word alone."""
    _, _, start = _starts(t)
    known, _, size, grams = _rest(t)
    return np.insert(start[: t.n_words], t.at[1:], start[t.n_words :]), known, size, grams


def _block_asks(known: np.ndarray, parts: list[tuple]) -> list[np.ndarray]:
    starts, start = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    word, size, rest = (np.concatenate([x[j] for x in parts]) for j in (1, 2, 3))
    _, first = np.unique(word, return_index=True)
    at, width = np.cumsum(size) - size, size[first]
    rest = rest[np.repeat(at[first], width) + np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)]
    grams = np.unique(np.concatenate([_opening(starts)[0], rest]))
    order = np.argsort(_bucket_hash(grams), kind="stable")
    to = np.empty(len(grams), np.int32)
    to[order] = np.arange(len(grams), dtype=np.int32)
    each = np.zeros(len(known), np.int32)
    each[np.searchsorted(known, word[first])] = width
    return [starts, start.astype(np.int32), grams[order], to[np.searchsorted(grams, rest)], each]


def _joined(row: dict, n: np.ndarray, place: np.ndarray, score: np.ndarray) -> np.ndarray:
    """log10 probability of each text of a block from those of its grams."""
    starts, start, grams, rest, width = (np.frombuffer(row[c], k) for c, k in (("starts", np.uint64), ("start", np.int32), ("grams", np.uint64), ("rest", np.int32), ("width", np.int32)))
    order = np.argsort(grams)
    keys, of = _opening(starts)
    opening = np.bincount(of, score[order[np.searchsorted(grams, keys, sorter=order)]], len(starts))
    word = np.bincount(np.repeat(np.arange(len(width)), width), score[rest], len(width))
    return np.add.reduceat(opening[start] + word[place], np.cumsum(n) - n)


def _scored(tree: Tree | None):
    def run(batches):
        part, nth, parts, held_bytes = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            for a, b in blocks(off, BLOCK):
                t = Symbols(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                tokens = np.insert(t.hash, t.at[1:], END)  # every text's words, then its end
                parts.append((batch.column("id").slice(a, b - a), batch.column("held").slice(a, b - a), np.diff(t.at) + 1, _block_scores(tree, t) if tree else np.zeros(b - a), tokens, () if tree else _part_asks(t)))
                held_bytes += int(off[b] - off[a])
                if held_bytes >= ASKED:
                    yield _block_row((part << 32) + nth, parts)
                    nth, parts, held_bytes = nth + 1, [], 0
        if parts:
            yield _block_row((part << 32) + nth, parts)

    return run


def _asked(bits: int):
    def run(batches):
        for batch in batches:
            for block, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "counts")), strict=True):
                h, n = np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)
                cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([n[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())],
                    names=["bucket", "block", "hashes", "counts"],
                )

    return run


def _answered(batches):
    """Rows come sorted by bucket. A bucket's counts are summed, and every block gets those of its words."""

    def close(bucket, rows):
        known, at = np.unique(np.concatenate([np.frombuffer(h, np.uint64) for _, h, _ in rows]), return_inverse=True)
        total = np.bincount(at, np.concatenate([np.frombuffer(n, np.int64) for _, _, n in rows]), len(known)).astype(np.int64)
        ends = np.cumsum([len(h) // 8 for _, h, _ in rows])
        out = [total[at[e - len(h) // 8 : e]].tobytes() for e, (_, h, _) in zip(ends.tolist(), rows, strict=True)]
        once = [0] * (len(rows) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([b for b, _, _ in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(out, pa.binary()), pa.array([int(total.sum()), *once], pa.int64()), pa.array([int((total > 0).sum()), *once], pa.int64())],
            names=["block", "bucket", "counts", "tokens", "kinds"],
        )

    key, rows = None, []
    for batch in batches:
        for bucket, block, h, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "hashes", "counts")), strict=True):
            if bucket != key and rows:
                yield close(key, rows)
                rows = []
            key = bucket
            rows.append((block, h, n))
    if rows:
        yield close(key, rows)


def _gram_asks(bits: int):
    def run(batches):
        for batch in batches:
            for block, grams in zip(*(batch.column(c).to_pylist() for c in ("block", "grams")), strict=True):
                g = np.frombuffer(grams, np.uint64)
                cut = np.searchsorted(_bucket_hash(g) >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), pa.array([g[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([b""] * len(some), pa.binary())],
                    names=["bucket", "block", "grams", "counts"],
                )

    return run


def _dealt(bits: int):
    """Entries of the deeper contexts by bucket; minus the depth stands for a block, so that they come before what is asked."""

    def close(d, key, n):
        for depth in range(TOP, DEPTH + 1):
            k, c = key[d == depth], n[d == depth]
            bucket = mix(k >> np.uint64(8 * (depth - TOP) + 8)) >> np.uint64(64 - bits)
            order = np.argsort(bucket, kind="stable")
            k, c, cut = k[order], c[order], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([-depth] * len(some), pa.int64()), pa.array([k[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary()), pa.array([c[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())],
                names=["bucket", "block", "grams", "counts"],
            )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([batch.column("d").to_numpy(), batch.column("key").to_numpy().view(np.uint64), batch.column("n").to_numpy()])
            size += batch.num_rows
            if size >= 1_000_000:
                yield from close(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from close(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _gram_scores(top: dict[int, tuple[np.ndarray, np.ndarray]]):
    """Rows come sorted by bucket, its entries first."""

    def run(batches):
        key, tree, deep = None, None, {}
        for batch in batches:
            for bucket, block, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "grams", "counts")), strict=True):
                if bucket != key:
                    key, tree, deep = bucket, None, {}
                g = np.frombuffer(grams, np.uint64)
                if block < 0:
                    deep.setdefault(-block, []).append((g, np.frombuffer(counts, np.int64)))
                    continue
                tree = tree or Tree(top | {d: tuple(map(np.concatenate, zip(*x, strict=True))) for d, x in deep.items()})
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([tree.score(g).tobytes()], pa.binary())], names=["block", "bucket", "scores"])

    return run


RESULT = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _based(tokens: int, kinds: int):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                replies = sorted(batch.column("replies")[r].as_py(), key=lambda x: x["bucket"])
                c = np.concatenate([np.frombuffer(x["counts"], np.int64) for x in replies])
                place = np.frombuffer(batch.column("place")[r].as_py(), np.int32)
                n = batch.column("n_tokens")[r].values.to_numpy()
                at = np.concatenate(([0], np.cumsum(n)))
                score = batch.column("score")[r].values
                if "scores" in batch.schema.names:
                    got = sorted(batch.column("scores")[r].as_py(), key=lambda x: x["bucket"])
                    row = {x: batch.column(x)[r].as_py() for x in ("starts", "start", "grams", "rest", "width")}
                    score = pa.array(_joined(row, n, place, np.concatenate([np.frombuffer(x["scores"]) for x in got])))
                unit = np.log10((c + 0.1) / (tokens + 0.1 * (kinds + 1)))
                base = np.add.reduceat(unit[place], at[:-1])
                known = np.add.reduceat((c > 0).astype(np.int64)[place], at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[r].values, batch.column("held")[r].values, pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens)), pa.array(base), score],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return run


def scored(docs: DataFrame, held: F.Column, id: str = "doc_id", text: str = "text", most: int = HELD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; learns where `held` is false."""
    workers(docs.sparkSession)
    plain = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(held, F.lit(True)).alias("held"), text_of(text).alias("text"))
    states = retained(plain.where(~F.col("held")).select("text"))
    whole = states.count() <= most
    told = staged(plain.mapInArrow(_scored(Tree(_by_depth(states)) if whole else None), BLOCKS if whole else ASKS), "op1-blocks", "zstd")
    bits = max(6, int(told.count() - 1).bit_length() if told.count() else 6)
    asked = told.select("block", "hashes", "counts").mapInArrow(_asked(bits), "bucket int, block long, hashes binary, counts binary")
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    answers = staged(asked.mapInArrow(_answered, "block long, bucket int, counts binary, tokens long, kinds long"), "op1-answers")
    total = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("v")).first()
    replies = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))
    both = told.select("block", "id", "held", "n_tokens", "score", "place", *(() if whole else ("starts", "start", "grams", "rest", "width"))).join(replies, "block")
    if not whole:
        kinds = "bucket int, block long, grams binary, counts binary"
        grams = told.select("block", "grams").mapInArrow(_gram_asks(bits), kinds).unionByName(states.where(F.col("d") >= TOP).mapInArrow(_dealt(bits), kinds))
        grams = grams.repartition("bucket").sortWithinPartitions("bucket", "block")
        scores = staged(grams.mapInArrow(_gram_scores(_by_depth(states.where(F.col("d") < TOP))), "block long, bucket int, scores binary"), "op1-scores")
        both = both.join(scores.groupBy("block").agg(F.collect_list(F.struct("bucket", "scores")).alias("scores")), "block")
    return both.drop("block").mapInArrow(_based(int(total.n), int(total.v)), RESULT).withColumnRenamed("id", id)


def op1_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)


QUERIES = {"op1_suffix_tree_scores": op1_suffix_tree_scores}
SQL: dict = {}
