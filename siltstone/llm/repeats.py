"""Removal of repeated byte strings after prefix-free parsing (operator 3).

A byte is removed when a string of LENGTH = 400 bytes covers it that also starts anywhere else, in
the same or another text. Strings never cross texts and are judged on the input. Other lengths can be
asked for, several at once: PASSAGE = 200 bytes is what nearly all passages of 50 words have.

1. Parsing. A rolling hash of 16 bytes triggers a phrase boundary: for every string start, the
   trigger is the least rolling hash among the next SPAN places, which depends on the string alone.
   Starts with the same trigger form a phrase; all their strings hold the bytes after the trigger that the
   shortest length leaves (the core). A string can only repeat where its core does, so phrases with a
   core that occurs once in the corpus are dropped at once; in ordinary text that leaves little.
2. Dictionary. Of the other phrases, the distinct extents (core, and what the phrase's strings hold
   left and right of it) are counted; a phrase with its context that occurs twice is repeated as a whole.
3. Order. The suffix array of the dictionary's contexts, built by doubling to the depth that a string
   needs, gives each start its rank; with the core and the place in it that is the order of the strings.
   A string is repeated when its neighbour in that order is equal. The order is made per core, batch by
   batch: strings with different cores can't be equal, so no order of the whole corpus has to be in
   one place. A core with over FEW extents is split: starts at about the same distance from the trigger have
   a longer core in common, so they form extents of their own, in bands of 16 starts and then of one,
   where counting is all that is left to do. Cores and extents meet by 64-bit fingerprints, both together
   128 bits wide, as are those of texts.

All exchanges are by core or by (core, extent) with counts added up before they are sent; a core that
very many texts share meets as its distinct extents only. Texts longer than a block are parsed in
overlapping pieces, so memory is bounded by the block.

Null text counts as empty. Texts under the length lose nothing. Repeated rows are copies: both lose all
their bytes from that length on. A null id only means that copies with null ids travel together. Empty
tables give empty results. Other columns pass through untouched; in `digests`, one with the name of a
result comes out as in_<name>.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _INVERSE, BLOCK_BYTES, _powers, apart, as_bytes, blocks, discard, lists, mix, prefix_hash, release, signed, slice_hash, staged, text_of, workers

LENGTH, PASSAGE, ROLL, SPAN = 400, 200, 16, 128
#: Extents of a core that are ordered in one place; widths of the bands that a larger one is split into.
FEW, WIDTHS = 256, (16, 1)
#: Extents whose contexts a task remembers to have sent.
SEEN = 1 << 17
#: Hot cores up to which their list is broadcast; more are joined by shuffle.
SMALL_ROWS = 400_000
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


class Shape:
    """Lengths in rising order, and what follows from the shortest: how far a trigger is looked for, and the core."""

    def __init__(self, lengths: tuple[int, ...]):
        self.lengths = tuple(sorted(lengths))
        self.least, self.most, self.span = self.lengths[0], self.lengths[-1], SPAN
        if any(n % 8 for n in self.lengths) or self.least < 64:
            raise ValueError("lengths are multiples of 8, from 64 on")
        while self.span + ROLL + 40 > self.least:
            self.span //= 2
        self.core = self.least - self.span - ROLL


def phrases(buf: np.ndarray, off: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(first start, last start, trigger, text) of each phrase, and the prefix hash. Places count from the start of buf."""
    n, none = len(buf), np.zeros(0, np.int64)
    if n < shape.least:
        return none, none, none, none, np.zeros(1, np.uint64)
    h = prefix_hash(buf)
    rolled = mix((h[ROLL:] - h[:-ROLL]) * _powers(_INVERSE, n - ROLL + 1))
    least = (rolled & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rolled), dtype=np.uint64)
    step = 1
    while step < shape.span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    lens = np.diff(off)
    far = np.repeat(off[1:] - shape.least, lens)[: len(least)]
    i = np.flatnonzero(np.arange(len(far)) <= far)
    if not len(i):
        return none, none, none, none, h
    t = (least[i] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((t[1:] != t[:-1]) | (i[1:] != i[:-1] + 1)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(i) - 1]))
    a, b = i[first], i[last]
    return a, b, t[first], np.searchsorted(off, a, "right") - 1, h


def _pieces(buf: np.ndarray, off: np.ndarray, most: int):
    """(rows, bytes, offsets, place in the text of byte 0, strings that start in it): blocks of whole texts, or pieces
    of a long one that overlap by a string of the greatest length."""
    for x, y in blocks(off):
        lo, hi = int(off[x]), int(off[y])
        if y - x > 1 or hi - lo <= 2 * BLOCK_BYTES:
            yield x, y, buf[lo:hi], off[x : y + 1] - lo, 0, hi - lo
            continue
        for at in range(lo, hi, BLOCK_BYTES):
            to = min(hi, at + BLOCK_BYTES + most - 1)
            yield x, y, buf[at:to], np.array([0, to - at]), at - lo, min(BLOCK_BYTES, hi - at)


def _cores(shape: Shape):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            keys = batch.column("k1").to_numpy()
            for x, _, part, o, _, starts in _pieces(buf, off, shape.most):
                a, _, t, d, h = phrases(part, o, shape)
                t, d = t[a < starts], d[a < starts]
                yield pa.RecordBatch.from_arrays([pa.array(keys[x + d]), pa.array(signed(slice_hash(h, t, t + shape.core)))], names=["k1", "core"])

    return run


EXTENT = "core long, extent long, copies long, lead int, starts int, context binary"
RUNS = f"k1 long, k2 long, at int, {EXTENT}"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _living(a, b, begin, once, length: int, n: int, shape: Shape) -> np.ndarray:
    """For each place of n the last start up to it (-1: none) whose string of `length` may be repeated. It can't be if a string of
    the shortest length inside it has a core that occurs once: a copy of the whole holds a copy of that one. (It must be a string
    inside: a window that reaches over its end may make no phrase in the copy, whose text may end there.)"""
    lo = np.maximum(begin, a - (length - shape.least))[once]
    hi = b[once]
    some = lo <= hi
    dead = np.cumsum(np.bincount(lo[some], minlength=n + 1) - np.bincount(hi[some] + 1, minlength=n + 1))[:n] > 0
    return np.maximum.accumulate(np.where(dead, -1, np.arange(n)))


def _next(last: np.ndarray) -> np.ndarray:
    """For each place the first living start from it on."""
    n = len(last)
    own = np.where(last == np.arange(n), last, 2 * n)
    return np.minimum.accumulate(own[::-1])[::-1]


def _fresh(core: np.ndarray, extent: np.ndarray, seen: set[bytes]) -> np.ndarray:
    """Which phrases are the first of their extent; seen: gets them, and starts anew beyond SEEN, which costs space only."""
    order = np.lexsort((extent, core))
    pairs = np.stack([core, extent], 1)[order]
    first = np.ones(len(order), bool)
    first[1:] = (pairs[1:] != pairs[:-1]).any(1)
    keys = pairs[first].view("V16").ravel().tolist()
    new = np.array([x not in seen for x in keys], bool)
    if len(seen) > SEEN:
        seen.clear()
    seen.update(keys)
    out = np.zeros(len(core), bool)
    out[order[first][new]] = True
    return out


def _contexts(part: np.ndarray, a: np.ndarray, lead: np.ndarray, width: np.ndarray, core: int, fresh: np.ndarray) -> pa.Array:
    """Of the fresh phrases what their strings hold, without the core; null for others. Made for some phrases at a time, as places
    take eight times the bytes."""
    width = np.where(fresh, width, 0)
    ends = np.cumsum(width)
    body = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for x in range(0, len(a), 512):
        w = width[x : x + 512]
        lo, hi = int(ends[x] - width[x]), int(ends[min(x + 512, len(a)) - 1])
        inside = np.arange(lo, hi) - np.repeat(ends[x : x + 512] - w, w)
        body[lo:hi] = part[np.repeat(a[x : x + 512], w) + inside + np.where(inside >= np.repeat(lead[x : x + 512], w), core, 0)]
    offsets, valid = np.concatenate(([0], ends)).astype(np.int32), np.packbits(fresh, bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(a), [pa.py_buffer(valid), pa.py_buffer(offsets), pa.py_buffer(body)])


def _runs(shape: Shape):
    """The phrases with a core in `cores`; context: what their strings hold, without the core. The first of an extent brings it for
    all that the task meets."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            k1, k2, copies = (batch.column(c).to_numpy() for c in ("k1", "k2", "copies"))
            flat, at = batch.column("cores").flatten().to_numpy(), np.concatenate(([0], np.cumsum(batch.column("cores").value_lengths().to_numpy())))
            for x, y, part, o, moved, begin in _pieces(buf, off, shape.most):
                a, b, t, d, h = phrases(part, o, shape)
                core = signed(slice_hash(h, t, t + shape.core))
                twice = np.isin(core, flat[at[x] : at[y]])
                last = [_living(a, b, o[:-1][d], ~twice, n, len(part), shape) for n in shape.lengths]
                b = np.minimum(b, begin - 1)
                keep = twice & (a <= b)
                a, b, t, d, core = a[keep], b[keep], t[keep], d[keep], core[keep]
                a, b = _next(last[0])[a], last[0][b]  # from the first to the last start that may be repeated
                keep = a <= b
                a, b, t, d, core = a[keep], b[keep], t[keep], d[keep], core[keep]
                stop = b + shape.least
                for living, n in zip(last[1:], shape.lengths[1:], strict=True):
                    stop = np.maximum(stop, np.where(living[b] >= a, living[b] + n, 0))
                stop = np.minimum(stop, o[1:][d])
                extent = signed(mix(slice_hash(h, a, stop) + (t - a).astype(np.uint64) * _B + (b - a).astype(np.uint64) * _A))
                del last, h
                context = _contexts(part, a, t - a, (t - a) + (stop - t - shape.core), shape.core, _fresh(core, extent, seen))
                ints = lambda v: pa.array(v.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[x + d]), pa.array(k2[x + d]), ints(t - o[d] + moved), pa.array(core), pa.array(extent), pa.array(copies[x + d]), ints(t - a), ints(b - a + 1), context],
                    names=_names(RUNS),
                )

    return run


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The ranks of tuples of ranks; as many as 63 bits hold are compared at once."""
    out, bits, each = parts[0], 0, 1 + int(max(int(p.max(initial=0)) for p in parts)).bit_length()
    bits = each
    for part in parts[1:]:
        if bits + each > 63:
            out = np.unique(out, return_inverse=True)[1]
            bits = 1 + len(out).bit_length()
        out = (out << each) | part
        bits += each
    return np.unique(out, return_inverse=True)[1]


def suffix_ranks(buf: np.ndarray, wanted: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """For each (places, depth) the order of the suffixes of buf at these places by their first `depth` bytes; equal ones share
    a rank. The suffix array is built by joining ranks of 8 bytes to ranks of 24 and of 72; ranks of the depths that are asked for
    join these, overlapping at the end."""
    n = len(buf)
    b = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | b[j : n + j]
    rank, least = {8: np.unique(key, return_inverse=True)[1]}, min(depth for _, depth in wanted)
    for w in (24, 72):
        if w <= least:
            then = lambda by: np.concatenate([rank[w // 3][by:], np.zeros(min(by, n), np.int64)])[:n]  # noqa: B023, E731
            rank[w] = _joined([rank[w // 3], then(w // 3), then(2 * (w // 3))])
    top = max(rank)
    return [_joined([rank[top][at + by] for by in [*range(0, depth - top, top), depth - top]]) if len(at) else at for at, depth in wanted]


def _found_schema(n: int) -> str:
    return ", ".join(["core long, extent long", *[f"spans_{k} array<int>" for k in range(n)]])


def _runs_of(again: np.ndarray, of: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(extent, first and last start counted from the trigger) of each run of repeated starts."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (again * (of + 1)).astype(np.int64), [0]))) != 0)
    lo = edge[edge < len(again)]
    lo = lo[again[lo]]
    hi = edge[edge > 0] - 1
    hi = hi[again[hi]]
    return of[lo], np.stack([-left[lo], -left[hi]], 1).astype(np.int32)


def _ranked(core, extent, copies, lead, starts, context, common: int, depths: dict[int, int], n: int) -> pa.RecordBatch:
    """For whole cores: the repeated starts of each extent. common: bytes of the core; depths: of the n lengths those asked for, by
    their number."""
    _, off = as_bytes(context)
    size = np.diff(off)
    # a core without an extent that occurs once is settled: all starts of its extents are repeated
    which = np.cumsum(np.concatenate(([True], core[1:] != core[:-1]))) - 1
    open_ = (np.bincount(which, copies == 1) > 0)[which]
    some, done = np.flatnonzero(open_), np.flatnonzero(~open_)
    buf, off = as_bytes(context.take(pa.array(some)))
    wanted = []
    for length in depths.values():
        # starts whose string ends within the context
        fit = np.clip(size - (length - common) + 1, 0, starts)
        of = [np.repeat(x, fit[x]) for x in (done, some)]
        step = [np.arange(len(o)) - np.repeat(np.cumsum(fit[x]) - fit[x], fit[x]) for o, x in zip(of, (done, some), strict=True)]
        at = np.repeat(off[:-1], fit[some]) + step[1]
        wanted.append((at, length - common, of, step))
    # the suffix array of the dictionary's contexts; with core and split it orders the strings themselves
    ranks = suffix_ranks(buf, [(at, depth) for at, depth, _, _ in wanted]) if len(some) else [None] * len(wanted)
    spans, any_ = {}, np.zeros(len(core), bool)
    for nth, (_, _, of, step), rank in zip(depths, wanted, ranks, strict=True):
        left = [lead[o] - x for o, x in zip(of, step, strict=True)]
        got = [_runs_of(np.ones(len(of[0]), bool), of[0], left[0])]
        if rank is not None and len(rank):
            order = np.lexsort((rank, which[of[1]] * 1024 + left[1] + 512))
            same, r, c, place = np.zeros(len(order), bool), rank[order], which[of[1]][order], left[1][order]
            same[1:] = (r[1:] == r[:-1]) & (place[1:] == place[:-1]) & (c[1:] == c[:-1])
            same[:-1] |= same[1:]
            again = copies[of[1]] > 1
            again[order] |= same
            got.append(_runs_of(again, of[1], left[1]))
        extents, pairs = (np.concatenate(x) for x in zip(*got, strict=True))
        spans[nth] = np.bincount(extents, minlength=len(core)) * 2, pairs[np.argsort(extents, kind="stable")].ravel()
        any_ |= spans[nth][0] > 0
    none = np.zeros(len(core), np.int64), np.zeros(0, np.int32)
    columns = [lists(pa.array(v), np.concatenate(([0], np.cumsum(k[any_])))) for k, v in (spans.get(k, none) for k in range(n))]
    return pa.RecordBatch.from_arrays([pa.array(core[any_]), pa.array(extent[any_]), *columns], names=_names(_found_schema(n)))


def _order(common: int, depths: dict[int, int], n: int):
    def run(batches):
        """Rows come sorted by core; the last core of a batch waits for the next one. A core has FEW extents at most."""
        held = None
        names = ("core", "extent", "copies", "lead", "starts")
        ranked = lambda t: _ranked(*(t[c].to_numpy() for c in names), t["context"], common, depths, n)
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            core = table["core"].to_numpy()
            cut = int(np.flatnonzero(core == core[-1])[0]) if len(core) else 0
            held = (table.slice(cut).combine_chunks().to_batches() or [None])[0]
            at = 0
            while at < cut:  # whole cores of about so many rows at once
                to = min(at + 3072, cut)
                to = cut if to == cut else int(np.searchsorted(core[:cut], core[to], "left"))
                to = to if to > at else int(np.searchsorted(core[:cut], core[at], "right"))
                yield ranked(table.slice(at, to - at))
                at = to
        if held is not None and held.num_rows:
            yield ranked(pa.Table.from_batches([held]))

    return run


BANDED = f"from_core long, from_extent long, nth int, {EXTENT}"


def _banded(shape: Shape, common: int, width: int):
    """Splits extents, for each length asked for, into bands of `width` starts at the same distance from the trigger. What all
    strings of a band hold is the new core. Extents come with nth (null: all lengths)."""

    def run(batches):
        for batch in batches:
            rows = []
            for core, extent, nth, copies, lead, starts, context in zip(*(batch.column(c).to_pylist() for c in ("core", "extent", "nth", *_names(EXTENT)[2:])), strict=True):
                for k in range(len(shape.lengths)) if nth is None else [nth]:
                    length = shape.lengths[k]
                    fit = min(starts, len(context) - (length - common) + 1)
                    for band in range((lead - fit + 1) // width, lead // width + 1) if fit > 0 else ():
                        far, near = min(lead, band * width + width - 1), max(lead - fit + 1, band * width)
                        right = lead + length - common
                        body = context[lead - far : right - near]
                        inner = context[lead - band * width : right - band * width - width + 1]
                        names = hashlib.blake2b(inner, digest_size=8, salt=b"%d,%d" % (k, band), key=core.to_bytes(8, "little", signed=True)), hashlib.blake2b(body, digest_size=8, salt=b"%d,%d" % (far, near))
                        rows.append((core, extent, k, *(int.from_bytes(x.digest(), "little", signed=True) for x in names), copies, far, far - near + 1, body))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=_names(BANDED))

    return run


def _cut(lengths: tuple[int, ...], text_too: bool):
    """Reads spans_0, spans_1 ... of the lengths in rising order; the last one's strings are removed."""
    spans_of = [f"spans_{k}" for k in range(len(lengths))]

    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            found = [batch.column(c).to_pylist() for c in spans_of]
            rows = []
            for i in range(batch.num_rows):
                body = buf[off[i] : off[i + 1]]
                ranges = [merged(f[i] or [], n) for f, n in zip(found, lengths, strict=True)]
                gone = ranges[-1]
                left = np.ones(len(body), bool)
                for a, b in gone:
                    left[a:b] = False
                if text_too:
                    rows.append([whole_characters(body, gone) if gone else body.tobytes().decode("utf-8", "replace")])
                    continue
                more = [x for r in ranges[:-1] for x in (sum(b - a for a, b in r), len(r))]
                rows.append([len(body), int(len(body) - left.sum()), len(gone), hashlib.sha256(body[left].tobytes()).hexdigest(), *more])
            names = ["text"] if text_too else ["n_bytes", "n_removed", "n_spans", "kept_sha256", *_passage_names(lengths)]
            kinds = [pa.string()] if text_too else [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * (2 * len(lengths) - 2)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            others = [c for c in batch.schema.names if c not in ("text", *spans_of)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *[pa.array(x, k) for x, k in zip(columns, kinds, strict=True)]], names=[*others, *names])

    return run


def _passage_names(lengths: tuple[int, ...]) -> list[str]:
    return [x for n in lengths[:-1] for x in ((f"n_repeated_{n}", f"n_passages_{n}"))]


def merged(found: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [a, b) covered by the strings that start in ranges given as first, last, first, last ..."""
    out: list[list[int]] = []
    for at in sorted(zip(found[::2], found[1::2], strict=True)):
        if out and at[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], at[1] + length)
        else:
            out.append([at[0], at[1] + length])
    return [(a, b) for a, b in out]


def whole_characters(body: np.ndarray, gone: list[tuple[int, int]]) -> str:
    """The text without the ranges; a character that a range holds in part stays whole."""
    left = np.ones(len(body), bool)
    for a, b in gone:
        while a < b and (int(body[a]) & 0xC0) == 0x80:
            a += 1
        while b > a and b < len(body) and (int(body[b]) & 0xC0) == 0x80:
            b -= 1
        left[a:b] = False
    return body[left].tobytes().decode("utf-8", "replace")


def _keys(text: str) -> list[F.Column]:
    """128 bits that stand for a text."""
    t = text_of(text)
    return [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit("second"), t).alias("k2")]


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("lead", "starts", "context")]
    return rows.groupBy("core", "extent", *by).agg(F.sum("copies").alias("copies"), *first)


def _ordered(runs: DataFrame, shape: Shape, made: list[DataFrame]) -> DataFrame:
    """(core, extent, spans_0, ...) of the extents with repeated starts; made: gets the tables that were staged for it."""
    depths, n = dict(enumerate(shape.lengths)), len(shape.lengths)
    level, links = staged(_counted(runs).withColumn("nth", F.lit(None).cast("int")), "op3-extents", "zstd"), []
    made.append(level)
    release(runs.sparkSession)
    spans = [f"spans_{k}" for k in range(n)]

    def settle(rows: DataFrame) -> DataFrame:
        got = None
        for some in [{k: x} for k, x in depths.items()] if links else [depths]:
            part = rows.where(F.col("nth").isin(*some)) if links else rows
            part = part.select(*_names(EXTENT)).repartition("core").sortWithinPartitions("core").mapInArrow(_order(shape.core, some, n), _found_schema(n))
            got = part if got is None else got.unionByName(part)
        for link in reversed(links):
            got = got.join(link, ["core", "extent"]).select(F.col("from_core").alias("core"), F.col("from_extent").alias("extent"), *spans)
        return got

    parts = []
    for width in WIDTHS:
        wide = staged(level.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW).select("core"), "op3-wide", narrow=True)
        many = wide.count()
        release(runs.sparkSession)
        if not many:
            break
        side = F.broadcast(wide) if many <= SMALL_ROWS else wide
        parts.append(settle(level.join(side, "core", "left_anti")))
        bands = level.join(side, "core", "left_semi").mapInArrow(_banded(shape, shape.core, width), BANDED)
        bands = staged(bands, "op3-bands", "zstd")
        links.append(bands.select("core", "extent", "from_core", "from_extent"))
        level = staged(_counted(bands, "nth"), "op3-extents", "zstd")
        made += [bands, level]
    parts.append(settle(level))
    if len(parts) == 1:
        return parts[0]
    # bands of one extent come together again, so that the texts' phrases meet a row each
    split = parts[1] if len(parts) == 2 else parts[1].unionByName(parts[2])
    return parts[0].unionByName(split.groupBy("core", "extent").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in spans]))


def repeated(docs: DataFrame, text: str = "text", id: str | None = None, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """(k1, k2, spans_0, ...) of each distinct text with repeated strings: for each length, in rising order, first and last
    start of each run of them, one after the other.

    `id` tells copies apart, so that only one of them has to be sent on; without it all go to one place."""
    spark, shape = docs.sparkSession, Shape(lengths)
    workers(spark)
    who = F.coalesce(F.col(id).cast("string"), F.lit("")) if id else F.lit("")
    keyed = docs.select(*_keys(text), who.alias("who"), text_of(text).alias("text")).where(F.octet_length("text") >= shape.least)
    cores = staged(keyed.select("k1", "text").mapInArrow(_cores(shape), "k1 long, core long"), "op3-cores", "zstd")
    # written first, so that the join's two sides are plain exchanges and a very common core can be split
    twice = staged(cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), "op3-twice")
    hits = cores.join(twice, "core").groupBy("k1").agg(F.collect_set("core").alias("cores"))
    # one row of each text by its least id: with the id in the join's key, copies are dealt out evenly
    one = keyed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min("who").alias("who")).join(hits, "k1")
    held = keyed.join(one, ["k1", "k2", "who"]).select("k1", "k2", "text", "cores", "copies")
    runs = staged(held.mapInArrow(_runs(shape), RUNS), "op3-phrases", "zstd")
    discard(cores, twice)
    release(spark)
    made = [runs]
    found = runs.select("k1", "k2", "at", "core", "extent").join(_ordered(runs, shape, made), ["core", "extent"])
    names = [f"spans_{k}" for k in range(len(shape.lengths))]
    placed = found.select("k1", "k2", *[F.transform(c, lambda x: x + F.col("at")).alias(c) for c in names])
    spans = staged(placed.groupBy("k1", "k2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in names]), "op3-spans", narrow=True)
    discard(*made)
    release(spark)
    return spans


def _with_spans(docs: DataFrame, text: str, id: str | None, lengths: tuple[int, ...]) -> DataFrame:
    spans = repeated(docs, text, id, lengths)
    k1, k2 = _keys(text)
    return docs.withColumns({"k1": k1, "k2": k2}).join(spans, ["k1", "k2"], "left").drop("k1", "k2")


def _processed(docs: DataFrame, keep: list[str], text: str, id: str | None, lengths: tuple[int, ...], text_too: bool, schema: str) -> DataFrame:
    lengths = tuple(sorted(lengths))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = [f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    return _with_spans(plain, "text", f"c{keep.index(id)}" if id else None, lengths).mapInArrow(_cut(lengths, text_too), ", ".join([*kinds, schema]))


def digests(docs: DataFrame, keep: list[str], text: str = "text", lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """Per row: the columns in `keep` (the first tells copies apart), n_bytes, and, for the greatest length, n_removed, n_spans
    and kept_sha256; for each shorter one, n_repeated_<length> bytes that its strings cover and n_passages_<length> runs of them."""
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *_passage_names(tuple(sorted(lengths)))]
    schema = ", ".join(f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in results)
    out = _processed(docs, keep, text, keep[0] if keep else None, lengths, False, schema)
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(apart(keep, results))})


def removed(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs with the repeated strings cut from their text; characters stay whole. Null texts come out empty."""
    others = [c for c in docs.columns if c != text]
    out = _processed(docs, others, text, id, (length,), True, "text string")
    return out.withColumnsRenamed({f"c{i}": c for i, c in enumerate(others)} | {"text": text}).select(*docs.columns)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and bytes and runs of repeated strings of PASSAGE bytes."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"], lengths=(PASSAGE, LENGTH))


QUERIES = {"op3_suffix_array_dedup": op3_suffix_array_dedup}
SQL: dict = {}
