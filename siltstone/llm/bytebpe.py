"""Byte-level BPE encoding and decoding (operator 5).

1. Pre-tokenisation without a regex. A block of texts becomes arrays of code points and of their
   classes (letter, number, space, other). What a code point does by itself is seen from shifted copies of
   the class array: a class change starts a token, a plain space joins the token after it, the last of a run of spaces
   is parted from the others. What remains depends on the state of an automaton: whether a contraction ('s 't 're 've
   'm 'll 'd) has two letters to go, one, or has just ended, when a letter starts a token. Each code point is a
   transition function of these four states, packed in a byte; composing functions is associative, so a block's
   states come from a scan: within rows of a matrix, over the rows' totals, and back.
2. Pair merging. The byte slices are looked up in a bounded cache; a miss merges pairs by rank,
   leftmost lowest first, with a heap for long slices.
3. Each token's byte offset is retained; decoding joins the vocabulary's bytes of the ids.

Null text counts as empty and gives no tokens. Special tokens are never made. Texts of any length are
handled whole; repeated rows each get their own result, empty tables give empty results, and other columns pass through; one
with the name of a result comes out as in_<name>.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, as_bytes, blocks, workers

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Slices that a worker remembers; the cache starts anew beyond.
CACHE = 400_000
#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    first = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = SPACE
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the byte that each starts at."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at]
    cp = lead.astype(np.int32)
    for low, high, n, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        wide = np.flatnonzero((lead >= low) & (lead < high)) if high < 0x100 else np.flatnonzero(lead >= low)
        if len(wide):
            x = (lead[wide] & bits).astype(np.int32)
            for j in range(1, n):
                x = (x << 6) | (buf[at[wide] + j] & 0x3F)
            cp[wide] = x
    return cp, at


#: States: in a run, two letters of a contraction to go, one to go, just ended. A transition function has two bits for each.
RUN, TWO, ONE, DONE = range(4)


def _packed(to: list[int]) -> int:
    return sum(t << (2 * s) for s, t in enumerate(to))


#: What most code points do; what an apostrophe before a short or a long ending does, where it starts a token; the start of a text.
PLAIN, SHORT, LONG, FIRST = _packed([RUN, ONE, DONE, RUN]), _packed([ONE, ONE, DONE, ONE]), _packed([TWO, ONE, DONE, TWO]), _packed([RUN] * 4)


@lru_cache(1)
def composition() -> np.ndarray:
    """after[f << 8 | g]: the function that applies f, then g."""
    f, g = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    out = np.zeros((256, 256), np.int64)
    for s in range(4):
        out |= (g >> (2 * ((f >> (2 * s)) & 3)) & 3) << (2 * s)
    return out.astype(np.uint8).ravel()


def scanned(f: np.ndarray, width: int = 64) -> np.ndarray:
    """For each place the composition of all functions up to it."""
    n = len(f)
    if n <= 1:
        return f.copy()
    after = composition()
    rows = -(-n // width)
    m = np.full(rows * width, _packed([0, 1, 2, 3]), np.uint8)
    m[:n] = f
    m = np.ascontiguousarray(m.reshape(rows, width).T)
    for j in range(1, width):
        m[j] = after[m[j - 1].astype(np.uint16) << 8 | m[j]]
    if rows > 1:
        before = scanned(m[-1, :-1], width).astype(np.uint16) << 8
        m[:, 1:] = after[before[None, :] | m[:, 1:]]
    return np.ascontiguousarray(m.T).ravel()[:n]


def token_starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each code point whether a token starts there; first marks each text's first code point."""
    n = len(cp)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[cp]
    space = kind == SPACE
    inner = ~first  # the code point before is of the same text
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = inner[1:]
    last_space = np.zeros(n, bool)  # a space, and a non-space follows in the text
    last_space[:-1] = space[:-1] & ~space[1:] & inner[1:]
    change, glued = np.ones(n, bool), np.zeros(n, bool)
    change[1:] = kind[1:] != kind[:-1]
    glued[1:] = (cp[:-1] == 0x20) & ~space[1:]
    own = first | np.where(space, change | last_space, change & ~glued)  # by class alone
    # an apostrophe that starts a token may open a contraction
    f = np.full(n, PLAIN, np.uint8)
    quote = np.flatnonzero((cp == 0x27) & own & goes_on)
    one = cp[np.minimum(quote + 1, n - 1)]
    two = np.where(goes_on[np.minimum(quote + 1, n - 1)], cp[np.minimum(quote + 2, n - 1)], 0)
    e, l, r, v = (ord(c) for c in "elrv")
    f[quote[((two == e) & ((one == r) | (one == v))) | ((one == l) & (two == l))]] = LONG
    f[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    f[first] = composition()[FIRST << 8 | f[first].astype(np.uint16)]
    state = scanned(f) & 3  # from the state RUN
    before = np.full(n, RUN, np.uint8)
    before[1:] = state[:-1]
    before[first] = RUN
    return np.where((before == TWO) | (before == ONE), False, own | ((before == DONE) & (kind == LETTER)))


class Merger(dict):
    """slice -> ids. Misses are merged by rank and remembered."""

    def __init__(self, ranks: dict[bytes, int], most: int = CACHE):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        rank = self.ranks.get(piece)
        got = (rank,) if rank is not None else (self._short(piece) if len(piece) <= 48 else self._long(piece))
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = got
        return got

    def _short(self, piece: bytes) -> tuple[int, ...]:
        get, far = self.ranks.get, 1 << 40
        ends = list(range(len(piece) + 1))
        rank = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while rank:
            low = min(rank)
            if low == far:
                break
            i = rank.index(low)
            del ends[i + 1], rank[i]
            if i < len(rank):
                rank[i] = get(piece[ends[i] : ends[i + 2]], far)
            if i:
                rank[i - 1] = get(piece[ends[i - 1] : ends[i + 1]], far)
        return tuple(self.ranks[piece[a:b]] for a, b in zip(ends, ends[1:], strict=False))

    def _long(self, piece: bytes) -> tuple[int, ...]:
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or after[j] != end:
                continue
            live[j] = False
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        return tuple(self.ranks[piece[i : after[i]]] for i in range(n) if live[i])


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(4)
def merger(path: str) -> Merger:
    return Merger(load_ranks(path))


@lru_cache(4)
def vocabulary(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        out[i] = piece
    return out


@lru_cache(4)
def numerals(path: str) -> list[str]:
    return [str(i) for i in range(len(vocabulary(path)))]


def encode_block(buf: np.ndarray, off: np.ndarray, path: str) -> list[list[int]]:
    """The ids of each text of a block."""
    cp, at = code_points(buf)
    first = np.zeros(len(cp), bool)
    heads = off[:-1][off[:-1] < off[1:]]
    first[np.searchsorted(at, heads)] = True
    cut = at[token_starts(cp, first)]
    body, bounds = buf.tobytes(), [*cut.tolist(), len(buf)]
    get = merger(path).__getitem__
    ids = [get(body[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]
    rows = np.searchsorted(cut, off).tolist()
    return [list(chain.from_iterable(ids[a:b])) for a, b in zip(rows, rows[1:], strict=False)]


def decode(ids: list[int], path: str) -> bytes:
    vocab = vocabulary(path)
    return b"".join([vocab[i] for i in ids])


def token_offsets(ids: list[int], path: str) -> list[int]:
    """The byte of the text that each token starts at."""
    vocab, at, out = vocabulary(path), 0, []
    for i in ids:
        out.append(at)
        at += len(vocab[i])
    return out


def _run(path: str, what: str):
    def run(batches):
        names = numerals(path)
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            others = [c for c in batch.schema.names if c != "text"]
            for a, b in blocks(off):
                kept = [batch.column(c).slice(a, b - a) for c in others]
                ids = encode_block(buf[off[a] : off[b]], off[a : b + 1] - off[a], path)
                if what == "digests":
                    more = {
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                        "ids_sha256": pa.array([hashlib.sha256(",".join([names[i] for i in x]).encode()).hexdigest() for x in ids], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(decode(x, path)).hexdigest() for x in ids], pa.string()),
                    }
                else:
                    more = {"ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array([token_offsets(x, path) for x in ids], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_arrays([*kept, *more.values()], names=[*others, *more])

    return run


KINDS = {"digests": "n_tokens long, ids_sha256 string, decoded_sha256 string", "tokens": "ids array<int>, offsets array<int>"}


def encoded(docs: DataFrame, path: str, keep: list[str], text: str = "text", what: str = "tokens") -> DataFrame:
    """Per row: the columns in `keep` with ids and byte offsets (what="tokens"), or with digests of ids and decoded bytes."""
    workers(docs.sparkSession)
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    names = apart(keep, [x.split()[0] for x in KINDS[what].split(", ")])
    return plain.mapInArrow(_run(path, what), ", ".join([*kinds, KINDS[what]])).withColumnsRenamed({f"k{i}": c for i, c in enumerate(names)})


def _decode_run(path: str):
    def run(batches):
        for batch in batches:
            others = [c for c in batch.schema.names if c != "ids"]
            out = pa.array([None if x is None else decode(x, path) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], out], names=[*others, "decoded"])

    return run


def decoded(tokens: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """Per row of a table with `ids`: the columns in `keep` and the bytes that the ids stand for."""
    workers(tokens.sparkSession)
    kinds = [f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep]
    return tokens.select(*keep, "ids").mapInArrow(_decode_run(path), ", ".join([*kinds, "decoded binary"]))


def multi_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), multi_path(), ["doc_id"], what="digests")


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
SQL: dict = {}
