"""What the operators of this subpackage share: stable storage between stages, byte-level
word location and hashing, and a hash table lookup.

Texts reach Python as Arrow batches. They are looked at as one array of UTF-8 bytes with
offsets, so that word boundaries and hashes of a whole batch take a few numpy calls.
"""

from __future__ import annotations

import atexit
import contextvars
import gc
import os
import re
import shutil
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Texts of an Arrow batch are handled in blocks of about so many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19
#: Words are runs of anything else.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset, a temporary one if
    all run in this process (tests); on a cluster that is an error, as executors would not see each other's files."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if got:
        return got.rstrip("/")
    context = spark.sparkContext
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder there that driver and executors share")
    if context.applicationId not in _OWN:
        _OWN[context.applicationId] = tempfile.mkdtemp(prefix="siltstone-")
        atexit.register(shutil.rmtree, _OWN[context.applicationId], True)
    return f"file://{_OWN[context.applicationId]}"


def workers(spark: SparkSession) -> None:
    """Lets Python workers import this package where it isn't installed but on a path that they can read, and keeps their batches small."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # the default; texts are long
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


class Run:
    """The staged folders of one run. Inside `with Run(spark) as run:` what this thread stages belongs to the run, which alone may
    delete it: other runs, and frames made outside of any, keep theirs until the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def __enter__(self) -> Run:
        self._before = _RUN.set(self)
        return self

    def __exit__(self, *_) -> None:
        _RUN.reset(self._before)

    def sweep(self, keep: int = 0) -> int:
        """Deletes the folders staged so far but for the last `keep`; call it when the results made from them are stored. Returns how many."""
        gone = self.folders[: len(self.folders) - keep]
        del self.folders[: len(gone)]
        return sum(_delete(self.spark, x) for x in gone)


_RUN: contextvars.ContextVar[Run | None] = contextvars.ContextVar("run", default=None)
_OUTSIDE: dict[int, Run] = {}


def _run(spark: SparkSession) -> Run:
    """The run that this thread is in; outside of any, one that holds what the thread has staged so."""
    return _RUN.get() or _OUTSIDE.setdefault(threading.get_ident(), Run(spark))


def sweep(spark: SparkSession, keep: int = 0) -> int:
    """`Run.sweep` of the run that this thread is in."""
    run = _run(spark)
    run.spark = spark
    return run.sweep(keep)


def _delete(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, of the run that this thread is in; what no one has deleted goes with the session."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _run(spark).folders.append(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def staged(df: DataFrame, name: str, codec: str = "snappy", narrow: bool = False) -> DataFrame:
    """Writes to the shared folder and reads again: lineage ends there, and lost executors cost one stage only.

    zstd pays for large columns; its native contexts are too dear for very many small files. narrow: the rows are a few
    numbers each and cheap to make, so two files for each core will do, however many partitions there are."""
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(2 * spark.sparkContext.defaultParallelism)
    at = folder(spark, name)
    df.write.option("compression", codec).parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.staged_at = at
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `staged` wrote for these; nothing that is still to be computed may read them."""
    for df in frames:
        run = _run(df.sparkSession)
        if df.staged_at in run.folders:
            run.folders.remove(df.staged_at)
        _delete(df.sparkSession, df.staged_at)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of steps whose results are staged: Spark deletes them when the driver's heap is collected, which
    may otherwise be late. On a cluster the scheduler still holds the job that ran last, so a job of one row comes first."""
    spark.range(1, numPartitions=1).count()
    gc.collect()
    spark._jvm.System.gc()


def text_of(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


# --- bytes ---------------------------------------------------------------------------------


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges whose texts take about `most` bytes together."""
    at, n = 0, len(off) - 1
    while at < n:
        to = int(np.searchsorted(off, off[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.ones(256, bool)
_SOLID[list(SPACES)] = False


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[buf]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and n + 1 offsets of each text's words. Words never cross texts."""
    n = len(off) - 1
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    solid = _SOLID[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = solid[heads]
    ends = heads[1:] - 1
    last[ends] = solid[ends]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


_RNG = np.random.default_rng(20240229)
#: Fixed random values of the 256 bytes, and an odd base with its inverse modulo 2**64.
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, BLOCK_BYTES + 1024), base, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if n <= 4 * BLOCK_BYTES:
            _POWERS[base] = got
    return got[:n]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """h with h[i] the sum of value(b[k]) * base**k over k < i, modulo 2**64."""
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * _powers(_BASE, len(buf)), out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer slices are hashed by pieces of so many bytes: modulo 2**64 a polynomial of degree 1023 has long words that collide for
#: every base (alternations like the Thue-Morse word and its complement), one of degree 63 has not.
PIECE = 64
_C, _D = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _short_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((h[e] - h[s]) * _powers(_INVERSE, len(h))[s] + (e - s).astype(np.uint64) * _C)


def slice_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices [s, e): the same for equal bytes wherever they are."""
    long = np.flatnonzero(e - s > PIECE)
    if not len(long):
        return _short_hash(h, s, e)
    out = _short_hash(h, s, np.minimum(e, s + PIECE))
    a, b = s[long], e[long]
    n = -(-(b - a) // PIECE)
    at = np.cumsum(n) - n
    nth = np.arange(int(n.sum())) - np.repeat(at, n)
    start = np.repeat(a, n) + nth * PIECE
    part = mix(_short_hash(h, start, np.minimum(start + PIECE, np.repeat(b, n))) ^ (nth.astype(np.uint64) * _D))
    out[long] = mix(np.add.reduceat(part, at) + (b - a).astype(np.uint64) * _C)
    return out


def apart(keep: list[str], results: list[str]) -> list[str]:
    """Names for kept columns beside result columns: one that has a result's name comes out as in_<name>."""
    return [f"in_{c}" if c in results else c for c in keep]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
