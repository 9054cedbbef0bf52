"""Vector code compression (operator 11): product codes by exact k-means in integers, with exponion search.

Components become integers floor(SCALE * x); a vector is cut into PARTS consecutive parts, and each part position has a codebook of
up to ENTRIES integer entries, at first those parts of the vectors with the smallest ids. A round assigns every part to its nearest entry
and replaces each entry by the floored mean of its parts.

The search for the nearest entry starts at the entry that the part had before, at squared distance D. Any entry nearer than that, or as near, is
within twice the distance from it by the triangle inequality, so only entries with a squared distance of at most 4 D from the
starting entry are looked at: a prefix of its list of neighbours sorted by distance, found by bisection. All is integer arithmetic, so ties are
exact and go to the lower index, and the result does not depend on where the search starts. A part without an entry before
starts at the entry that is nearest to the part of the row above it.

Vectors stay where they are: each round is one pass over the partitions that keeps codes next to the rows in a staged table, with
sums per part and entry added up per task first, so only 16 x 64 of them a task are shuffled. Codebooks (at most PARTS x ENTRIES
entries) are all that the driver sees.

Rows whose vector is null or holds a null, NaN or infinite component are dropped. Components beyond LIMIT in size count as
LIMIT, so that squares fit 64 bits. Vectors have the length of the kept vector with the smallest id; others are dropped, as they have no place in
its codebooks. A length that isn't a multiple of PARTS is cut as evenly as floors allow; a part of no components has distance 0. Null ids come
last, repeated ids are ordered by the bytes of their vectors, and each row gets its own code. With fewer than ENTRIES rows the codebooks have fewer
entries; an empty table gives no rows. A sum that doesn't fit 64 bits is null. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged, workers

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 1 << 24
#: (part, entry) pairs compared at once; sums of labels that are broadcast at most.
PAIRS, SMALL_ROWS = 1 << 18, 400_000


def cuts(dimension: int, parts: int = PARTS) -> list[int]:
    return [k * dimension // parts for k in range(parts + 1)]


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


class Book:
    """The entries of one part position, and for each the others sorted by (distance, index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        d = entries[:, None, :] - entries[None, :, :]
        far = np.einsum("ijk,ijk->ij", d, d)
        self.order = np.argsort(far, axis=1, kind="stable")
        self.far = np.take_along_axis(far, self.order, 1)

    def assign(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row of x; start: the entry to search from."""
        radius = 4 * squared(x, self.entries[start])
        # the length of the prefix of the neighbours within the radius, by bisection in all lists at once
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.far.shape[1], np.int64)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            inside = open_ & (self.far[start, np.minimum(mid, self.far.shape[1] - 1)] <= radius)
            low, high = np.where(inside, mid + 1, low), np.where(open_ & ~inside, mid, high)
        ends = np.cumsum(low)
        best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        a = 0
        while a < len(x):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            n = low[a:b]
            row = np.repeat(np.arange(a, b), n)
            begin = np.cumsum(n) - n
            entry = self.order[start[row], np.arange(len(row)) - np.repeat(begin, n)]
            d = squared(x[row], self.entries[entry])
            least[a:b] = np.minimum.reduceat(d, begin)
            best[a:b] = np.minimum.reduceat(np.where(d == np.repeat(least[a:b], n), entry, len(self.entries)), begin)
            a = b
        return best, least


def _started(book: Book, x: np.ndarray) -> np.ndarray:
    """Where to search from without an entry before: what is nearest to the first row."""
    return np.full(len(x), int(squared(book.entries, x[:1]).argmin()), np.int64)


def _whole(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("ints").to_pylist()), np.int32).reshape(batch.num_rows, dimension).astype(np.int64)


def _ints(vector: str):
    """Rows with whole vectors: their components as 32-bit integers in one binary value."""

    def run(batches):
        for batch in batches:
            column = batch.column(vector)
            n = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
            values = column.flatten().cast(pa.float64())
            x = values.to_numpy(zero_copy_only=False)  # nulls become NaN
            n = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, n)
            at = np.concatenate(([0], np.cumsum(n)))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            keep = (bad[at[1:]] == bad[at[:-1]]) & ~column.is_null().to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(np.clip(np.nan_to_num(x) * SCALE, -LIMIT, LIMIT)).astype(np.int32)
            rows = np.flatnonzero(keep)
            told = [whole[at[i] : at[i + 1]].tobytes() for i in rows.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)), pa.array(told, pa.binary())], names=["id", "label", "ints"])

    return run


def _coded(books: list[np.ndarray], dimension: int):
    """Codes, and the sum of the squared distances, of rows that may have codes already."""

    def run(batches):
        held, at = [Book(x) for x in books], cuts(dimension, len(books))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch, dimension)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(len(x), -1) if "code" in batch.schema.names else None
            code, error = np.empty((len(x), len(books)), np.uint16), np.zeros(len(x), np.int64)
            for k, book in enumerate(held):
                part = x[:, at[k] : at[k + 1]]
                code[:, k], d = book.assign(part, _started(book, part) if old is None else old[:, k].astype(np.int64))
                error += d
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "label", "ints")], pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error)], names=["id", "label", "ints", "code", "error"])

    return run


def _summed(parts: int, entries: int, dimension: int):
    """(part, entry, count, sums) of a task."""

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((entries, dimension), np.int64)
        at = cuts(dimension, parts)
        for batch in batches:
            if batch.num_rows:
                x = _whole(batch, dimension)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(len(x), -1)
                for k in range(parts):
                    count[k] += np.bincount(code[:, k], minlength=entries)
                    order = np.argsort(code[:, k], kind="stable")
                    there = np.flatnonzero(np.bincount(code[:, k], minlength=entries))
                    begin = np.searchsorted(code[order, k], there)
                    total[there, at[k] : at[k + 1]] += np.add.reduceat(x[order, at[k] : at[k + 1]], begin, axis=0)
        k, e = np.nonzero(count)
        told = [total[j, at[i] : at[i + 1]].tolist() for i, j in zip(k.tolist(), e.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(e, pa.int32()), pa.array(count[k, e]), pa.array(told, pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _means(rows: DataFrame, books: list[np.ndarray], dimension: int) -> list[np.ndarray]:
    parts, entries = len(books), len(books[0])
    told = rows.select("ints", "code").mapInArrow(_summed(parts, entries, dimension), "part int, entry int, n long, sums array<long>")
    width = -(-dimension // parts)
    sums = [F.sum(F.get("sums", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
    out = [x.copy() for x in books]
    for r in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts x entries rows
        book = out[r.part]
        book[r.entry] = [int(x) // r.n for x in r[3 : 3 + book.shape[1]]]
    return out


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code as binary of 16-bit indexes, error) of each kept row, staged, and the final codebooks, one array of entries for each part."""
    spark = vectors.sparkSession
    workers(spark)
    plain = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kinds = {c: plain.schema[c].dataType.simpleString() for c in ("id", "label")}
    rows = staged(plain.mapInArrow(_ints("vector"), f"id {kinds['id']}, label {kinds['label']}, ints binary"), "op11-ints")
    by_id = [F.col("id").asc_nulls_last(), "ints"]
    first = rows.orderBy(*by_id).limit(1).collect()
    if not first:
        return rows.withColumns({"code": F.lit(b""), "error": F.lit(0).cast("long")}).drop("ints"), []
    dimension, base = len(first[0].ints) // 4, rows
    rows = rows.where(F.length("ints") == 4 * dimension)
    smallest = rows.orderBy(*by_id).limit(entries).collect()
    seeds = np.array([np.frombuffer(r.ints, np.int32) for r in smallest], np.int64).reshape(len(smallest), dimension)
    at = cuts(dimension, parts)
    books = [seeds[:, at[k] : at[k + 1]] for k in range(parts)]
    schema = f"id {kinds['id']}, label {kinds['label']}, ints binary, code binary, error long"
    made = rows
    for _ in range(rounds):
        now = staged(made.mapInArrow(_coded(books, dimension), schema), "op11-round")
        discard(base if made is rows else made)
        made = now
        books = _means(made, books, dimension)
    final = staged(made.mapInArrow(_coded(books, dimension), schema).drop("ints"), "op11-codes")
    if made is not rows:
        discard(made)
    return final, books


def codes(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, code in hex, error, label_error, codebooks_sha256) of each kept row."""
    rows, books = compressed(vectors, id, vector, label)
    text = F.lower(F.hex("code"))  # 16-bit indexes, low byte first
    hexes = F.concat(*[F.substring(text, 4 * k + 1, 2) for k in range(PARTS)])
    sums = staged(rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s")).select(F.col("label").alias("of"), F.expr("try_cast(s as bigint)").alias("label_error")), "op11-labels", narrow=True)
    side = F.broadcast(sums) if sums.count() <= SMALL_ROWS else sums
    out = rows.join(side, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id), hexes.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    return codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """Squared distances to all entries, three times; the tables' vectors have 64 components."""
    width = 64 // PARTS
    at = range(width)
    parts = f"SELECT vec_id, p, {', '.join(f'v[{width} * p + {j + 1}] AS x{j}' for j in at)} FROM %s, range({PARTS}) r(p)"
    mean = lambda j: f"CAST((s{j} - ((s{j} % n) + n) % n) // n AS BIGINT)"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT x.vec_id, x.p, min(({' + '.join(f'(x{j} - e{j}) * (x{j} - e{j})' for j in at)}) * {ENTRIES} + entry) AS m FROM parts x JOIN b{r} b ON b.p = x.p GROUP BY x.vec_id, x.p)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT p, m % {ENTRIES} AS entry, count(*) AS n, {', '.join(f'sum(x{j}) AS s{j}' for j in at)} FROM a{r} JOIN parts USING (vec_id, p) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.entry, {', '.join(f'coalesce({mean(j)}, e{j}) AS e{j}' for j in at)} FROM b{r} b LEFT JOIN s{r} s ON s.p = b.p AND s.entry = b.entry)")
    return f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED ({parts % 'kept'}),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < {ENTRIES}),
b0 AS MATERIALIZED (SELECT p, entry, {', '.join(f'x{j} AS e{j}' for j in at)} FROM parts JOIN seeds USING (vec_id)),
{(chr(10) + ',').join(steps)},
told AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
book AS (SELECT sha256(string_agg({" || ',' || ".join(f'e{j}' for j in at)}, ',' ORDER BY p, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM told JOIN kept USING (vec_id), book"""


QUERIES = {"op11_vector_codes": op11_vector_codes}
SQL = {"op11_vector_codes": _sql()}
