"""Language identification by error-correcting output codes (operator 10).

Each language has a codeword; one binary classifier per bit, linear in hashed n-grams of bytes within
words, predicts it. Decoding sums, over the bits, the loss of the classifier's margin against each
codeword, weighted by how reliable the bit was in training, and takes the nearest codeword. When the
runner-up is close the row is flagged as ambiguous.

Learning looks at text and language only, of about SAMPLE training rows of each language and TOTAL in all (those whose
hash of the id falls in a share SAMPLE / rows of the language): documented bounds, after which more rows
hardly move the weights of so few features. Predictions read every whole text. n-grams are looked up once per distinct word of a
block and summed over the words of a text. No exchange of texts is needed.

Null text, and text without a letter: `und` with score 0. Rows with null language or id are predicted but not
learnt from; without any row to learn from all texts are `und`. With one language, all others are it.
Ties go to the language that sorts first. Repeated rows each get their own result; other columns pass, one with the name of a
result as in_<name>.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, as_bytes, blocks, lowered, mix, prefix_hash, slice_hash, words, workers

#: Rows that are learnt from: of each language, and in all (each row is FEATURES numbers on the driver, and the solver's matrix
#: is the square of the rows). With more than TOTAL / SAMPLE languages each gets its share of TOTAL.
SAMPLE, TOTAL = 300, 3000
FEATURES = 1 << 13
SCALE, RIDGE, CLOSE = 60.0, 1.0, 0.2
NONE = "und"
_A = np.uint64(0x9FB21C651E98DF25)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1 with distinct columns that tell languages apart; the best of some drawn by a fixed rule."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    most = (1 << min(n - 1, 12)) - 1
    bits = min(most, max(15, 5 * int(np.ceil(np.log2(n)))))
    if bits == most:
        return np.array([[1 if r == 0 or not (c + 1) >> (r - 1) & 1 else -1 for c in range(bits)] for r in range(n)], np.int8)
    rng, best, found = np.random.default_rng(7), -1, None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        if (abs(code.sum(0)) == n).any() or len(np.unique(code * code[:1], axis=1).T) < bits:
            continue
        far = min(int((code[i] != code[i + 1 :]).sum(1).min()) for i in range(n - 1))
        if far > best:
            best, found = far, code
    return found if found is not None else rng.choice(np.array([-1, 1], np.int8), (n, bits))


def word_grams(buf: np.ndarray, off: np.ndarray):
    """(features, word of each, distinct word of each word, n + 1 offsets of texts' words): the n-grams of the block's distinct words."""
    low = lowered(buf)
    s, e, at = words(low, off)
    h = slice_hash(prefix_hash(low), s, e)
    _, index, word = np.unique(h, return_index=True, return_inverse=True)
    s, size = s[index], (e - s)[index]
    ends = np.cumsum(size + 2)
    x = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(ends - size - 1, size) + inside] = low[np.repeat(s, size) + inside]
    of = np.repeat(np.arange(len(s)), size + 2)
    lead = ends - size - 2  # the boundary before each word
    keep = np.ones(len(x), bool)
    keep[lead] = False
    one = np.flatnonzero(keep)
    keep[lead + 1] = False
    three = np.flatnonzero(keep)
    parts = [(x[one], 1), (x[one - 1] << np.uint64(8) | x[one], 2), (x[three - 2] << np.uint64(16) | x[three - 1] << np.uint64(8) | x[three], 3)]
    feature = np.concatenate([mix(v * _A + np.uint64(k)) >> np.uint64(64 - 13) for v, k in parts]).astype(np.int64)
    return feature, np.concatenate([of[one], of[one], of[three]]), word, at


def _has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 0x20) >= 97) & ((buf | 0x20) <= 122)
    count = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = count[off[1:]] > count[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])).tolist():
        out[i] = any(unicodedata.category(c)[0] == "L" for c in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


class Model:
    """Languages, codewords, and weights of the bits' classifiers."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """What each bit's classifier says of each text."""
        feature, of, word, at = word_grams(buf, off)
        bits = self.code.shape[1]
        n = int(of.max()) + 1 if len(of) else 0
        value = np.stack([np.bincount(of, self.weights[feature, j], n) for j in range(bits)] + [np.bincount(of, minlength=n)], 1)
        total = np.concatenate((np.zeros((1, bits + 1)), np.cumsum(value[word], 0)))
        total = total[at[1:]] - total[at[:-1]]
        return total[:, :bits] / np.maximum(total[:, bits:], 1) * SCALE + self.bias

    def decode(self, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score from 0 to 1, ambiguous) by loss-weighted decoding."""
        n = len(self.langs)
        if n == 1:
            return np.zeros(len(margin), int), np.ones(len(margin)), np.zeros(len(margin), bool)
        loss = np.stack([(self.trust * np.log1p(np.exp(-4 * np.clip(self.code[c] * margin, -8, 8)))).sum(1) for c in range(n)], 1)
        best = loss.argmin(1)
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        score = 1 / odds.sum(1)
        second = np.partition(loss, 1, 1)[:, 1]
        return best, score, second - loss.min(1) < CLOSE * self.trust.sum()


def _vectors(batches):
    for batch in batches:
        buf, off = as_bytes(batch.column("text"))
        langs, out = batch.column("lang").to_pylist(), []
        for i in range(len(langs)):
            feature, of, word, _ = word_grams(buf[off[i] : off[i + 1]], off[i : i + 2] - off[i])
            times = np.bincount(word) if len(word) else np.zeros(0, int)
            x = np.bincount(feature, times[of] if len(of) else None, FEATURES)
            out.append((x / max(x.sum(), 1)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "x"])


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """Learns from about `sample` rows of each language; None if there is nothing to learn from."""
    workers(docs.sparkSession)
    rows = docs.select(F.col(lang).alias("lang"), F.xxhash64(F.col(id)).alias("h"), F.col(text).alias("text")).where(F.col(id).isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # hashes are even, so a share of them that depends on the language's count keeps about `sample` rows: nothing is ranked
    size = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    lot = F.col("h") / F.lit(2.0**64) + 0.5
    sample = min(sample, max(TOTAL // max(size.count(), 1), 1))
    got = rows.join(size, "lang").where(lot * F.col("n") < sample).select("lang", "text").mapInArrow(_vectors, "lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.lang, bytes(r.x)))
    langs = sorted({r.lang for r in got})
    code = codewords(len(langs))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]) * np.float32(SCALE)
    which = np.array([langs.index(r.lang) for r in got])
    if not code.shape[1]:
        return Model(langs, code, np.zeros((FEATURES, 0)), np.zeros(0), np.zeros(0))
    y = code[which].astype(float)
    each = 1 / np.bincount(which)[which]  # languages weigh the same
    mean, middle = (each[:, None] * x).sum(0) / each.sum(), (each[:, None] * y).sum(0) / each.sum()
    z = (x - mean) * np.sqrt(each)[:, None]
    dual = np.linalg.solve(z @ z.T + RIDGE * np.eye(len(z)) * np.trace(z @ z.T) / len(z) * 0.01, (y - middle) * np.sqrt(each)[:, None])
    weights = z.T @ dual
    bias = middle - mean @ weights
    right = ((x @ weights + bias) * y > 0).mean(0)
    trust = np.log((right * len(y) + 1) / ((1 - right) * len(y) + 1))
    return Model(langs, code, weights, bias, np.maximum(trust, 0.01) / max(trust.max(), 0.01))


def _predicted(model: Model | None):
    def run(batches):
        for batch in batches:
            buf, off = as_bytes(batch.column("text"))
            others = [c for c in batch.schema.names if c != "text"]
            for a, b in blocks(off):
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                n = b - a
                letter = _has_letter(part, o) if model else np.zeros(n, bool)
                best, score, close = model.decode(model.margins(part, o)) if model else (np.zeros(n, int), np.zeros(n), np.zeros(n, bool))
                names = [model.langs[i] if ok else NONE for i, ok in zip(best.tolist(), letter.tolist(), strict=True)] if model else [NONE] * n
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(a, n) for c in others], pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(close | ~letter)],
                    names=[*others, "lang_pred", "score", "ambiguous"],
                )

    return run


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Per row: the columns in `keep`, lang_pred, score and ambiguous."""
    workers(docs.sparkSession)
    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    kinds = [f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    out = plain.mapInArrow(_predicted(model), ", ".join([*kinds, "lang_pred string, score double, ambiguous boolean"]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(apart(keep, ["lang_pred", "score", "ambiguous"]))})


def op10_language_codes(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0)
    return predict(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"])


QUERIES = {"op10_language_codes": op10_language_codes}
SQL: dict = {}
