"""Which texts hold which short strings, by an index of character n-grams instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import staged
from .retrieval import small

#: Lengths of n-grams.
SIZES = (1, 2, 4, 8, 16, 32)
#: Rows up to which hashes of n-grams, and strings with one n-gram each, are broadcast.
GRAM_ROWS, BEST_ROWS = 1_000_000, 400_000


def _grams(c: Column, n: int) -> Column:
    """The distinct n-grams of a text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def _hashes(c: Column, sizes: list[int]) -> Column:
    return F.explode(F.transform(F.concat(*[_grams(c, n) for n in sizes]), lambda x: F.xxhash64(x))).alias("gram")


def containing(texts: DataFrame, needles: DataFrame, id: str = "id", text: str = "text", needle_id: str = "needle_id", needle: str = "needle") -> DataFrame:
    """(id, needle_id), once each, of texts that hold a string, as it is written. Ids may repeat: then one of their texts will do.

    A string is known by the hashes of its n-grams of the largest size up to its length. Of these, the one that fewest texts have finds its candidates.
    Candidates are compared in full where the text is read, so that only what holds a string goes further; where there are too many strings to be sent
    to all texts, hashes are exchanged instead, and texts of candidates after. If the strings are many and longer than the texts together, those whose
    first or last n-gram no text has go first. Null or empty strings are in nothing; null texts hold nothing."""
    length = F.lit(SIZES[0])
    for n in SIZES[1:]:
        length = F.when(F.char_length("needle") >= n, n).otherwise(length)
    asked = needles.select(F.col(needle_id).alias("needle_id"), F.col(needle).alias("needle")).where("needle <> ''").distinct().withColumn("n", length)
    asked = staged(asked, "asked")
    found = asked.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.char_length("needle")).alias("chars")).collect()
    sizes = sorted(r.n for r in found) or [SIZES[0]]
    held = texts.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    if sum(r.rows for r in found) > BEST_ROWS and (held.agg(F.sum(F.char_length("text"))).first()[0] or 0) < sum(r.chars for r in found):
        there = small(staged(held.select(_hashes(F.col("text"), sizes)).distinct(), "there"), GRAM_ROWS)
        for at in (F.lit(1), F.char_length("needle") - F.col("n") + 1):
            asked = asked.join(there, F.xxhash64(F.substr("needle", at, F.col("n"))) == F.col("gram"), "left_semi")
        asked = staged(asked, "asked")
    own = None
    for n in sizes:
        part = asked.where(F.col("n") == n).select("needle_id", "needle", _hashes(F.col("needle"), [n]))
        own = part if own is None else own.unionByName(part)
    own = staged(own, "needles")
    wanted = small(own.select("gram").distinct(), GRAM_ROWS)
    grams = _hashes(F.col("text"), sizes)
    count = held.select(grams).join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rarest = F.row_number().over(Window.partitionBy("needle_id", "needle").orderBy(F.coalesce("df", F.lit(0)), "gram"))
    best = staged(own.join(count, "gram", "left").withColumn("nth", rarest).where("nth = 1 and df > 0").select("needle_id", "needle", "gram"), "best")
    if best.count() <= BEST_ROWS:
        pairs = held.select("id", "text", grams).join(F.broadcast(best), "gram")
    else:
        pairs = held.select("id", grams).join(wanted, "gram", "left_semi").join(best, "gram").select("id", "needle_id", "needle").distinct()
        pairs = pairs.withColumnRenamed("id", "of").join(held, F.col("of").eqNullSafe(F.col("id")))
    return pairs.where(F.contains("text", "needle")).select(F.col("id").alias(id), F.col("needle_id").alias(needle_id)).distinct()


def alias_key(c: Column) -> Column:
    """Lower case without spaces, hyphens and underscores."""
    return F.lower(F.regexp_replace(c, r"[\s_-]", ""))


def aliases(one: DataFrame, two: DataFrame, a: str = "one", b: str = "two") -> DataFrame:
    """(a, b), once each, of names of which one is the other or is inside it, from two characters of their keys on."""
    left = staged(one.select(F.col(a).alias("id"), alias_key(F.col(a)).alias("key")).where(F.char_length("key") >= 2), "one")
    right = staged(two.select(F.col(b).alias("id"), alias_key(F.col(b)).alias("key")).where(F.char_length("key") >= 2), "two")
    inside = containing(left, right.withColumnRenamed("id", "other"), "id", "key", "other", "key")
    around = containing(right, left.withColumnRenamed("id", "other"), "id", "key", "other", "key")
    return inside.select(F.col("id").alias(a), F.col("other").alias(b)).union(around.select("other", "id")).distinct()
