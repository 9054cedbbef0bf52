"""Token counts as delta-maintained rollups (operator 4).

A change inserts a document's count, deletes it, or revises it (new minus old). A batch of changes is
reduced to signed deltas per (source, language, tokenizer version), with a map-side combine, so a source
with a third of all rows costs one row per task. A batch has its own folder, named by its id, and is
committed by Spark's writer: a batch that is sent again finds itself committed and adds nothing, and one
that failed half-way is written anew. Totals are sums over the committed batches and additive over
every grouping; compaction folds batches into one base without changing any total.

Within a batch a change that occurs twice (same change_id) counts once: if its rows differ, the least by kind, source, language,
tokenizer and counts. Texts of any length are counted whole. Other columns are ignored. Null source, language and
version are groups of their own; null counts are 0; a null change_id can't be told from another and
counts each time. An empty batch commits as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, folder, staged, text_of

KEYS = ["source", "lang", "tokenizer"]
KINDS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """Totals kept under a folder that all executors share. The driver holds the names of batches since the last compaction only;
    those folded into a base stay in a table. One writer at a time, and no reader while it compacts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, path: str) -> bool:
        fs, at = self._fs(path)
        return fs.exists(at)

    def _batches(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/batches")
        if not fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if self._exists(f"{self.path}/batches/{x.getPath().getName()}/_SUCCESS"))

    def _bases(self) -> list[str]:
        fs, at = self._fs(f"{self.path}/bases")
        if not fs.exists(at):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(at) if self._exists(f"{self.path}/bases/{x.getPath().getName()}/_SUCCESS"))

    def _folded(self) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.path}/bases/{self._bases()[-1]}/folded")

    def committed(self, batch: str) -> bool:
        if self._exists(f"{self.path}/batches/{batch}/_SUCCESS"):
            return True
        bases = self._bases()
        return bool(bases) and self.spark.read.parquet(f"{self.path}/bases/{bases[-1]}/folded").where(F.col("batch") == batch).limit(1).count() > 0

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """changes: change_id, kind (insert, delete, revise), source, lang, tokenizer, tokens, old_tokens. False if already committed."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        bases = self._bases()
        folded: set[str] = set()
        parts = []
        if bases:
            parts.append(self.spark.read.schema(KINDS).parquet(f"{self.path}/bases/{bases[-1]}/totals"))
            names = self.spark.createDataFrame([(b,) for b in self._batches()], "batch string")
            folded = {r.batch for r in names.join(self._folded(), "batch", "left_semi").collect()}  # of those whose folders are still there
        live = [f"{self.path}/batches/{b}" for b in self._batches() if b not in folded]
        if live:
            parts.append(self.spark.read.schema(KINDS).parquet(*live))
        if not parts:
            return self.spark.createDataFrame([], KINDS)
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Folds all committed batches into a new base; readers see the old base until the new one is whole."""
        names, bases = self._batches(), self._bases()
        now = self.spark.createDataFrame([(b,) for b in names], "batch string")
        at = f"{self.path}/bases/{len(bases):08d}-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{at}/totals")
        (now.union(self._folded()).distinct() if bases else now).write.parquet(f"{at}/folded")
        fs, done = self._fs(f"{at}/_SUCCESS")
        fs.create(done).close()
        for b in names:  # the base holds them; their names stay in `folded`
            fs, old = self._fs(f"{self.path}/batches/{b}")
            fs.delete(old, True)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch per (source, lang, tokenizer)."""
    told = changes.select("change_id", F.struct("kind", *KEYS, "tokens", "old_tokens").alias("c"))
    least = told.where("change_id is not null").groupBy("change_id").agg(F.min("c").alias("c")).select("c")
    once = least.unionByName(told.where("change_id is null").select("c")).select("c.*")
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    docs = F.expr("case kind when 'insert' then 1 when 'delete' then -1 else 0 end")
    tokens = F.when(F.col("kind") == "insert", new).when(F.col("kind") == "delete", -old).when(F.col("kind") == "revise", new - old).otherwise(F.lit(0))
    return once.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def rolled(totals: DataFrame) -> DataFrame:
    """Totals of every prefix of (tokenizer, lang, source); grouping tells a total (bit set) from a null value."""
    return totals.rollup("tokenizer", "lang", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.grouping_id().cast("long").alias("grouping"))


def op4_token_rollups(spark, sf_dir: str) -> DataFrame:
    """Counts of the whole table through four batches: all documents enter by words; those whose count of
    letter runs differs are revised to it; those under 50 words leave; all that stay enter by letter runs.
    Every batch is sent twice, and the third holds each change twice. Changes are told apart by rows, as ids may be null or repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    t = text_of()
    counted = docs.select(F.monotonically_increasing_id().alias("row"), "source", "lang", F.size(F.regexp_extract_all(t, F.lit(WORD), 0)).cast("long").alias("words"), F.size(F.regexp_extract_all(t, F.lit(r"\p{L}+"), 0)).cast("long").alias("letters"))
    counted = staged(counted, "op4-counted")
    now = F.when(F.col("letters") != F.col("words"), F.col("letters")).otherwise(F.col("words"))
    change = lambda df, batch, kind, tokenizer, new, old: df.select(
        F.concat(F.lit(f"{batch}-"), F.col("row").cast("string")).alias("change_id"), F.lit(kind).alias("kind"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), new.cast("long").alias("tokens"), old.cast("long").alias("old_tokens")
    )
    none = F.lit(None)
    gone = change(counted.where("words < 50"), "3", "delete", "words-1", none, now)
    batches = {
        "1": change(counted, "1", "insert", "words-1", F.col("words"), none),
        "2": change(counted.where("letters <> words"), "2", "revise", "words-1", F.col("letters"), F.col("words")),
        "3": gone.unionByName(gone),
        "4": change(counted.where("words >= 50"), "4", "insert", "letters-2", F.col("letters"), none),
    }
    store = TokenRollup(spark, folder(spark, "op4"))
    for name, changes in batches.items():
        store.commit(name, changes)
        store.commit(name, changes)
        if name == "2":
            store.compact()
    return rolled(store.totals())


OP4_SQL = rf"""WITH c AS (SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS words, len(regexp_extract_all(coalesce(text, ''), '\p{{L}}+')) AS letters FROM documents),
d AS (
  SELECT source, lang, 'words-1' AS tokenizer, 1 AS n, words AS t FROM c
  UNION ALL SELECT source, lang, 'words-1', 0, letters - words FROM c WHERE letters <> words
  UNION ALL SELECT source, lang, 'words-1', -1, -letters FROM c WHERE words < 50
  UNION ALL SELECT source, lang, 'letters-2', 1, letters FROM c WHERE words >= 50)
SELECT tokenizer, lang, source, CAST(sum(n) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens, CAST(grouping(tokenizer, lang, source) AS BIGINT) AS "grouping"
FROM d GROUP BY ROLLUP (tokenizer, lang, source)"""

QUERIES = {"op4_token_rollups": op4_token_rollups}
SQL = {"op4_token_rollups": OP4_SQL}
