"""The corpus pipeline: quality, near copies, repeated passages, leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last
return the columns of documents; each result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bytebpe, decontaminate, quality, repeats, setjoin
from siltstone.llm.common import Run, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the base rules or are more likely bad than good by the rules' votes."""
    return quality.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one with the smallest id, of those that links connect: 0.9 of the distinct three-word shingles. A document is a row:
    another text under the same id is a document of its own, rows with the same id and text are one. Rows without words or without id all stay."""
    return setjoin.representatives(docs, n=3, num=9, den=10)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 200 bytes that start twice or more, in the same document or another; n_chars follows. Documents stay, however
    little is left. Over 99 % of the passages of 51 words are as long as that, in each language of the test tables; 400 bytes, the
    length of the operator's own query, would leave passages of up to about 75 words."""
    return repeats.removed(docs, length=repeats.PASSAGE).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a test item of the table benchmark, whole or edited. Each row's own text decides, whatever its id."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its ids by the public vocabulary, as digests, and the digest of the bytes that they decode to."""
    return bytebpe.encoded(docs, bytebpe.multi_path(), ["doc_id", "lang", "source"], what="digests")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("byte_bpe", tokens),
]

#: Suffix-array dedup and byte-level BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What the stages have staged belongs to this run: it is deleted as soon as the next stage's rows are stored,
    and nothing else is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Run(spark) as own:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = staged(docs, f"stage-{name}", "zstd")
                own.sweep(keep=1)  # what the stage was made from
    return docs
