"""Reading files and writing reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.chunking import markdown_blocks

#: Kinds of file by extension.
KINDS = {".pdf": "pdf", ".png": "image", ".jpg": "image", ".jpeg": "image", ".csv": "table", ".xlsx": "table", ".xls": "table", ".txt": "text", ".md": "markdown"}
UPLOAD_BYTES = 25 * 1024 * 1024


def kind_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^.\\/]+)$", 1))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[suffix], F.lit("unknown"))


def legacy_doc_id(path: Column) -> Column:
    return F.substr(F.sha2(path, 256), F.lit(1), F.lit(16))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binary(spark: SparkSession, path: str, parse: Callable | None = None, schema: str = "path string, page int, text string") -> DataFrame:
    """Files as bytes, or what a parser for mapInPandas makes of them (PDF, spreadsheets, images: bring a library)."""
    raw = spark.read.format("binaryFile").load(path)
    return raw if parse is None else raw.mapInPandas(parse, schema)


def uploads(files: DataFrame) -> DataFrame:
    """path, content: those with a known suffix, not empty and of at most 25 MiB."""
    return files.where((kind_of(F.col("path")) != "unknown") & (F.length("content") > 0) & (F.length("content") <= UPLOAD_BYTES))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True)


def structured(docs: DataFrame) -> DataFrame:
    """(doc_id, block, title, content) of documents (doc_id, path, text): Markdown by headings, other text as one block."""
    marked = docs.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n"))).withColumn("kind", kind_of(F.col("path")))
    md = markdown_blocks(marked.where("kind = 'markdown'").select("doc_id", "text"))
    plain = marked.where("kind <> 'markdown'").select("doc_id", F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("title"), strip(F.col("text")).alias("content")).where("content <> ''")
    return md.unionByName(plain)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def tree_hash(files: DataFrame) -> DataFrame:
    """One hash of all files' names and hashes, in order of names."""
    rows = F.array_sort(F.collect_list(F.struct("path", "sha256")))
    return files.agg(F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["path"], F.lit("\x1f"), r["sha256"])), "\n"), 256).alias("tree_sha256"))


#: Digits of a name's hash by which a tree's leaves are grouped: 4096 groups.
FAN = 3


def tree_roots(files: DataFrame, tree: str = "tree") -> DataFrame:
    """(tree, n_files, root) of files (tree, path, sha256): a hash tree of three levels. Files are grouped by the first digits of the hash of their path, a
    group's hash is of its files in order of paths, the root's of the 16 hashes of the groups that share their first digit. The grouping depends on
    paths alone, so equal trees have equal roots however they are stored, two trees can be compared group by group, and no task holds more than a group."""
    line = F.struct(F.col("path"), F.col("sha256"))
    joined = lambda rows, *f: F.sha2(F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat_ws("\x1f", *[r[x] for x in f])), "\n"), 256)
    groups = files.groupBy(tree, F.substr(F.sha2("path", 256), F.lit(1), F.lit(FAN)).alias("g")).agg(joined(F.collect_list(line), "path", "sha256").alias("h"), F.count(F.lit(1)).alias("n"))
    heads = groups.groupBy(tree, F.substr("g", F.lit(1), F.lit(1)).alias("d")).agg(joined(F.collect_list(F.struct("g", "h")), "g", "h").alias("h"), F.sum("n").alias("n"))
    return heads.groupBy(tree).agg(F.sum("n").alias("n_files"), joined(F.collect_list(F.struct("d", "h")), "d", "h").alias("root"))


def tree_changes(one: DataFrame, two: DataFrame) -> DataFrame:
    """(path, change) of two versions of a tree (path, sha256): added, removed, changed. Only groups whose hashes differ are looked at."""
    def group(df):
        return df.withColumn("g", F.substr(F.sha2("path", 256), F.lit(1), F.lit(FAN)))

    a, b = group(one), group(two)
    hashed = lambda df: df.groupBy("g").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda r: F.concat_ws("\x1f", r["path"], r["sha256"])), "\n"), 256).alias("h"))
    differ = hashed(a).join(hashed(b).withColumnRenamed("h", "k"), "g", "full").where("not (h <=> k)").select("g")
    near = lambda df, name: df.join(differ, "g", "left_semi").select("path", F.col("sha256").alias(name))
    both = near(a, "x").join(near(b, "y"), "path", "full").where("not (x <=> y)")
    return both.select("path", F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").otherwise("changed").alias("change"))


def write_report(df: DataFrame, path: str, form: str = "json") -> None:
    """JSON, CSV or text; Spark's commit protocol makes the folder appear whole or not at all."""
    writer = df.coalesce(1).write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def fixture_errors(manifest: DataFrame, documents: DataFrame, questions: DataFrame) -> DataFrame:
    """(error): counts that differ from the manifest, repeated ids, sources that no document has."""
    m = manifest.select("documents", "questions")
    counts = m.crossJoin(documents.agg(F.count(F.lit(1)).alias("nd"))).crossJoin(questions.agg(F.count(F.lit(1)).alias("nq")))  # one row each
    a = counts.where("documents <> nd").select(F.lit("document_count").alias("error")).union(counts.where("questions <> nq").select(F.lit("question_count")))
    b = questions.groupBy("question_id").count().where("count > 1").select(F.concat(F.lit("repeated:"), F.col("question_id")))
    c = questions.select("question_id", F.explode("expected_sources").alias("filename")).join(documents.select("filename"), "filename", "left_anti").select(F.concat(F.lit("unknown_source:"), F.col("filename")))
    return a.union(b).union(c)


def source_documents(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, source, document_id, status): expected file names against registered ones; unmapped and ambiguous are told."""
    n = documents.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id"))
    both = expected.join(n, expected["source"] == n["filename"], "left")
    return both.select("question_id", "source", F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"), F.when(F.col("n").isNull(), "unmapped").when(F.col("n") > 1, "ambiguous").otherwise("mapped").alias("status"))
