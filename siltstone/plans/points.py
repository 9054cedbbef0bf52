"""Tables laid out for point reads: rows of a document in one bucket of sorted files with Bloom filters, so that a read opens few of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ChunkTable:
    """Children (document_id, version, parent_id, chunk_id, chunk_index, status, is_current, ...) in a bucketed, sorted table.

    Rows of a document are in one bucket, sorted by document, version, parent and index; an equality on document_id prunes the others at planning, the
    statistics and the Bloom filter of chunk_id skip row groups. Lookups of many documents at once join by document_id without an exchange of the table."""

    KEYS = ("document_id", "version", "parent_id", "chunk_index")

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 16):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def write(self, rows: DataFrame) -> None:
        writer = rows.repartition(self.buckets, "document_id").write.mode("overwrite").option("path", self.path)
        writer.option("parquet.bloom.filter.enabled#chunk_id", "true").bucketBy(self.buckets, "document_id").sortBy(*self.KEYS).saveAsTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def get(self, document_id: int, version: int, chunk_id: str) -> DataFrame:
        """One chunk, or no row."""
        return self.rows().where((F.col("document_id") == document_id) & (F.col("version") == version) & (F.col("chunk_id") == chunk_id))

    def children(self, document_id: int, version: int, parent_id: str) -> DataFrame:
        """The children of a parent by their index."""
        return self.rows().where((F.col("document_id") == document_id) & (F.col("version") == version) & (F.col("parent_id") == parent_id)).orderBy("chunk_index")

    def current(self, document_id: int | None = None) -> DataFrame:
        """Children in force, of one document or all, by document and index."""
        rows = self.rows().where("is_current and status = 'ready'")
        return (rows if document_id is None else rows.where(F.col("document_id") == document_id)).orderBy("document_id", "chunk_index")

    def of(self, wants: DataFrame) -> DataFrame:
        """The children of many parents (document_id, version, parent_id), each with `nth`, its place in the parent."""
        from pyspark.sql import Window

        found = self.rows().join(wants.select("document_id", "version", "parent_id").distinct(), ["document_id", "version", "parent_id"])
        return found.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "version", "parent_id").orderBy("chunk_index")))
