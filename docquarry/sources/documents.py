"""Document and page sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.functions.ids import create_namespace


def read_documents(spark: SparkSession, path: str, file_format: str = "parquet", text: str = "text") -> DataFrame:
    """documents(doc_id, source, text) from a table, or one document per text file.

    For ``text`` and ``binaryFile`` the source is the file path and the id its hash.
    """
    if file_format == "text":
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    elif file_format == "binaryFile":
        rows = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))
    else:
        rows = spark.read.format(file_format).load(path)
        source = F.col("source") if "source" in rows.columns else F.lit("unknown")
        if "doc_id" in rows.columns:
            return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.cast("string").alias("source"), F.col(text).alias("text"))
        rows = rows.select(source.alias("source"), F.col(text).alias("text"))
    return rows.select(F.xxhash64("source").alias("doc_id"), "source", "text")


def with_namespace(documents: DataFrame, document_type: str = "document", environment: str = "development", by_content: bool = False) -> DataFrame:
    content = F.col("text") if by_content else None
    return documents.withColumn("namespace", create_namespace(F.col("source"), content, document_type, environment))


def file_name(source):
    return F.element_at(F.split(source, "/"), -1)
