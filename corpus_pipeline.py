"""A training corpus from raw documents: five stages, each reading what its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a frame that is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm.exact import exact_duplicates
from docquarry.llm.near import near_duplicates
from docquarry.llm.packing import pack_documents
from docquarry.llm.paragraphs import repeated_paragraphs, without_paragraphs
from docquarry.llm.quality import fit_quality, score_quality
from docquarry.llm.store import rows_of, stored

VOCABULARY = "word_bpe_49k.json"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key per row in the order of doc_id, NULL last, and the key's name, which no column has.

    Where every row has an id of its own, that is the key. Otherwise rows are numbered by
    range partitions of doc_id and text, so that rows that share an id are told apart."""
    name = "__row"
    while name in docs.columns:
        name += "_"
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    if ids.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("bigint")), name
    order = (F.col("doc_id").cast("bigint").asc_nulls_last(), F.xxhash64("text"), F.spark_partition_id())
    split = docs.withColumn(name, order[2])
    ranged = split.repartitionByRange(order[0], order[1], F.col(name)).sortWithinPartitions(order[0], order[1])
    return stored(ranged.withColumn(name, F.monotonically_increasing_id())), name


def _texts(rows: DataFrame, key: str) -> DataFrame:
    """The columns that the operators read, with the key of the row as doc_id."""
    return rows.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text"))


def _kept(rows: DataFrame, key: str, decided: DataFrame, keep: str) -> DataFrame:
    """Rows without those that a decision drops."""
    dropped = stored(decided.filter(f"NOT ({keep})").select(F.col("doc_id").alias(key)))
    return rows_of(rows, dropped, key, how="left_anti").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Every row is scored and dropped by itself;
    NULL and empty texts have the score of the empty text. All columns stay."""
    rows, key = _numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _kept(rows, key, score_quality(_texts(rows, key), fit_quality(docs, labels)), "score >= 0.5")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one of the smallest doc_id. NULL counts as the empty text;
    rows without an id or with a repeated one are rows of their own. All columns stay."""
    rows, key = _numbered(docs)
    return _kept(rows, key, exact_duplicates(_texts(rows, key)), "kept")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest doc_id. NULL and blank texts stay;
    rows without an id or with a repeated one are rows of their own. All columns stay."""
    rows, key = _numbered(docs)
    return _kept(rows, key, near_duplicates(_texts(rows, key)), "kept")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier row has; rows of which nothing is left go, as do
    those whose passages were removed and that were blank otherwise. NULL and empty texts stay
    as they are. All columns stay."""
    rows, key = _numbered(docs)
    own = "__own"
    while own in rows.columns:
        own += "_"
    renamed = rows.withColumnRenamed("doc_id", own).withColumnRenamed(key, "doc_id")
    cleaned = without_paragraphs(renamed, repeated_paragraphs(_texts(rows, key)), drop_emptied=True)
    return cleaned.drop("doc_id").withColumnRenamed(own, "doc_id").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every row in a training sequence; a NULL or empty text is its end token. Repeated rows are packed each."""
    return pack_documents(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("passages", passages), ("packing", packing)]

#: Models and similarity joins have no SQL form; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
