"""Exact duplicates of documents by full content, safe against hot texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import stored

SPACES = r"[\x20\x09-\x0D]+"


def normalised_text(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; NULL is the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def exact_duplicates(
    documents: DataFrame,
    salts: int = 32,
    digest: Callable[[Column], Column] = lambda text: F.unhex(F.sha2(text, 256)),
) -> DataFrame:
    """Which document of each group of equal texts stays.

    ``documents(doc_id, text)`` -> one row per input row: ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    Three rounds, each grouping by digest *and* full normalised text, so different
    texts never merge, whatever their digests: copies within an input split are
    combined before anything moves; the splits' winners meet in salted digest groups;
    the winners of the salts meet at last. A text that fills a third of the table
    sends one row per split and salt. Only digests and ids are shuffled afterwards.

    NULL texts and empty texts are equal. The smallest ``doc_id`` stays; NULL ids come
    last, so a group of NULL ids only has ``keep_id`` NULL and is kept. Repeated rows
    of one ``doc_id`` and text share their decision and count in ``group_size``. Other
    columns are ignored; an empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised_text(F.col("text")).alias("norm"))
    texts = texts.withColumn("digest", digest(F.col("norm")))
    local = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = local.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    winners = stored(groups.select("digest", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))
    if winners.groupBy("digest").count().filter("count > 1").isEmpty():
        out = texts.select("doc_id", "digest").join(winners, "digest")
    else:  # different texts share a digest: the text itself decides, by its independent hash and then in full
        out = texts.join(groups.withColumn("text_sha256", F.sha2("norm", 256)), ["digest", "norm"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
