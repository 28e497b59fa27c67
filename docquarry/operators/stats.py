"""Statistics of the chunk and vector tables, requests, usage and memo tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """namespace, dimension, value, chunks: totals, per chunk type, per section type, in one pass."""
    grouped = chunks.groupingSets(
        [["namespace"], ["namespace", "chunk_type"], ["namespace", "section_type"]], "namespace", "chunk_type", "section_type"
    ).agg(F.count(F.lit(1)).alias("chunks"), F.grouping("chunk_type").alias("_c"), F.grouping("section_type").alias("_s"))
    dimension = F.when(F.col("_c") == 0, F.lit("chunk_type")).when(F.col("_s") == 0, F.lit("section_type")).otherwise(F.lit("total"))
    value = F.when(F.col("_c") == 0, F.col("chunk_type")).when(F.col("_s") == 0, F.col("section_type"))
    return grouped.select("namespace", dimension.alias("dimension"), value.alias("value"), "chunks")


def content_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if("is_definition").alias("definitions_count"),
        F.count_if("is_exclusion").alias("exclusions_count"), F.count_if("is_table").alias("tables_count"))


def document_info(requested: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each requested namespace exists, and its counts."""
    names = requested.select("namespace").distinct()
    stats = content_counts(chunks)
    counts = [c for c in stats.columns if c != "namespace"]
    return names.join(stats, "namespace", "left").select(
        "namespace", F.coalesce(F.col("total_chunks") > 0, F.lit(False)).alias("exists"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def vector_counts(vectors: DataFrame) -> DataFrame:
    """Vectors per namespace and, with a NULL namespace, in total with the number of namespaces."""
    per = vectors.groupBy("namespace").agg(F.count(F.lit(1)).alias("vectors"))
    total = per.agg(F.lit(None).cast("string").alias("namespace"), F.sum("vectors").alias("vectors"), F.count(F.lit(1)).alias("namespaces"))
    return per.withColumn("namespaces", F.lit(1).cast("bigint")).unionByName(total)


def processing_stats(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The per-document processing statistics from a stored chunk table.

    With ``documents`` (namespace, doc_id) those without a chunk are counted too, as zeros."""
    if documents is not None:
        found = processing_stats(chunks)
        counts = [c for c in found.columns if c not in ("namespace", "doc_id")]
        return documents.select("namespace", "doc_id").join(found, ["namespace", "doc_id"], "left").select("namespace", "doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    kind = lambda k: F.count_if(F.col("chunk_type") == k)
    return chunks.groupBy("namespace", "doc_id").agg(
        F.count(F.lit(1)).alias("total_chunks"), F.count_if(~F.col("is_table")).alias("text_chunks"),
        F.count_if("is_table").alias("table_chunks"), kind("definition").alias("definitions_found"),
        kind("exclusion").alias("exclusions_found"), kind("benefit").alias("benefits_found"),
        F.count_if("is_sub_chunk").alias("sub_chunks_created"), F.sum("word_count").alias("total_tokens"),
        F.floor(F.sum("word_count") / F.count(F.lit(1))).alias("avg_tokens_per_chunk"))


def success_counts(answers: DataFrame, keys=("request_id",)) -> DataFrame:
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_questions"), F.count_if(~F.col("error")).alias("successful_queries"),
        F.count_if("error").alias("failed_queries"))


def request_totals(results: DataFrame) -> DataFrame:
    """Per request over its documents: sums and numbers of documents and errors.

    A failed document counts all its questions as failed. Only sums are kept per request, so one
    of any size combines inside the tasks; ``request_details`` has its rows."""
    ok = F.col("error_message").isNull()
    return results.groupBy("request_id").agg(
        F.sum(F.when(ok, F.col("successful")).otherwise(0)).alias("successful_queries"),
        F.sum(F.when(ok, F.col("failed")).otherwise(F.col("questions"))).alias("failed_queries"),
        F.sum(F.when(ok, F.col("chunks")).otherwise(0)).alias("document_chunks"),
        F.sum(F.when(ok, F.col("tables")).otherwise(0)).alias("tables_extracted"),
        F.count("namespace").alias("documents"), F.count("error_message").alias("errors"))


def request_details(results: DataFrame) -> DataFrame:
    """Namespaces, errors and answers of requests, one row per answer in document and answer order."""
    rows = results.select("request_id", "document_order", F.col("namespace").alias("document_namespace"), F.col("error_message").alias("error_detail"), F.posexplode_outer("answers").alias("answer_order", "answer"))
    return rows.select("request_id", "document_order", "answer_order", "document_namespace", "error_detail", "answer")


def usage_stats(calls: DataFrame, price: float = lx.PRICE_PER_1K_TOKENS, keys=()) -> DataFrame:
    """Requests, tokens, hit rate in percent, mean milliseconds and cost of a call log
    (tokens, cached, seconds)."""
    n = F.count(F.lit(1))
    return calls.groupBy(*keys).agg(
        n.alias("total_requests"), F.sum("tokens").alias("total_tokens"),
        F.round(F.count_if("cached") * 100.0 / n, 2).alias("cache_hit_rate_percent"),
        F.round(F.avg("seconds") * 1000.0, 2).alias("avg_response_time_ms"),
        (F.sum("tokens") * price / 1000.0).alias("estimated_cost_usd"))


def memo_stats(memo: DataFrame, capacity: int) -> DataFrame:
    return memo.groupBy("kind").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("hits").alias("total_hits"),
        F.round(F.count(F.lit(1)) * 100.0 / capacity, 2).alias("usage_percent"))


def run_summary(runs: DataFrame, keys=("query",)) -> DataFrame:
    """Mean, least and greatest time and success rate of repeated runs."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("avg_seconds"), F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"), F.avg(F.col("success").cast("int")).alias("success_rate"))


def key_phrases(df: DataFrame, keys=("doc_id",), text: str = "text", n: int = 10) -> DataFrame:
    """Most frequent capitalised phrases per document; the first seen wins a tie."""
    from docquarry.functions.text import capitalised_phrases
    from docquarry.scale import explode_rows, top_k

    rows = explode_rows(df, keys, capitalised_phrases(F.col(text)), "_at", "phrase")
    counted = rows.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("frequency"), F.min("_at").alias("_first"))
    return top_k(counted, list(keys), [F.col("frequency").desc(), F.col("_first")], n).drop("_first")
