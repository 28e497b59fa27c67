"""Documents to chunks: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.ids import chunk_key, create_namespace
from docquarry.functions.text import extract_keywords, word_count
from docquarry.operators import chunking, domain, structure, tables

DOCUMENT = ["namespace", "doc_id", "file_name", "policy_uin", "company_name", "policy_type", "confidence_score"]


def prepare(documents: DataFrame, *, namespace: Column | None = None, companies=lx.COMPANY_PATTERNS,
            types=lx.POLICY_TYPE_TERMS, domain_name: str = "insurance", titles=None, headers=lx.HEADER_PATTERNS,
            separator: str = "\n\n", target: int | Column = lx.TARGET_TOKENS, maximum: int | Column = lx.MAX_TOKENS,
            min_paragraph: int = 50, domain_column: str | None = None) -> DataFrame:
    """Document rows with metadata, table blocks, headers and chunk pieces.

    Section titles are those of ``domain_name`` unless ``titles`` names others. ``domain_column`` names
    a column of ``documents`` whose domain chooses the titles of each row; ``titles`` then maps domains
    to titles. Sizes may be columns too, so one ingest serves documents of all domains."""
    titles = titles if titles is not None else lx.SECTION_TITLES if domain_column else lx.SECTION_TITLES[domain_name]
    key = create_namespace(F.col("source")) if namespace is None else namespace
    df = domain.document_metadata(documents.withColumn("namespace", key), companies=companies, types=types)
    df = tables.with_tables(df.withColumn("lines", structure.split_lines(F.col("text"))))
    df = df.withColumn("_body", F.array_join("text_lines", "\n")).drop("lines", "text_lines", "text")
    df = structure.with_headers(df, "_body", patterns=headers, titles=titles, domain=F.col(domain_column) if domain_column else None).drop("_body")
    return chunking.with_pieces(df, separator, target, maximum, min_paragraph=min_paragraph)


def chunks(prepared: DataFrame) -> DataFrame:
    """The chunk table of prepared documents."""
    rows = chunking.explode_pieces(prepared, DOCUMENT + ["source"])
    rows = rows.withColumn("chunk_id", chunk_key(
        F.col("namespace"), F.concat_ws("#", "source", F.col("doc_id").cast("string")), F.col("policy_uin"),
        F.col("chunk_index"), F.col("text")))
    rows = rows.withColumn("keywords", extract_keywords(F.col("text")))
    return rows.select("namespace", "doc_id", "chunk_id", "chunk_index", *[
        c for c in rows.columns if c not in ("namespace", "doc_id", "chunk_id", "chunk_index", "source")])


def document_stats(prepared: DataFrame) -> DataFrame:
    """Processing statistics per document, from the same row and without a shuffle."""
    p = F.col("pieces")

    def count(test) -> Column:
        return F.size(F.filter(p, test))

    tokens = F.aggregate(p, F.lit(0), lambda a, x: a + word_count(x["text"]))
    out = prepared.select(
        "namespace", "doc_id",
        F.size(p).alias("total_chunks"), F.col("text_pieces").alias("text_chunks"),
        (F.size(p) - F.col("text_pieces")).alias("table_chunks"), F.size("headers").alias("sections_identified"),
        count(lambda x: x["chunk_type"] == "definition").alias("definitions_found"),
        count(lambda x: x["chunk_type"] == "exclusion").alias("exclusions_found"),
        count(lambda x: x["chunk_type"] == "benefit").alias("benefits_found"),
        count(lambda x: x["is_sub_chunk"]).alias("sub_chunks_created"), tokens.alias("total_tokens"))
    return out.withColumn("avg_tokens_per_chunk", F.when(
        F.col("total_chunks") > 0, F.floor(F.col("total_tokens") / F.col("total_chunks"))).otherwise(F.lit(0)).cast("int"))


def ingest(documents: DataFrame, **settings) -> tuple[DataFrame, DataFrame]:
    """Chunk table and per-document statistics of ``documents(doc_id, source, text)``."""
    prepared = prepare(documents, **settings)
    return chunks(prepared), document_stats(prepared)
