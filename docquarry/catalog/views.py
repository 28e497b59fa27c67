"""Views shared by the registered queries, in Spark and as SQL fragments.

The test tables hold invented words, so lexicons are function words of the four
languages, and paragraphs are lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import has_words
from docquarry.operators.chunking import paragraph_chunks
from docquarry.operators.domain import company_hits, policy_type
from docquarry.scale import spread_small, write_once

COMPANIES = [("English", ["the"]), ("French", ["le"]), ("German", ["der"]), ("Spanish", ["que"])]
TYPES = [("Article", ["the", "le", "der", "el"]), ("Preposition", ["of", "de", "von", "por"]), ("Joiner", ["and", "et", "und", "y"])]
MIN_CHARS = 0  # a line is the unit here; only blank ones are no chunk
TEXT_TABLES = {"documents", "pages", "conversations"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def tidy(df: DataFrame) -> DataFrame:
    """Integers as BIGINT and floats as DOUBLE, so that both engines agree on types."""
    def cast(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.FloatType, T.DecimalType)):
            c = c.cast("double")
        return c.alias(f.name)

    return df.select(*[cast(f) for f in df.schema.fields])


def chunk_view(spark: SparkSession, folder: str) -> DataFrame:
    """One chunk per line of every document, with document metadata."""
    docs = table(spark, folder, "documents").withColumn("_low", F.lower("text"))
    docs = docs.withColumn("_best", company_hits(F.col("_low"), COMPANIES, lowered=True)).withColumns({
        "company_name": F.when(F.col("_best.score") > 0, F.col("_best.name")), "confidence_score": F.least(F.col("_best.score") / 10, F.lit(1.0))})
    docs = docs.withColumn("policy_type", policy_type(F.col("_low"), TYPES, lowered=True))
    rows = paragraph_chunks(docs, ("doc_id", "lang", "source", "company_name", "confidence_score", "policy_type"), separator="\n", min_chars=MIN_CHARS)
    return rows.select(
        F.col("lang").alias("namespace"), "doc_id", F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        "chunk_index", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_name"),
        F.lit(None).cast("string").alias("policy_uin"), "company_name", "policy_type", F.col("source").alias("section_type"),
        F.col("source").alias("section_header"),
        F.when(has_words(F.col("text"), 20), F.lit("coverage")).otherwise(F.lit("definition")).alias("chunk_type"), "confidence_score")


def stored_chunk_view(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk view written once, as queries that read it several times need it."""
    return write_once(chunk_view(spark, folder))


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark text asked in every language namespace."""
    items = table(spark, folder, "benchmark").select("item_id", F.col("text").alias("question"))
    spaces = table(spark, folder, "documents").select(F.col("lang").alias("namespace")).distinct()
    asked = spaces.crossJoin(items)  # languages by questions: the set that is asked
    return asked.select(F.concat_ws("@", F.col("item_id").cast("string"), "namespace").alias("query_id"), "namespace", "question")


def user_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").filter("role = 'user'")
    return turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("question"))


# --- SQL fragments ------------------------------------------------------------------

WS = "(' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_strip(c: str) -> str:
    return f"trim({c}, {WS})"


def sql_words(c: str) -> str:
    return f"(CASE WHEN {sql_strip(c)} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({sql_strip(c)}, '\\s+') END)"


def sql_any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, {sql_text(t)})" for t in terms) + ")" if terms else "false"


def sql_case(c: str, rules, default: str = "NULL") -> str:
    return "(CASE " + " ".join(f"WHEN {sql_any(c, terms)} THEN {sql_text(v)}" for terms, v in rules) + f" ELSE {default} END)"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]::VARCHAR[]"


def sql_count(c: str, term: str) -> str:
    return f"((length({c}) - length(replace({c}, {sql_text(term)}, ''))) // {len(term)})"


def sql_matches(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {sql_text(pattern)}))"


def sql_best(scores: list[tuple[str, str]]) -> str:
    """Name of the greatest score, the first of equals, as a list expression."""
    entries = ", ".join(f"{{'s': ({s})::DOUBLE, 'o': {-i}, 'n': {sql_text(n)}}}" for i, (n, s) in enumerate(scores))
    return f"list_reverse_sort([{entries}])[1]"


def sql_ascii(c: str) -> str:
    """Accented letters as 0 and other non-ASCII characters as a dot: ASCII word
    boundaries then fall where Unicode ones do."""
    return f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '.', 'g'), '[^\\x00-\\x7F]', '0', 'g')"


COMPANY_SQL = sql_best([(n, sql_matches("lower(text)", p[0])) for n, p in COMPANIES])
TYPE_SQL = sql_best([(n, " + ".join(sql_count("lower(text)", t) for t in ts)) for n, ts in TYPES])

# chunks(namespace, doc_id, chunk_id, chunk_index, text, ...)
CHUNKS_SQL = f"""
meta AS (SELECT doc_id, lang, source, text, {COMPANY_SQL} AS co, {TYPE_SQL} AS ty FROM documents),
pieces AS (
  SELECT doc_id, lang, source, co, ty, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM meta),
chunks AS (
  SELECT lang AS namespace, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, {sql_strip('raw')} AS text,
         source || '/' || doc_id AS file_name, CASE WHEN co.s > 0 THEN co.n END AS company_name, CASE WHEN ty.s > 0 THEN ty.n END AS policy_type,
         source AS section_type, source AS section_header, CASE WHEN len({sql_words('raw')}) >= 20 THEN 'coverage' ELSE 'definition' END AS chunk_type,
         least(co.s / 10.0, 1.0)::DOUBLE AS confidence_score, i - 1 AS paragraph_index
  FROM pieces WHERE length({sql_strip('raw')}) > {MIN_CHARS}),
chunk AS (SELECT *, doc_id || '_' || chunk_index AS chunk_id FROM chunks)
"""
QUESTIONS_SQL = """
questions AS (
  SELECT item_id || '@' || ns AS query_id, ns AS namespace, text AS question FROM benchmark, (SELECT DISTINCT lang AS ns FROM documents) v)
"""
TURNS_SQL = "turns AS (SELECT conv_id || '/' || turn AS query_id, text AS question FROM conversations WHERE role = 'user')"


def sql_vectors(source: str, key: str, text: str, dim: int = 64) -> str:
    """Unit token-count vectors in sparse form: key, bucket, weight."""
    bucket = f"(('0x' || substr(md5(t), 1, 8))::BIGINT % {dim})"
    return f"""(
  SELECT key, b, (n / sqrt(sum(n * n) OVER (PARTITION BY key)))::FLOAT::DOUBLE AS w FROM (
    SELECT key, {bucket} AS b, count(*)::DOUBLE AS n FROM (SELECT {key} AS key, unnest({sql_words(f'lower({text})')}) AS t FROM {source}) GROUP BY ALL))"""
