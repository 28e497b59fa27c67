"""What a question asks for: filters, confidence, strategy, type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import contains_any, first_match, word_count

FILTERS = ["policy_uin", "company_name", "policy_type", "section_type", "chunk_type", "file_name"]


def intent_filters(question: Column) -> dict[str, Column]:
    """Filter columns a question implies; NULL where it implies none."""
    q = F.lower(question)
    words, also, value = lx.SCHEDULE_INTENT
    schedule = F.when(contains_any(q, words) & q.contains(also), F.lit(value))
    kinds, limits, table = lx.TABLE_INTENT
    return {
        "section_type": first_match(q, lx.SECTION_INTENT, schedule),
        "chunk_type": F.when(contains_any(q, kinds) & contains_any(q, limits), F.lit(table)),
        "policy_type": first_match(q, lx.POLICY_TYPE_INTENT),
        "company_name": first_match(q, lx.COMPANY_INTENT),
    }


def intent_confidence(question: Column, section_type: Column, chunk_type: Column) -> Column:
    q = F.lower(question)
    parts = [
        F.when(section_type.isNotNull(), 0.4).otherwise(0.0),
        F.when(chunk_type.isNotNull(), 0.3).otherwise(0.0),
        F.when(word_count(question) < 3, -0.1).otherwise(0.0),
        *[F.when(contains_any(q, words), w).otherwise(0.0) for words, w in lx.CONFIDENCE_PHRASES],
    ]
    total = reduce(lambda a, b: a + b, parts)
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 2)


def query_intent(question: Column) -> Column:
    return first_match(F.lower(question), lx.QUERY_INTENT, F.lit("general"))


def query_type(question: Column) -> Column:
    return first_match(F.lower(question), lx.QUERY_TYPE, F.lit("general"))


def strategy(confidence: Column, kind: Column) -> Column:
    """How much expansion a question needs."""
    return (
        F.when(confidence >= 0.8, F.lit("original"))
        .when(confidence >= 0.6, F.lit("pattern"))
        .when(kind == "procedural", F.lit("multi_query"))
        .otherwise(F.lit("full"))
    )


def with_intent(queries: DataFrame, question: str = "question") -> DataFrame:
    """Add intent_<filter>, intent_confidence, query_intent, query_type and strategy."""
    q = F.col(question)
    df = queries.withColumns({f"intent_{k}": v for k, v in intent_filters(q).items()})
    df = df.withColumns({
        "intent_confidence": intent_confidence(q, F.col("intent_section_type"), F.col("intent_chunk_type")),
        "query_intent": query_intent(q), "query_type": query_type(q)})
    return df.withColumn("strategy", strategy(F.col("intent_confidence"), F.col("query_type")))


def merge_filters(queries: DataFrame) -> DataFrame:
    """Add filter_<name>: a given non-empty filter wins over the intent; the file
    name can only be given. Missing columns count as not given."""
    def pick(name: str, prefix: str) -> Column:
        column = f"{prefix}{name}"
        return F.nullif(F.col(column), F.lit("")) if column in queries.columns else F.lit(None).cast("string")

    given = {n: pick(n, "user_") for n in FILTERS}
    return queries.withColumns({
        f"filter_{n}": given[n] if n == "file_name" else F.coalesce(given[n], pick(n, "intent_")) for n in FILTERS})
