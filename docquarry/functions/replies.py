"""Reading model replies that should be JSON but may not be."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.text import lit_array, strip

REPLY_SCHEMA = "answer STRING, confidence STRING, reasoning STRING, sources ARRAY<STRING>, additional_info STRING"


def parse_reply(reply: Column) -> dict[str, Column]:
    """answer, confidence, reasoning, sources, additional_info and an error flag.

    A reply that is no JSON object becomes its own answer with confidence 0.
    """
    ok = F.coalesce(strip(reply).startswith("{") & F.try_parse_json(reply).isNotNull(), F.lit(False))
    parsed = F.from_json(F.when(ok, reply), REPLY_SCHEMA)
    confidence = F.coalesce(parsed["confidence"].try_cast("double"), F.lit(0.0))
    return {
        "answer": F.when(ok, F.coalesce(parsed["answer"], F.lit(""))).otherwise(reply),
        "confidence": F.when(ok, confidence).otherwise(F.lit(0.0)),
        "reasoning": F.when(ok, F.coalesce(parsed["reasoning"], F.lit("")))
        .otherwise(F.lit("Response parsing failed")),
        "sources": F.when(ok, F.coalesce(parsed["sources"], lit_array([]))).otherwise(lit_array([])),
        "additional_info": F.when(ok, F.coalesce(parsed["additional_info"], F.lit("{}"))),
        "error": ~ok,
    }


def flatten_answer(reply: Column) -> Column:
    """One string per reply: the first known answer field, else all string values."""
    field = lambda path: F.get_json_object(reply, path)
    is_object = F.coalesce(strip(reply).startswith("{") & F.try_parse_json(reply).isNotNull(), F.lit(False))
    top = F.from_json(F.when(is_object, reply), "MAP<STRING,STRING>")
    # String values of the object and of objects directly below it, in order.
    def strings(value_key: Column, value: Column) -> Column:
        nested = F.when(value.startswith("{"), F.map_values(F.from_json(value, "MAP<STRING,STRING>")))
        return F.when(nested.isNotNull(), nested).otherwise(F.array(value))

    parts = F.flatten(F.transform(F.map_entries(top), lambda e: strings(e["key"], e["value"])))
    joined = F.nullif(F.array_join(parts, " "), F.lit(""))
    return F.when(
        is_object,
        F.coalesce(field("$.answer"), field("$.coverage"), field("$.NCD.description"), field("$.NCD"),
                   field("$.benefit"), field("$.room_rent_limit"), joined, reply),
    ).otherwise(reply)
