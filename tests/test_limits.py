"""Results follow the requested k, and sections of definitions and exclusions become items."""

from docquarry.operators.memo import fresh, latest_versions
from docquarry.plans.hybrid import hybrid_search
from docquarry.plans.ingest import chunks as chunk_rows
from docquarry.plans.ingest import document_stats, prepare
from docquarry.operators.stats import processing_stats
from docquarry.slots import hashed_embedding
from pyspark.sql import functions as F

FILTERS = ["policy_uin", "company_name", "policy_type", "section_type", "chunk_type", "file_name"]


def test_search_delivers_the_requested_number(spark):
    rows = spark.range(200).select(
        F.lit("n").alias("namespace"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").cast("int").alias("chunk_index"), F.concat(F.lit("waiting period number "), "id").alias("text"),
        F.lit("Periods").alias("section_header"), F.lit(0.5).alias("confidence_score"), F.array().cast("array<string>").alias("keywords"), *[F.lit(None).cast("string").alias(c) for c in FILTERS])
    vectors = hashed_embedding(rows.select("chunk_id", "namespace", "text", *FILTERS)).drop("text")
    asked = spark.createDataFrame([("q", "n", "waiting period")], "query_id string, namespace string, question string")
    for k in (10, 45, 100):
        got = hybrid_search(asked, rows, vectors, k=k).collect()
        assert len(got) == k and sorted(r.rank_position for r in got) == list(range(1, k + 1))


TEXT = """1. DEFINITIONS
Accident means a sudden and unforeseen event caused by external means.
Hospital means an institution established for in-patient care and treatment.
2. EXCLUSIONS
A) Any loss that arises from war or from warlike operations of any kind.
B) Any treatment that was taken outside of the country of residence.
"""


def test_definitions_and_exclusions_become_chunks(spark):
    docs = spark.createDataFrame([(1, "s/a.txt", TEXT), (2, "s/b.txt", "")], "doc_id bigint, source string, text string")
    prepared = prepare(docs, namespace=F.lit("n"))
    rows = chunk_rows(prepared).collect()
    definitions = [r.text for r in rows if r.is_definition]
    exclusions = [r.text for r in rows if r.is_exclusion]
    assert any(t.startswith("Accident") for t in definitions) and any(t.startswith("Hospital") for t in definitions)
    assert any(t.startswith("A)") for t in exclusions) and any(t.startswith("B)") for t in exclusions)
    assert {r.chunk_type for r in rows if r.is_definition} == {"definition"}
    counted = {r.doc_id: (r.definitions_found, r.exclusions_found, r.total_chunks) for r in document_stats(prepared).collect()}
    stored = {r.doc_id: (r.definitions_found, r.exclusions_found, r.total_chunks) for r in processing_stats(chunk_rows(prepared), prepared).collect()}
    assert counted[1][:2] == (len(definitions), len(exclusions)) and counted == stored and counted[2] == (0, 0, 0)


def test_equal_versions_and_memo_entries_are_resolved(spark):
    rows = spark.createDataFrame([("a", 1, "old", 0), ("a", 1, "new", 1), ("b", 2, "x", 0), ("b", 1, "y", 1)], "id string, version int, text string, is_new int")
    assert {r.id: r.text for r in latest_versions(rows, ["id"], "version", tie="is_new").collect()} == {"a": "new", "b": "x"}
    memo = spark.sql("SELECT 'k' AS key, p AS payload, timestamp'2024-01-01 00:00:00' AS created_at, 60 AS ttl_seconds FROM VALUES ('a'), ('b') t(p)")
    assert [r.payload for r in fresh(memo, F.lit("2024-01-01 00:00:30").cast("timestamp")).collect()] == ["b"]
