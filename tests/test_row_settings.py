"""Settings that differ between the documents of one ingest."""

from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.operators.domain import metadata_text
from docquarry.plans.ingest import chunks, prepare


def test_titles_and_sizes_of_each_document(spark):
    body = "some words of a long enough body line, truly long enough for a section."
    text = f"Termination\n{body}\nEmployment Terms\n{body}\nDEFINITIONS\n{body}\n1. LIABILITY\n{body}\n" + "\n\n".join("word " * 30 for _ in range(8))
    rows = [(i, f"s{i}", text, d, t) for i, (d, t) in enumerate([("legal", 60), ("hr", 60), ("insurance", 200), ("compliance", 60), ("unheard of", 60)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, domain string, size int")
    general = [p for p in lx.HEADER_PATTERNS if p[1] != "main_section"]  # the titles are capital words too
    found = chunks(prepare(docs, domain_column="domain", target=F.col("size"), maximum=F.col("size"), headers=general)).collect()
    for i, _, _, domain, size in rows:
        one = docs.filter(F.col("doc_id") == i)
        alone = chunks(prepare(one, domain_name=domain if domain in ("legal", "hr", "insurance", "compliance") else "general", target=size, maximum=size, headers=general)).collect()
        key = lambda r: (r.chunk_index, r.text, r.section_type, r.header_type, r.sub_chunk_tokens)
        assert sorted(map(key, (r for r in found if r.doc_id == i)), key=repr) == sorted(map(key, alone), key=repr)
    types = {r.doc_id: {x.section_type for x in found if x.doc_id == r.doc_id} for r in found}
    assert "termination" in types[0] & types[1] and "employment" in types[1] and "employment" not in types[0]
    tokens = {i: [r.sub_chunk_tokens for r in found if r.doc_id == i and r.is_sub_chunk] for i in range(5)}
    assert max(tokens[0]) <= 60 < max(tokens[2])


def test_metadata_stands_in_for_a_missing_text(spark):
    rows = spark.createDataFrame([("whole text", "t", "p", "c"), ("", "t", None, "c"), (None, "t", "p", None)], "text string, title string, policy string, company string")
    got = [r[0] for r in rows.select(metadata_text(*map(F.col, rows.columns))).collect()]
    assert got == ["whole text", "t  c", "t p "]
