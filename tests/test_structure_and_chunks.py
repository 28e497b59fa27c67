import random
import re

from pyspark.sql import functions as F

from docquarry.operators import chunking as ch
from docquarry.operators import structure as st
from docquarry.operators import tables as tb
from docquarry.plans import ingest as ing

POLICY = """Star Health leaflet with enough words before the first header.
1. DEFINITIONS
1.1 Hospital
Place with 15 beds; UIN: ABCD1234E567890 applies.
(a) Day care
Centre, 24 hours.
2. EXCLUSIONS
- War is 1st on this list, see page 3.
| Plan | Limit |
| A | 10% |
| B | 20% | extra |
Section 3 claims
How to claim: send form 7 within 30 days, please."""


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"http://x/y/doc{i}.pdf", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")


def test_headers_levels_types_and_ends(spark):
    h = st.with_headers(docs(spark, POLICY)).select("headers").first()[0]
    got = [(x.line, x.type, x.level, x.section_type, x.content_start, x.content_end) for x in h]
    assert (1, "main_section", 1, "definitions", 2, 5) in got
    assert (2, "subsection", 2, "general", 3, 5) in got
    assert (6, "main_section", 1, "exclusions", 7, 10) in got
    assert (11, "named_section", 1, "claims", 12, 12) in got
    assert all(x.content_end <= 12 for x in h)


def test_last_matching_section_title_wins_and_other_domains(spark):
    titles = [("first", "^zz1"), ("second", "^zz1 *b")]
    h = st.with_headers(docs(spark, "x\nzz1 b2\nbody"), patterns=[(r"^never$", "n", 1)], titles=titles).first().headers
    assert [(x.line, x.type, x.level, x.section_type) for x in h] == [(1, "domain_specific", 2, "second")]


def test_ingest_metadata_chunks_and_tables(spark):
    chunks, stats = ing.ingest(docs(spark, POLICY))
    got = {r.chunk_type: r for r in chunks.collect()}
    assert got["preamble"].section_header == "Document Preamble" and got["preamble"].is_orphaned
    table = got["table_markdown"]
    assert table.is_table and table.row_count == 3
    assert "|  | Plan | Limit |  |" in table.text and "| B |" not in table.text.split("ORIGINAL FORMAT:")[0]
    assert all(r.policy_uin == "ABCD1234E567890" and r.company_name == "Star Health" for r in got.values())
    assert all(r.file_name == "doc0.pdf" and abs(r.confidence_score - 0.1) < 1e-9 for r in got.values())
    assert sorted(r.chunk_index for r in chunks.collect()) == list(range(chunks.count()))
    s = stats.first()
    assert s.table_chunks == 1 and s.total_chunks == s.text_chunks + 1 == chunks.count()


def test_plain_document_gives_paragraphs(spark):
    text = "para 1, short\n\n" + "word, " * 20 + "\n\n" + "other; " * 20
    chunks, _ = ing.ingest(docs(spark, text))
    assert [r.section_header for r in chunks.collect()] == ["General Content"] * 2


def test_fallback_adds_main_sections(spark):
    lines = []
    for i in range(60):
        lines += [f"Section {i}", f"{i}) Bullet", "tiny 1"]
    prepared = ing.prepare(docs(spark, "\n".join(lines)))
    chunks = ing.chunks(prepared).collect()
    assert len(prepared.first().headers) > 100
    assert not any(r.is_fallback for r in chunks)  # main sections are below fifty characters
    longer = [x if not x.startswith("tiny") else "tiny 1, " * 6 for x in lines]
    sparse = st.with_headers(tb.with_tables(docs(spark, "\n".join(longer)).withColumn("lines", F.split("text", "\n"))))
    out = ch.explode_pieces(ch.with_pieces(sparse, min_section=10_000), ["doc_id"]).collect()
    assert len(out) == 60 and all(r.is_fallback and r.header_type == "fallback_main" for r in out)


def test_no_shuffle_and_no_python_in_ingest(spark, tmp_path):
    path = str(tmp_path / "d")
    docs(spark, POLICY).write.parquet(path)
    plan = ing.ingest(spark.read.parquet(path))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ArrowEval" not in plan


def packs(text, sep, target, maximum):
    done, cur, n = [], [], 0
    for p in (x.strip() for x in text.split(sep)):
        if not p:
            continue
        t = len(p.split())
        if t > maximum:
            inner, size = [], 0
            for s in (x.strip() for x in re.split(r"[.!?]+", p)):
                if not s:
                    continue
                m = len(s.split())
                if size + m > target and inner:
                    done.append((". ".join(inner) + ".", size, "sentence"))
                    inner, size = [s], m
                else:
                    inner, size = inner + [s], size + m
            if inner:
                done.append((". ".join(inner) + ".", size, "sentence"))
        elif n + t > target and cur:
            done.append((sep.join(cur), n, "paragraph"))
            cur, n = [p], t
        else:
            cur, n = cur + [p], n + t
    if cur:
        done.append((sep.join(cur), n, "paragraph"))
    return done


def random_text(rng, paragraphs):
    out = []
    for _ in range(paragraphs):
        words = ["w%d" % rng.randint(0, 99) + rng.choice(["", "", "", ".", "!", ";"]) for _ in range(rng.choice([0, 3, 8, 30]))]
        out.append(" ".join(words))
    return "\n".join(out)


def test_greedy_packing_equals_loop(spark):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(0, 25)) for _ in range(40)]
    got = {}
    for r in ch.greedy_chunks(docs(spark, *texts), separator="\n", target=15, maximum=20).orderBy("doc_id", "sub_chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.sub_chunk_tokens, r.split_level))
    assert all(got.get(i, []) == packs(t, "\n", 15, 20) for i, t in enumerate(texts))


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        end = start + size
        if end < len(text):
            at = max(start + int(size * 0.8), start + 1)
            for p in (r"\.(?:\s|$)", r"[!?](?:\s|$)", r";(?:\s|$)"):
                m = list(re.finditer(p, text[at:end]))
                if m:
                    end = at + m[-1].end()
                    break
        if text[start:end].strip():
            out.append((start, end, text[start:end].strip()))
        start = max(start + 1, end - overlap)
    return out


def test_sliding_windows_equal_loop(spark):
    rng = random.Random(6)
    texts = [random_text(rng, rng.randint(0, 12)) for _ in range(30)]
    rows = docs(spark, *texts).select("doc_id", F.explode(ch.sliding_windows(F.col("text"), 60, 20)).alias("w")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(tuple(r.w))
    assert all(got.get(i, []) == windows(t, 60, 20) for i, t in enumerate(texts))


def test_section_aware_chunks_cover_every_line(spark):
    out = ch.chunk_text(docs(spark, POLICY), size=150, overlap=40).orderBy("chunk_id").collect()
    assert {r.chunk_type for r in out} >= {"size_split", "final"}
    assert out[0].start_line == 0 and out[-1].end_line == POLICY.count("\n")
    for a, b in zip(out, out[1:]):
        assert b.start_line <= a.end_line + 1 and a.total_chunks == len(out)
    lines = POLICY.split("\n")
    assert all(r.text == "\n".join(lines[r.start_line:r.end_line + 1]).strip() for r in out)


def test_items_and_unconvertible_table(spark):
    d = docs(spark, "A) one\nmore\n\nB) two\n(c) three").withColumns({"section_type": F.lit("exclusions"), "section_header": F.lit("E")})
    assert [r.text for r in ch.section_items(d).orderBy("item_index").collect()] == ["A) one\nmore", "B) two", "(c) three"]
    d = docs(spark, "Term means this\nmore\n\"Quoted\": that").withColumns({"section_type": F.lit("definitions"), "section_header": F.lit("D")})
    out = ch.section_items(d).orderBy("item_index").collect()
    assert [r.text for r in out] == ["Term means this\nmore", "\"Quoted\": that"] and out[0].is_definition
    t = tb.with_tables(docs(spark, "a\n| lone | row |\nb").withColumn("lines", F.split("text", "\n"))).first()
    assert t.table_blocks == [] and t.text_lines == ["a", "| lone | row |", "b"]
    t = tb.with_tables(docs(spark, "x|y|z\n1|2|3").withColumn("lines", F.split("text", "\n"))).first()
    assert t.text_lines == [""] and t.table_blocks[0].markdown == "| x | y | z |\n| --- | --- | --- |\n| 1 | 2 | 3 |"


def test_html_table(spark):
    html = "<tr>\n<td>a</td>\n<th>b</th>\n</tr>\nplain"
    assert spark.range(1).select(tb.html_table_to_markdown(F.lit(html))).first()[0] == "| a \n| b \n|\nplain"
