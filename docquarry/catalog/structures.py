"""Headers, sections, tables and chunkers over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.catalog.views import COMPANIES, TYPES, sql_case, sql_strip, sql_text, sql_words, table, tidy
from docquarry.operators import chunking as ch
from docquarry.operators import stats
from docquarry.operators import structure as st
from docquarry.operators import tables as tb
from docquarry.operators.domain import with_domain_settings
from docquarry.plans import ingest as ing
from docquarry.scale import explode_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _lines(name: str = "lines") -> str:
    return f"""{name} AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line,
  len(string_split(text, chr(10))) AS n_lines, lang FROM documents)"""


def _headers_sql() -> str:
    kinds = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text('(?i)' + p)}) THEN {i}" for i, (p, _, _) in enumerate(lx.HEADER_PATTERNS)) + " END"
    titles = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text('(?i)' + p)}) THEN {sql_text(n)}" for n, p in reversed(lx.SECTION_TITLES["insurance"])) + " END"
    name = "CASE kind " + " ".join(f"WHEN {i} THEN {sql_text(n)}" for i, (_, n, _) in enumerate(lx.HEADER_PATTERNS)) + " ELSE 'domain_specific' END"
    level = "CASE kind " + " ".join(f"WHEN {i} THEN {lv}" for i, (_, _, lv) in enumerate(lx.HEADER_PATTERNS)) + " ELSE 2 END"
    return f"""{_lines()},
 tried AS (SELECT *, {kinds} AS kind, {titles} AS title FROM (SELECT *, {sql_strip('raw')} AS t FROM lines) WHERE length(t) >= 3),
 heads AS (SELECT doc_id, line, t AS header, {name} AS header_type, ({level})::BIGINT AS level, n_lines,
   CASE WHEN kind IS NOT NULL THEN {sql_case('lower(t)', lx.SECTION_WORDS, "'general'")} ELSE title END AS section_type
   FROM tried WHERE kind IS NOT NULL OR title IS NOT NULL),
 bounded AS (SELECT *, line + 1 AS content_start, coalesce((SELECT min(o.line) FROM heads o WHERE o.doc_id = h.doc_id AND o.line > h.line AND o.level <= h.level), n_lines) - 1 AS content_end FROM heads h)"""


@query(f"WITH {_headers_sql()} SELECT doc_id, line, header, header_type, level, section_type, content_start, content_end FROM bounded")
def headers(spark, folder):
    docs = st.with_headers(table(spark, folder, "documents"))
    rows = explode_rows(docs, ["doc_id"], "headers", "_i", "h")
    return rows.select("doc_id", "h.line", F.col("h.text").alias("header"), F.col("h.type").alias("header_type"), "h.level", "h.section_type", "h.content_start", "h.content_end")


@query(f"""
WITH {_headers_sql()},
 body AS (SELECT b.doc_id, b.line, b.header AS title, b.section_type, b.header_type, b.level, b.content_start, b.content_end,
   coalesce(length({sql_strip("string_agg(l.raw, chr(10) ORDER BY l.line)")}), 0) AS content_length
   FROM bounded b LEFT JOIN lines l ON l.doc_id = b.doc_id AND l.line BETWEEN b.content_start AND b.content_end GROUP BY ALL)
SELECT doc_id, title, section_type, header_type, level, content_start, content_end, content_length FROM body WHERE content_length > 20""")
def sections(spark, folder):
    return st.sections(st.with_headers(table(spark, folder, "documents"))).drop("section")


def _simple_sql() -> str:
    match = " OR ".join(f"regexp_matches(t, {sql_text('(?i)' + p)})" for p in lx.SIMPLE_SECTIONS)
    level = "CASE " + " ".join(f"WHEN regexp_matches(t, {sql_text(p)}) THEN {lv}" for p, lv in lx.SIMPLE_LEVELS) + f" ELSE {lx.SIMPLE_DEFAULT_LEVEL} END"
    return f"WITH {_lines()} SELECT doc_id, line, t AS title, ({level})::BIGINT AS level FROM (SELECT *, {sql_strip('raw')} AS t FROM lines) WHERE t <> '' AND ({match})"


@query(_simple_sql())
def simple_sections(spark, folder):
    rows = explode_rows(st.with_simple_sections(table(spark, folder, "documents")), ["doc_id"], "simple_sections", "_i", "s")
    return rows.select("doc_id", "s.line", "s.title", "s.level")


_TABLES = f"""{_lines()},
 piped AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM lines WHERE length(raw) - length(replace(raw, '|', '')) >= 2),
 blocks AS (SELECT doc_id, min(line) AS start_line, max(line) AS end_line, count(*) AS row_count, string_agg(raw, chr(10) ORDER BY line) AS original_text,
   list_filter(list({sql_strip('raw')} ORDER BY line), lambda r: r <> '') AS rows FROM piped GROUP BY doc_id, island),
 cells AS (SELECT *, list_transform(rows, lambda r: list_transform(string_split(r, '|'), lambda c: {sql_strip('c')})) AS cs FROM blocks),
 marked AS (SELECT doc_id, start_line, end_line, row_count, original_text, CASE WHEN len(cs) >= 2 THEN
   '| ' || array_to_string(cs[1], ' | ') || ' |' || chr(10) || '|' || array_to_string(list_transform(cs[1], lambda c: ' --- '), '|') || '|' ||
   coalesce(chr(10) || nullif(array_to_string(list_transform(list_filter(cs[2:], lambda r: len(r) = len(cs[1])), lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)), ''), '') END AS markdown FROM cells)"""


@query(f"""
WITH {_TABLES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) - 1 AS table_index, original_text, markdown, start_line, end_line, row_count
FROM marked WHERE markdown IS NOT NULL""")
def table_blocks(spark, folder):
    docs = tb.with_tables(table(spark, folder, "documents").withColumn("lines", st.split_lines(F.col("text"))))
    return tb.table_blocks(docs)


@query(f"""
WITH {_TABLES}, t AS (SELECT * FROM marked WHERE markdown IS NOT NULL),
 kept AS (SELECT l.doc_id, l.line, CASE WHEN t.doc_id IS NULL THEN l.raw ELSE '' END AS raw FROM lines l LEFT JOIN t ON t.doc_id = l.doc_id AND l.line BETWEEN t.start_line AND t.end_line
   WHERE t.doc_id IS NULL OR l.line = t.start_line)
SELECT doc_id, md5(string_agg(raw, chr(10) ORDER BY line)) AS body_hash, count(*) AS n_lines FROM kept GROUP BY doc_id""")
def text_without_tables(spark, folder):
    docs = tb.with_tables(table(spark, folder, "documents").withColumn("lines", st.split_lines(F.col("text"))))
    return docs.select("doc_id", F.md5(F.array_join("text_lines", "\n")).alias("body_hash"), F.size("text_lines").alias("n_lines"))


@query(f"""
WITH {_TABLES} SELECT doc_id, start_line, 'TABLE:' || chr(10) || markdown || chr(10) || chr(10) || 'ORIGINAL FORMAT:' || chr(10) || original_text AS text FROM marked WHERE markdown IS NOT NULL""")
def table_chunks(spark, folder):
    docs = tb.with_tables(table(spark, folder, "documents").withColumn("lines", st.split_lines(F.col("text"))))
    return tb.table_blocks(docs).select("doc_id", "start_line", tb.table_chunk_text(F.col("markdown"), F.col("original_text")).alias("text"))


@query("""
WITH l AS (SELECT page_id, unnest(string_split(x, chr(10))) AS raw, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM (
  SELECT page_id, replace(replace(replace(html, '<p>', chr(10) || '<td>'), '</p>', '</td>' || chr(10)), '<h1>', chr(10) || '<tr>' || chr(10)) AS x FROM pages)),
 c AS (SELECT page_id, i, CASE WHEN contains(raw, '<tr>') THEN NULL WHEN contains(raw, '</tr>') THEN '|' WHEN contains(raw, '<td>') OR contains(raw, '<th>')
   THEN '| ' || trim(replace(replace(replace(replace(raw, '<td>', ''), '</td>', ''), '<th>', ''), '</th>', '')) || ' ' ELSE raw END AS o FROM l)
SELECT page_id, string_agg(o, chr(10) ORDER BY i) AS markdown FROM c WHERE o IS NOT NULL GROUP BY page_id""")
def html_tables(spark, folder):
    """Pages have no table cells, so paragraphs are marked as cells and headings as rows first."""
    html = F.replace(F.replace(F.replace("html", F.lit("<p>"), F.lit("\n<td>")), F.lit("</p>"), F.lit("</td>\n")), F.lit("<h1>"), F.lit("\n<tr>\n"))
    return table(spark, folder, "pages").select("page_id", tb.html_table_to_markdown(html).alias("markdown"))


@query(f"""
WITH {_lines()}, p AS (SELECT doc_id, line AS paragraph_index, {sql_strip('raw')} AS text FROM lines WHERE length({sql_strip('raw')}) > 50)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_index) - 1 AS chunk_index, paragraph_index, text,
  length(text) AS char_count, len({sql_words('text')}) AS word_count, len(string_split(text, chr(10))) AS line_count FROM p""")
def paragraph_chunks(spark, folder):
    rows = ch.paragraph_chunks(table(spark, folder, "documents"), separator="\n")
    return rows.withColumns(ch.text_counts(F.col("text")))


@query(f"""
WITH RECURSIVE {_lines()},
 units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS u, len({sql_words('raw')}) AS n, {sql_strip('raw')} AS t FROM lines WHERE {sql_strip('raw')} <> ''),
 fold AS (SELECT doc_id, u, n AS total, 0 AS pack FROM units WHERE u = 1
   UNION ALL SELECT x.doc_id, x.u, CASE WHEN f.total + x.n > 100 THEN x.n ELSE f.total + x.n END, CASE WHEN f.total + x.n > 100 THEN f.pack + 1 ELSE f.pack END
   FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.u = f.u + 1)
SELECT f.doc_id, f.pack::BIGINT AS sub_chunk_index, string_agg(x.t, chr(10) ORDER BY x.u) AS text, sum(x.n)::BIGINT AS sub_chunk_tokens, 'paragraph' AS split_level
FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.u = f.u GROUP BY f.doc_id, f.pack""")
def greedy_chunks(spark, folder):
    """Lines packed to 100 words; no line is long enough to need sentence packing."""
    return ch.greedy_chunks(table(spark, folder, "documents"), separator="\n", target=100, maximum=1_000_000)


def _sentence_packs_sql() -> str:
    return f"""
WITH RECURSIVE units AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS u, len({sql_words('raw')}) AS n, {sql_strip('raw')} AS t FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?]+')) AS raw, generate_subscripts(regexp_split_to_array(text, '[.!?]+'), 1) AS i FROM documents WHERE len({sql_words('text')}) > 150) WHERE {sql_strip('raw')} <> ''),
 fold AS (SELECT doc_id, u, n AS total, 0 AS pack FROM units WHERE u = 1
   UNION ALL SELECT x.doc_id, x.u, CASE WHEN f.total + x.n > 60 THEN x.n ELSE f.total + x.n END, CASE WHEN f.total + x.n > 60 THEN f.pack + 1 ELSE f.pack END
   FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.u = f.u + 1)
SELECT f.doc_id, f.pack::BIGINT AS sub_chunk_index, string_agg(x.t, '. ' ORDER BY x.u) || '.' AS text, sum(x.n)::BIGINT AS sub_chunk_tokens, 'sentence' AS split_level
FROM fold f JOIN units x ON x.doc_id = f.doc_id AND x.u = f.u GROUP BY f.doc_id, f.pack
UNION ALL SELECT doc_id, 0::BIGINT, {sql_strip('text')}, len({sql_words('text')}), 'paragraph' FROM documents WHERE len({sql_words('text')}) <= 150 AND {sql_strip('text')} <> ''"""


@query(_sentence_packs_sql())
def sentence_packs(spark, folder):
    """Whole documents as one paragraph each: the long ones are packed by sentences."""
    docs = table(spark, folder, "documents")
    return ch.greedy_chunks(docs, separator="\u0000", target=60, maximum=150)


@query("""
SELECT doc_id, s AS start_char, substr(text, s + 1, 500) AS text FROM (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 400)) AS s FROM documents)""")
def fixed_window_chunks(spark, folder):
    rows = explode_rows(table(spark, folder, "documents"), ["doc_id"], ch.fixed_windows(F.col("text"), 500, 100), "_i", "w")
    return rows.select("doc_id", "w.start_char", "w.text")


def _windows_sql(size: str, overlap: str) -> str:
    head = f"floor({size} * 0.8)::BIGINT"
    last = lambda p: f"nullif(length(regexp_extract(z, '(?s)^(.*{p}(?:\\s|$))', 1)), 0)"
    snapped = f"(s + {head} + coalesce({last(chr(92) + '.')}, {last('[!?]')}, {last(';')}))"
    ends = f"""SELECT *, CASE WHEN s + {size} < n THEN coalesce({snapped}, s + {size}) ELSE s + {size} END AS e FROM (SELECT *, substr(text, s + {head} + 1, {size} - {head}) AS z FROM w)"""
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, lang, text, length(text) AS n, 0::BIGINT AS s FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, lang, text, n, greatest(s + 1, e - {overlap}) FROM ({ends}) WHERE greatest(s + 1, e - {overlap}) < n),
 ends AS ({ends})
SELECT doc_id, s AS start_char, e AS end_char, {sql_strip('substr(text, s + 1, e - s)')} AS text FROM ends WHERE {sql_strip('substr(text, s + 1, e - s)')} <> ''"""


@query(f"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, length(text) AS n, 0::BIGINT AS s FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, text, n, greatest(s + 1, e - 100) FROM (
    SELECT *, CASE WHEN s + 500 < n THEN coalesce(s + 400 + coalesce(nullif(length(regexp_extract(z, '(?s)^(.*\\.(?:\\s|$))', 1)), 0), nullif(length(regexp_extract(z, '(?s)^(.*[!?](?:\\s|$))', 1)), 0),
      nullif(length(regexp_extract(z, '(?s)^(.*;(?:\\s|$))', 1)), 0)), s + 500) ELSE s + 500 END AS e FROM (SELECT *, substr(text, s + 401, 100) AS z FROM w)) WHERE greatest(s + 1, e - 100) < n),
 ends AS (SELECT *, CASE WHEN s + 500 < n THEN coalesce(s + 400 + coalesce(nullif(length(regexp_extract(z, '(?s)^(.*\\.(?:\\s|$))', 1)), 0), nullif(length(regexp_extract(z, '(?s)^(.*[!?](?:\\s|$))', 1)), 0),
      nullif(length(regexp_extract(z, '(?s)^(.*;(?:\\s|$))', 1)), 0)), s + 500) ELSE s + 500 END AS e FROM (SELECT *, substr(text, s + 401, 100) AS z FROM w))
SELECT doc_id, s AS start_char, e AS end_char, {sql_strip('substr(text, s + 1, e - s)')} AS text FROM ends WHERE {sql_strip('substr(text, s + 1, e - s)')} <> ''""")
def snap_window_chunks(spark, folder):
    rows = explode_rows(table(spark, folder, "documents"), ["doc_id"], ch.sliding_windows(F.col("text"), 500, 100), "_i", "w")
    return rows.select("doc_id", "w.start_char", "w.end_char", "w.text")


_DOMAIN_OF = {"en": "legal", "fr": "hr", "de": "technical", "es": "insurance"}
_SIZES = {row[0]: row[1:3] for row in lx.DOMAIN_SETTINGS}


def _by_language(at: int) -> str:
    return "(CASE " + " ".join(f"WHEN lang = '{lang}' THEN {_SIZES[d][at]}" for lang, d in _DOMAIN_OF.items()) + f" ELSE {_SIZES['general'][at]} END)"


@query(_windows_sql(_by_language(0), _by_language(1)))
def domain_window_chunks(spark, folder):
    """Windows of the size and overlap of each document's domain; a language stands for a domain."""
    name = F.lit("general")
    for lang, domain in _DOMAIN_OF.items():
        name = F.when(F.col("lang") == lang, F.lit(domain)).otherwise(name)
    docs = with_domain_settings(table(spark, folder, "documents").withColumn("domain", name))
    rows = explode_rows(docs, ["doc_id"], ch.sliding_windows(F.col("text"), F.col("chunk_size"), F.col("chunk_overlap")), "_i", "w")
    return rows.select("doc_id", "w.start_char", "w.end_char", "w.text")


def _items_sql() -> str:
    def starts(kind: str, flag: str) -> str:
        return "(" + " OR ".join(f"regexp_matches({sql_strip('raw')}, {sql_text(flag + p)})" for p in lx.ITEM_STARTS[kind]) + ")"

    return f"""
WITH {_lines()}, full_lines AS (SELECT *, CASE WHEN lang = 'en' THEN {starts('definitions', '(?i)')} WHEN lang = 'fr' THEN {starts('exclusions', '')} ELSE {starts('subsections', '')} END AS opens
   FROM lines WHERE {sql_strip('raw')} <> ''),
 numbered AS (SELECT *, sum(CASE WHEN opens AND NOT first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS item FROM (
   SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) = 1 AS first FROM full_lines))
SELECT doc_id, item::BIGINT AS item_index, {sql_strip("string_agg(raw, chr(10) ORDER BY line)")} AS text,
  CASE any_value(lang) WHEN 'en' THEN 'definition' WHEN 'fr' THEN 'exclusion' ELSE any_value(lang) END AS chunk_type FROM numbered GROUP BY doc_id, item"""


@query(_items_sql())
def item_split(spark, folder):
    """English documents read as definitions, French as exclusions, others by enumerators."""
    kind = F.when(F.col("lang") == "en", F.lit("definitions")).when(F.col("lang") == "fr", F.lit("exclusions")).otherwise(F.col("lang"))
    docs = table(spark, folder, "documents").withColumns({"section_type": kind, "section_header": F.col("source")})
    return ch.section_items(docs).select("doc_id", "item_index", "text", "chunk_type")


@query()
def section_aware_chunks(spark, folder):
    return ch.chunk_text(table(spark, folder, "documents"), size=1000, overlap=200)


def _prepared(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return ing.prepare(docs, namespace=F.col("source"), companies=COMPANIES, types=TYPES, separator="\n", target=100, maximum=200)


@query()
def ingest_chunks(spark, folder):
    """The whole ingest: metadata, tables, structure, chunks and enrichment."""
    return ing.chunks(_prepared(spark, folder)).withColumn("keywords", F.array_join("keywords", " "))


@query()
def ingest_stats(spark, folder):
    return ing.document_stats(_prepared(spark, folder))


@query()
def stored_chunk_stats(spark, folder):
    """The same statistics by aggregation of the chunk table, for every document."""
    prepared = _prepared(spark, folder)
    return stats.processing_stats(ing.chunks(prepared), prepared.select("namespace", "doc_id"))


@query(f"SELECT doc_id, len({sql_words('text')}) AS tokens, len({sql_words('text')}) > 200 AS too_long, element_at(x, len(x)) AS file_name FROM (SELECT doc_id, text, string_split(source || '/' || lang || '.txt', '/') AS x FROM documents)".replace("element_at(x, len(x))", "x[len(x)]"))
def token_gate(spark, folder):
    from docquarry.functions.text import word_count
    from docquarry.sources.documents import file_name

    t = F.col("text")
    return table(spark, folder, "documents").select(
        "doc_id", word_count(t).alias("tokens"), ch.exceeds_tokens(t, 200).alias("too_long"),
        file_name(F.concat("source", F.lit("/"), "lang", F.lit(".txt"))).alias("file_name"))
