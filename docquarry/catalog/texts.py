"""Text functions, ids, urls and replies over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.catalog.views import (
    TURNS_SQL, WS, sql_ascii, sql_list, sql_matches, sql_strip, sql_text, sql_words, table, tidy, user_turns,
)
from docquarry.functions import ids, replies, text as tx
from docquarry.operators.stats import key_phrases
from docquarry.scale import explode_rows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


_SENT = f"len(list_filter(regexp_split_to_array(text, '[.!?]+(?:\\s|$)'), lambda s: {sql_strip('s')} <> ''))"
_PARA = f"len(list_filter(string_split(text, chr(10)), lambda s: {sql_strip('s')} <> ''))"


@query(f"""
WITH s AS (SELECT doc_id, length(text) AS character_count, len({sql_words('text')}) AS word_count, {_SENT} AS sentence_count, {_PARA} AS paragraph_count FROM documents)
SELECT *, round(CASE WHEN sentence_count > 0 THEN word_count::DOUBLE / sentence_count ELSE 0 END, 6) AS avg_words_per_sentence,
  round(CASE WHEN word_count > 0 THEN character_count::DOUBLE / word_count ELSE 0 END, 6) AS avg_chars_per_word,
  round(word_count / 200.0::DOUBLE, 6) AS reading_time_minutes FROM s""")
def text_stats(spark, folder):
    stats = tx.text_statistics(F.col("text"), "\n")
    rounded = {n: F.round(c, 6) if n.startswith(("avg", "reading")) else c for n, c in stats.items()}
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in rounded.items()])


@query(f"""
SELECT doc_id, CASE WHEN {sql_strip('text')} = '' THEN '' ELSE trim(replace(replace(regexp_replace(regexp_replace(
  {sql_strip("regexp_replace(text, '\\s+', ' ', 'g')")}, '[.]{{3,}}', '...', 'g'), '[-]{{3,}}', '---', 'g'), '‘', ''''), '’', ''''), {WS}) END AS cleaned FROM documents""")
def clean_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(f"""
WITH p AS (SELECT doc_id, unnest(a) AS phrase, generate_subscripts(a, 1) AS pos FROM (
    SELECT doc_id, regexp_extract_all({sql_ascii('text')}, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\b') AS a FROM documents)),
 c AS (SELECT doc_id, phrase, count(*) AS frequency, min(pos) AS first_at FROM p GROUP BY ALL),
 r AS (SELECT doc_id, phrase, frequency, row_number() OVER (PARTITION BY doc_id ORDER BY frequency DESC, first_at) AS rank_position FROM c)
SELECT * FROM r WHERE rank_position <= 10""")
def key_phrase_top(spark, folder):
    return key_phrases(table(spark, folder, "documents")).select("doc_id", "phrase", "frequency", "rank_position")


def _entity_sql() -> str:
    parts = []
    for kind, patterns in lx.ENTITY_PATTERNS.items():
        for p in patterns:
            parts.append(f"SELECT doc_id, {sql_text(kind)} AS kind, unnest(regexp_extract_all(text, {sql_text('(?i)' + p)})) AS match FROM documents")
    return "SELECT doc_id, kind, match, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@query(_entity_sql())
def entity_extract(spark, folder):
    def tagged(kind, matches):
        return F.transform(matches, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match")))

    pairs = F.concat(*[tagged(k, c) for k, c in tx.entities(F.col("text")).items()])
    rows = explode_rows(table(spark, folder, "documents"), ["doc_id"], pairs, "_i", "e")
    return rows.groupBy("doc_id", F.col("e.kind").alias("kind"), F.col("e.match").alias("match")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, " + ", ".join(
    "(" + " + ".join(sql_matches("text", "(?i)" + p) for p in ps) + f")::BIGINT AS {kind}" for kind, ps in lx.FAST_PATTERNS.items()) + " FROM documents")
def pattern_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", *[c.alias(k) for k, c in tx.pattern_counts(F.col("text")).items()])


FUNCTION_WORDS = ["The", "Und", "Avec", "Para", "Which", "Nicht", "Pour", "Los"]


@query(f"""SELECT doc_id, array_to_string(list_filter({sql_list(FUNCTION_WORDS)}, lambda t: contains(lower(text), lower(t))), '|') AS terms FROM documents""")
def term_tags(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.array_join(tx.terms_present(F.col("text"), FUNCTION_WORDS), "|").alias("terms"))


@query(f"""
WITH {TURNS_SQL}, c AS (SELECT query_id, regexp_replace(regexp_replace(question, '[^\\p{{L}}\\p{{N}}_\\s\\-.]', ' ', 'g'), '\\s+', ' ', 'g') AS s FROM turns)
SELECT query_id, {sql_strip("CASE WHEN length(s) <= 80 THEN s WHEN contains(left(s, 80), ' ') THEN regexp_extract(left(s, 80), '(?s)^(.*) ', 1) ELSE left(s, 80) END")} AS optimised FROM c""")
def optimised_question(spark, folder):
    return user_turns(spark, folder).select("query_id", tx.optimise_query(F.col("question"), 80).alias("optimised"))


_EMPH = ["which", "with", "from", "that"]


def _emphasis_sql() -> str:
    # Only ASCII text has the same word boundaries in both engines; other texts are compared by their length.
    expr = "text"
    for t in _EMPH:
        expr = f"regexp_replace({expr}, '(?i)\\b{t}\\b', '{t} {t}', 'g')"
    return f"SELECT doc_id, length({expr.replace('text', sql_ascii('text'), 1)}) AS n_chars FROM documents"


@query(_emphasis_sql())
def emphasised_length(spark, folder):
    terms = {"english": _EMPH}
    emphasised = tx.emphasise(F.col("text"), "english", terms)
    return table(spark, folder, "documents").select("doc_id", F.length(emphasised).alias("n_chars"))


def _wrap_sql() -> str:
    kinds = "(CASE WHEN conv_id % 5 = 0 THEN 'insurance' WHEN conv_id % 5 = 1 THEN 'legal' WHEN conv_id % 5 = 2 THEN 'hr' WHEN conv_id % 5 = 3 THEN 'compliance' ELSE 'vehicle' END)"
    ctx = "CASE domain " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v + ': ')}" for k, v in lx.QUERY_CONTEXT.items()) + " ELSE '' END"
    suf = "CASE domain " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(' ' + v)}" for k, v in lx.QUERY_SUFFIX.items()) + " ELSE '' END"
    return f"SELECT conv_id, turn, domain, {ctx} || text AS with_context, text || {suf} AS with_suffix FROM (SELECT *, {kinds} AS domain FROM conversations)"


@query(_wrap_sql())
def question_wrapping(spark, folder):
    """Domain context prefix and suffix; every turn gets one of five domains by its conversation."""
    domains = F.array(*[F.lit(d) for d in ("insurance", "legal", "hr", "compliance", "vehicle")])
    rows = table(spark, folder, "conversations").withColumn("domain", F.element_at(domains, (F.col("conv_id") % 5 + 1).cast("int")))
    return rows.select("conv_id", "turn", "domain", tx.query_with_context(F.col("text"), F.col("domain")).alias("with_context"),
                       tx.query_with_suffix(F.col("text"), F.col("domain")).alias("with_suffix"))


@query("""
SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash, md5(text) AS text_hash, left('dev-document-' || substr(sha256(text), 1, 16), 40) AS namespace,
  left('prod-report-' || substr(sha256(source), 1, 16), 40) AS source_namespace, 'test_' || source AS test_name,
  substr(md5('dev-document-' || substr(sha256(text), 1, 16) || source || 'unknown'), 1, 8) || '_' || doc_id || '_' || substr(md5(text), 1, 8) AS chunk_key,
  md5('search:' || source || ':' || doc_id) AS memo_key
FROM documents""")
def doc_ids(spark, folder):
    t, source, number = F.col("text"), F.col("source"), F.col("doc_id")
    space = ids.create_namespace(source, t)
    return table(spark, folder, "documents").select(
        "doc_id", ids.content_hash(t).alias("content_hash"), ids.text_hash(t).alias("text_hash"), space.alias("namespace"),
        ids.create_namespace(source, document_type="report", environment="production").alias("source_namespace"),
        ids.test_namespace(source).alias("test_name"), ids.chunk_key(space, source, F.lit(None).cast("string"), number, t).alias("chunk_key"),
        ids.memo_key(F.lit("search"), source, number.cast("string")).alias("memo_key"))


@query("""
WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 1)) || '://' ||
  regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 2) || regexp_extract(url, '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)', 3) AS normalised FROM pages),
n AS (SELECT page_id, url, normalised, CASE WHEN starts_with(url, 'http') THEN substr(sha256(normalised), 1, 16) ELSE substr(sha256(url), 1, 16) END AS h FROM p)
SELECT page_id, normalised, left(trim(regexp_replace(regexp_replace('dev_web page_' || h, '[^a-zA-Z0-9\\-]', '-', 'g'), '-+', '-', 'g'), '-'), 40) AS namespace,
  left(trim(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9\\-]', '-', 'g'), '-+', '-', 'g'), '-'), 40) AS url_name, regexp_matches(url, '^(?:test|dev)[-_]') AS is_test FROM n""")
def url_namespace(spark, folder):
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id", ids.normalised_url(url).alias("normalised"), ids.create_namespace(url, document_type="web page").alias("namespace"),
        ids.sanitise_namespace(url).alias("url_name"), ids.is_test_namespace(url).alias("is_test"))


_LANG_WORDS = {"terms": ["the", "and", "with", "les", "des", "und", "nicht", "para", "los"], "companies": ["le", "el", "der"]}


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
  regexp_extract_all({sql_ascii('lower(text)')}, '\\b(?:{'|'.join(_LANG_WORDS['terms'])})\\b'),
  regexp_extract_all({sql_ascii('lower(text)')}, '\\b(?:{'|'.join(_LANG_WORDS['companies'])})\\b'),
  regexp_extract_all(text, {sql_text(lx.IDENTIFIER_PATTERN)})))), ' ') AS keywords FROM documents""")
def document_keywords(spark, folder):
    found = tx.extract_keywords(F.col("text"), _LANG_WORDS["terms"], _LANG_WORDS["companies"])
    return table(spark, folder, "documents").select("doc_id", F.array_join(found, " ").alias("keywords"))


_ID_PATTERNS = [r"([0-9]{3}-[0-9]{2}-[0-9]{4})", r"([A-Za-z0-9._]+@[A-Za-z0-9.]+)", r"([0-9]{3,})"]


@query("SELECT doc_id, coalesce(" + ", ".join(f"nullif(regexp_extract(text, {sql_text('(?i)' + p)}, 1), '')" for p in _ID_PATTERNS) + ") AS identifier FROM documents")
def first_identifier(spark, folder):
    return table(spark, folder, "documents").select("doc_id", tx.policy_id(F.col("text"), _ID_PATTERNS).alias("identifier"))


_REPLIES = """
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN text ELSE
  to_json({'answer': text, 'confidence': turn / 10.0::DOUBLE, 'reasoning': role, 'sources': ['c' || conv_id, role]})::VARCHAR END AS reply FROM conversations"""


@query(f"""
WITH r AS ({_REPLIES}), j AS (SELECT *, starts_with({sql_strip('reply')}, '{{') AND json_valid(reply) AS ok FROM r)
SELECT conv_id, turn, CASE WHEN ok THEN coalesce(json_extract_string(reply, '$.answer'), '') ELSE reply END AS answer,
  CASE WHEN ok THEN coalesce(json_extract_string(reply, '$.confidence')::DOUBLE, 0.0) ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN ok THEN coalesce(json_extract_string(reply, '$.reasoning'), '') ELSE 'Response parsing failed' END AS reasoning,
  CASE WHEN ok THEN array_to_string(json_extract_string(reply, '$.sources[*]'), '|') ELSE '' END AS sources, NOT ok AS error FROM j""")
def reply_parse(spark, folder):
    """User turns wrapped as JSON replies, assistant turns as replies that are no JSON."""
    rows = table(spark, folder, "conversations")
    wrapped = F.to_json(F.struct(
        F.col("text").alias("answer"), (F.col("turn") / 10).alias("confidence"), F.col("role").alias("reasoning"),
        F.array(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.col("role")).alias("sources")))
    rows = rows.withColumn("reply", F.when(F.col("role") == "assistant", F.col("text")).otherwise(wrapped))
    parsed = replies.parse_reply(F.col("reply"))
    return rows.select("conv_id", "turn", parsed["answer"].alias("answer"), parsed["confidence"].alias("confidence"), parsed["reasoning"].alias("reasoning"),
                       F.array_join(parsed["sources"], "|").alias("sources"), parsed["error"].alias("error"))


@query("""
SELECT conv_id, turn, text AS flat FROM conversations""")
def answer_flatten(spark, folder):
    """Every turn wrapped under one of the known answer keys and flattened back."""
    keys = ["answer", "coverage", "benefit", "room_rent_limit", "note"]
    t = F.col("text")
    shapes = [F.to_json(F.struct(t.alias(k))) for k in keys]
    shapes += [F.to_json(F.struct(F.struct(t.alias("description")).alias("NCD"))), F.to_json(F.struct(F.struct(t.alias("x")).alias("y"))), t]
    reply = F.element_at(F.array(*shapes), (F.col("conv_id") % len(shapes) + 1).cast("int"))
    return table(spark, folder, "conversations").select("conv_id", "turn", replies.flatten_answer(reply).alias("flat"))


@query("""
SELECT doc_id, md5(string_agg(h, '|' ORDER BY i)) AS context_hash FROM (
  SELECT doc_id, left(unnest(string_split(text, chr(10))), 100) AS h, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i <= 10 GROUP BY doc_id""")
def context_hash(spark, folder):
    """Memo key of a document's lines taken as a ranked context."""
    return table(spark, folder, "documents").select("doc_id", ids.context_hash(F.split("text", "\n")).alias("context_hash"))


