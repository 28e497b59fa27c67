"""Registered queries of the operators over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docquarry.llm.exact import exact_duplicates
from docquarry.llm.fingerprints import fingerprint_documents
from docquarry.llm.fixity import audit
from docquarry.llm.lexical import ranked_search
from docquarry.llm.mixing import mix_sources
from docquarry.llm.near import near_duplicates
from docquarry.llm.negatives import hard_negatives
from docquarry.llm.packing import pack_documents
from docquarry.llm.paragraphs import repeated_paragraphs
from docquarry.llm.quality import fit_quality, fold, score_quality
from docquarry.llm.tokens import tokenize
from docquarry.llm.toxicity import fit_toxicity, score_toxicity
from docquarry.llm.url_lists import filter_captures, host_of

VOCABULARY = "word_bpe_49k.json"

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


PAGES_SQL = """
expected AS (SELECT 'crawl-' || (page_id // 1000) AS namespace, page_id AS chunk_index, url, html FROM pages),
replica AS (
  SELECT namespace, CASE WHEN chunk_index % 47 = 13 THEN chunk_index + 500 ELSE chunk_index END AS chunk_index, url, CASE WHEN chunk_index % 37 = 5 THEN html || ' ' ELSE html END AS html
  FROM expected WHERE chunk_index % 41 <> 7
  UNION ALL SELECT namespace, chunk_index, url, html FROM expected WHERE chunk_index % 43 = 11)"""


@query(f"""WITH {PAGES_SQL},
a AS (SELECT namespace, chunk_index, count(*) AS n, string_agg(url || chr(1) || html, chr(2) ORDER BY url, html) AS c FROM expected GROUP BY ALL),
b AS (SELECT namespace, chunk_index, count(*) AS n, string_agg(url || chr(1) || html, chr(2) ORDER BY url, html) AS c FROM replica GROUP BY ALL)
SELECT namespace, chunk_index, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'changed' END AS status, coalesce(a.n, 0) AS expected_records, coalesce(b.n, 0) AS found_records
FROM a FULL JOIN b USING (namespace, chunk_index) WHERE a.c IS DISTINCT FROM b.c""")
def op1_fixity(spark, folder):
    """Pages as archives of records, audited against a replica with altered, lost, doubled and moved records."""
    pages = table(spark, folder, "pages")
    expected = pages.select(F.concat(F.lit("crawl-"), F.expr("page_id div 1000")).alias("namespace"), F.col("url").alias("chunk_id"), F.col("page_id").alias("chunk_index"), F.col("html").alias("text"))
    at = F.col("chunk_index")
    replica = expected.filter(at % 41 != 7).withColumns({"text": F.when(at % 37 == 5, F.concat("text", F.lit(" "))).otherwise(F.col("text")), "chunk_index": F.when(at % 47 == 13, at + 500).otherwise(at)})
    return audit(expected, replica.unionByName(expected.filter(at % 43 == 11)))


LISTS_SQL = """
captures AS (SELECT page_id, url, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#:@]+)', 1), '') AS host, 1704067200 + page_id * 86413 % 31536000 AS t FROM pages),
domains AS (SELECT DISTINCT 'malware' AS list_name, host AS domain FROM captures UNION SELECT 'adult', regexp_replace(host, '^[^.]+\\.', '') FROM captures),
coded AS (SELECT list_name, domain, ('0x' || substr(md5(domain), 1, 4))::BIGINT AS x FROM domains),
entries AS (
  SELECT list_name, domain, 'add' AS action, 1704067200 + x % 300 * 86400 AS t FROM coded UNION ALL
  SELECT list_name, domain, 'remove', 1704067200 + (x % 300 + 20 + x % 50) * 86400 FROM coded WHERE x % 3 > 0 UNION ALL
  SELECT list_name, domain, 'add', 1704067200 + 350 * 86400 FROM coded WHERE x % 5 = 0),
spans AS (SELECT list_name, domain, action, t AS since, lead(t) OVER (PARTITION BY list_name, domain ORDER BY t) AS until FROM entries)"""


@query(f"""WITH {LISTS_SQL}
SELECT c.page_id, c.url, c.host, coalesce(string_agg(DISTINCT s.list_name, ',' ORDER BY s.list_name), '') AS lists, count(s.list_name) > 0 AS blocked
FROM captures c LEFT JOIN spans s ON s.action = 'add' AND (c.host = s.domain OR ends_with(c.host, '.' || s.domain)) AND c.t >= s.since AND (s.until IS NULL OR c.t < s.until)
GROUP BY c.page_id, c.url, c.host""")
def op6_url_lists(spark, folder):
    """Pages as captures at times that follow from their ids; dated lists of their hosts and parent domains."""
    start = 1704067200
    pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.timestamp_seconds(start + F.col("page_id") * 86413 % 31536000).alias("fetched_at"))
    host = pages.select(host_of(F.col("source")).alias("host")).filter("host IS NOT NULL")
    domains = host.select(F.lit("malware").alias("list_name"), F.col("host").alias("domain")).union(host.select(F.lit("adult"), F.regexp_replace("host", r"^[^.]+\.", ""))).distinct()
    x = F.conv(F.substring(F.md5("domain"), 1, 4), 16, 10).cast("bigint")
    day = lambda days: F.timestamp_seconds(start + days * 86400)
    events = F.array(
        F.struct(F.lit("add").alias("action"), day(x % 300).alias("listed_at")),
        F.when(x % 3 > 0, F.struct(F.lit("remove").alias("action"), day(x % 300 + 20 + x % 50).alias("listed_at"))),
        F.when(x % 5 == 0, F.struct(F.lit("add").alias("action"), day(F.lit(350)).alias("listed_at"))))
    entries = domains.select("list_name", "domain", F.explode(events).alias("e")).filter("e IS NOT NULL").select("list_name", "domain", "e.action", "e.listed_at")
    found = filter_captures(pages, entries)
    return found.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), "host", F.array_join("lists", ",").alias("lists"), "blocked")


@query()
def op2_bpe(spark, folder):
    """Ids and decoded text of every document, as digests."""
    coded = tokenize(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    numbers = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op3_quality(spark, folder):
    documents = table(spark, folder, "documents")
    scored = score_quality(documents, fit_quality(documents, table(spark, folder, "labels")))
    return scored.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op4_packing(spark, folder):
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))


@query()
def op5_paragraphs(spark, folder):
    """Paragraphs that an earlier document has, with that document."""
    return repeated_paragraphs(table(spark, folder, "documents"))


@query()
def op7_winnowing(spark, folder):
    found = fingerprint_documents(table(spark, folder, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256 FROM t""")
def op8_exact_dedup(spark, folder):
    return exact_duplicates(table(spark, folder, "documents"))


@query()
def op10_minhash(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))


@query()
def op9_toxicity(spark, folder):
    documents = table(spark, folder, "documents")
    scored = score_toxicity(documents, fit_toxicity(documents, table(spark, folder, "labels")))
    return scored.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op11_mixing(spark, folder):
    """Words of each document in a mix of sources by weight."""
    return mix_sources(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


TERMS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(f"""WITH d AS (SELECT doc_id, {TERMS_SQL} AS terms FROM documents),
s AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM d WHERE len(terms) > 0),
i AS (SELECT DISTINCT item_id, unnest({TERMS_SQL}) AS term FROM benchmark),
o AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d),
c AS (SELECT doc_id, n, term, count(*) AS tf FROM o SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM c, s GROUP BY term, docs),
r AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))) AS part FROM c JOIN w USING (term), s),
t AS (SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM r JOIN i USING (term) GROUP BY ALL HAVING sum(part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM t
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""")
def op12_lexical(spark, folder):
    """Benchmark items as questions over all documents as chunks."""
    questions = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    found = ranked_search(questions, chunks)
    return found.select(F.col("query_id").alias("item_id"), F.col("rank_position").alias("rank"), F.col("chunk_id").alias("doc_id"), "score")


@query("""WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INT AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) <= 5""")
def op13_negatives(spark, folder):
    """Hard negatives of every hundredth vector among all vectors; every seventh changes its category first."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), label.alias("category"), "embedding")
    return hard_negatives(vectors, vectors.filter("chunk_id % 100 = 0"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark, folder):
    """The corpus pipeline from raw documents to packed sequences."""
    return corpus_pipeline.run(spark, folder)
