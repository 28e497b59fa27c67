"""Vector, keyword and hybrid retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.catalog.views import (
    CHUNKS_SQL, QUESTIONS_SQL, benchmark_questions, chunk_view, stored_chunk_view, sql_any, sql_text, sql_vectors, sql_words, table, tidy,
)
from docquarry.functions.text import words
from docquarry.operators import context as ctx
from docquarry.operators import search as se
from docquarry.operators import vectors as vec
from docquarry.operators.expand import search_terms
from docquarry.operators.intent import FILTERS
from docquarry.plans.answer import answer
from docquarry.plans.hybrid import block_filter, hybrid_search
from docquarry.scale import cut_lineage, write_once
from docquarry.slots import hashed_embedding, score_pairs

QUERIES, SQL = {}, {}
K = 10


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


# --- the embeddings table: label centroids as queries ----------------------------------

def centroids(spark, folder) -> DataFrame:
    """Mean vector of every label: label, vector."""
    e = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    means = e.groupBy("label", "p").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("v"))
    return packed.select(F.col("label").cast("string").alias("label"), F.transform("v", lambda s: s["x"]).alias("vector"))


def labelled_vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("label").cast("string").alias("namespace"), "embedding")


_CENTROIDS = """
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
means AS (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) GROUP BY label, p),
centroid AS (SELECT label::VARCHAR AS label, list(x ORDER BY p) AS c FROM means GROUP BY label)"""
_COS = "round(list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})), 9)"


def _cos(a: str, b: str) -> str:
    return _COS.format(a=a, b=b)


@query(f"""
WITH {_CENTROIDS}, s AS (SELECT c.label AS query_id, e.vec_id::VARCHAR AS chunk_id, {_cos('c.c', 'e.v')} AS score FROM centroid c, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_position FROM s) SELECT * FROM r WHERE rank_position <= {K}""")
def vector_topk(spark, folder):
    """The vectors closest to each label centroid, over the whole table."""
    q = centroids(spark, folder).select(F.col("label").alias("query_id"), "vector", F.lit("all").alias("namespace"))
    return vec.vector_top_k(q, labelled_vectors(spark, folder).withColumn("namespace", F.lit("all")), K)


@query(f"""
WITH {_CENTROIDS}, s AS (SELECT c.label AS query_id, e.label::VARCHAR AS namespace, e.vec_id::VARCHAR AS chunk_id, {_cos('c.c', 'e.v')} AS score FROM centroid c, e),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, chunk_id) AS rank_position FROM s) SELECT * FROM r WHERE rank_position <= 3""")
def vector_topk_by_label(spark, folder):
    """Each centroid against every label namespace, one list per pair."""
    q = centroids(spark, folder)
    spaces = q.agg(F.collect_set("label").alias("spaces"))  # one short row: the labels
    asked = q.withColumn("_one", F.lit(1)).join(F.broadcast(spaces.withColumn("_one", F.lit(1))), "_one")
    asked = asked.select(F.col("label").alias("query_id"), "vector", F.explode("spaces").alias("namespace"))
    return vec.vector_top_k(asked, labelled_vectors(spark, folder), 3, by_namespace=True)


def _cells_sql() -> str:
    return f"""WITH {_CENTROIDS},
 near AS (SELECT e.vec_id, e.v, c.label AS cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_cos('e.v', 'c.c')} DESC, c.label) AS r FROM e, centroid c),
 cell AS (SELECT vec_id, v, cell FROM near WHERE r = 1),
 probe AS (SELECT * FROM (SELECT q.label AS query_id, q.c AS q, c.label AS cell, row_number() OVER (PARTITION BY q.label ORDER BY {_cos('q.c', 'c.c')} DESC, c.label) AS r FROM centroid q, centroid c) WHERE r <= 3)"""


@query(_cells_sql() + f""", s AS (SELECT query_id, vec_id::VARCHAR AS chunk_id, {_cos('q', 'v')} AS score FROM probe JOIN cell USING (cell)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_position FROM s) SELECT * FROM r WHERE rank_position <= {K}""")
def cell_topk(spark, folder):
    """Approximate top-k: three nearest cells per query, cells around the label centroids."""
    c = centroids(spark, folder)
    q = c.select(F.col("label").alias("query_id"), "vector", F.lit("all").alias("namespace"))
    v = labelled_vectors(spark, folder).withColumn("namespace", F.lit("all"))
    return vec.cell_top_k(q, v, c.select(F.col("label").alias("cell"), F.col("vector").alias("centroid")), K, probes=3)


# --- chunks of documents, asked by benchmark texts ---------------------------------------

def question_terms(spark, folder) -> DataFrame:
    """Benchmark questions with their search terms: all distinct words."""
    return benchmark_questions(spark, folder).withColumn("terms", search_terms(F.array_distinct(words(F.lower("question")))))


TERMS_SQL = f"""
{QUESTIONS_SQL}, w AS (SELECT query_id, namespace, t, min(i) AS i FROM (
  SELECT query_id, namespace, unnest({sql_words('lower(question)')}) AS t, generate_subscripts({sql_words('lower(question)')}, 1) AS i FROM questions) GROUP BY ALL),
terms AS (SELECT * FROM w)"""
KEYWORD_SQL = f"""
kw AS (SELECT query_id, chunk_id, (1.0 - (rank_position - 1) * 0.01)::DOUBLE * confidence_score AS score, rank_position FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, chunk_index, chunk_id) AS rank_position FROM (
    SELECT DISTINCT t.query_id, c.chunk_id, c.confidence_score, c.chunk_index FROM terms t JOIN chunk c ON c.namespace = t.namespace AND contains(lower(c.text), t.t))) WHERE rank_position <= {K})"""


@query(f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {KEYWORD_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank_position FROM kw")
def keyword_topk(spark, folder):
    hits = se.keyword_top_k(question_terms(spark, folder), chunk_view(spark, folder), K)
    return hits.withColumn("score", F.round("score", 6))


def chunk_vectors(chunks: DataFrame, columns=()) -> DataFrame:
    return hashed_embedding(chunks.select("chunk_id", "namespace", "text", *columns)).drop("text")


def embedded_questions(spark, folder) -> DataFrame:
    return hashed_embedding(question_terms(spark, folder), "question", "vector")


_SEMANTIC = f"""
qv AS {sql_vectors('questions', 'query_id', 'question')}, cv AS {sql_vectors('chunk', 'chunk_id', 'text')},
pairs AS (SELECT q.query_id, c.chunk_id, c.namespace FROM questions q JOIN chunk c ON c.namespace = q.namespace),
cq AS (SELECT q.query_id, q.namespace, v.b, v.w FROM questions q JOIN qv v ON v.key = q.query_id), cc AS (SELECT c.chunk_id, c.namespace, v.b, v.w FROM chunk c JOIN cv v ON v.key = c.chunk_id),
dots AS (SELECT a.query_id, c.chunk_id, sum(a.w * c.w) AS d FROM cq a JOIN cc c ON c.namespace = a.namespace AND c.b = a.b GROUP BY ALL),
qn AS (SELECT key, sqrt(sum(w * w)) AS n FROM qv GROUP BY key), cn AS (SELECT key, sqrt(sum(w * w)) AS n FROM cv GROUP BY key),
sims AS (SELECT p.query_id, p.chunk_id, coalesce(round(d / (qn.n * cn.n), 9), 0.0) AS score FROM pairs p LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN qn ON qn.key = p.query_id LEFT JOIN cn ON cn.key = p.chunk_id),
sem AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_position FROM sims) WHERE rank_position <= {K})"""


@query(f"WITH {CHUNKS_SQL}, {QUESTIONS_SQL}, {_SEMANTIC} SELECT query_id, chunk_id, score, rank_position FROM sem")
def semantic_topk(spark, folder):
    """Benchmark texts against all chunks of their namespace, with hashed token vectors."""
    return vec.vector_top_k(embedded_questions(spark, folder), chunk_vectors(chunk_view(spark, folder)), K)


_FUSED = f"""
both_sides AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.chunk_id, k.chunk_id) AS chunk_id, coalesce(s.score, 0.0)::DOUBLE AS semantic_score,
  CASE WHEN s.query_id IS NULL THEN k.score ELSE 0.0 END::DOUBLE AS metadata_score,
  round(coalesce(1.0::DOUBLE / (60 + s.rank_position) * 0.7::DOUBLE, 0) + coalesce(1.0::DOUBLE / (60 + k.rank_position) * 0.3::DOUBLE, 0), 12) AS combined_score
  FROM sem s FULL JOIN kw k ON s.query_id = k.query_id AND s.chunk_id = k.chunk_id),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY combined_score DESC, chunk_id) AS rank_position FROM both_sides) WHERE rank_position <= 15)"""


def fused_hits(spark, folder, chunks: DataFrame) -> DataFrame:
    semantic = vec.vector_top_k(embedded_questions(spark, folder), chunk_vectors(chunks), K)
    keyword = se.keyword_top_k(question_terms(spark, folder), chunks, K)
    return se.reciprocal_rank_fusion(semantic, keyword, 15)


@query(f"WITH {CHUNKS_SQL}, {TERMS_SQL}, {KEYWORD_SQL}, {_SEMANTIC}, {_FUSED} SELECT query_id, chunk_id, semantic_score, round(metadata_score, 6) AS metadata_score, combined_score, rank_position FROM fused")
def rrf_fusion(spark, folder):
    return fused_hits(spark, folder, stored_chunk_view(spark, folder)).withColumn("metadata_score", F.round("metadata_score", 6))


def _boost_sql(question: str = "lower(q.question)") -> str:
    parts = []
    for ws, tests in lx.BOOST_RULES:
        for name, kind, values, boost in tests:
            hit = f"coalesce(c.{name}, '') IN ({', '.join(sql_text(v) for v in values)})" if kind == "is" else sql_any(f"lower(coalesce(c.{name}, ''))", values)
            parts.append(f"(CASE WHEN {sql_any(question, ws)} AND {hit} THEN {boost}::DOUBLE ELSE 0 END)")
    return f"round(least({' + '.join(parts)}, 0.3::DOUBLE), 6)"


_OVERLAP = f"(SELECT len(list_filter(list_distinct(qw), lambda x: list_contains(cw, x)))::DOUBLE / len(list_distinct(qw)))"
_RANKED = f"""
full_hits AS (SELECT f.query_id, f.chunk_id, f.semantic_score, f.combined_score AS fused_score, c.text, c.company_name, c.section_header, c.section_type, c.chunk_type, 'How to define coverage: ' || q.question AS question,
   {sql_words("lower('How to define coverage: ' || q.question)")} AS qw, {sql_words('lower(c.text)')} AS cw, {_boost_sql("lower('How to define coverage: ' || q.question)")} AS metadata_boost
   FROM fused f JOIN chunk c USING (chunk_id) JOIN questions q USING (query_id)),
scored AS (SELECT *, {_OVERLAP} AS model_score FROM full_hits),
finals AS (SELECT *, round(model_score + metadata_boost, 9) AS final_score, fused_score * 0.3::DOUBLE + model_score * 0.7::DOUBLE AS combined_score FROM scored),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS rank_position FROM finals) WHERE rank_position <= {K})"""
_ALL = f"{CHUNKS_SQL}, {TERMS_SQL}, {KEYWORD_SQL}, {_SEMANTIC}, {_FUSED}, {_RANKED}"


def ranked_hits(spark, folder) -> DataFrame:
    """Fused hits with text, pair score and metadata boost, ten per question."""
    q = benchmark_questions(spark, folder).select("query_id", F.concat(F.lit("How to define coverage: "), "question").alias("question"))
    chunks = stored_chunk_view(spark, folder)
    full = se.attach_chunks(cut_lineage(fused_hits(spark, folder, chunks)), chunks).join(q, "query_id")
    scored = score_pairs(full)
    scored = scored.withColumn("combined_score", F.col("combined_score") * 0.3 + F.col("model_score") * 0.7)
    return se.rerank_with_boost(scored, K)


@query(f"WITH {_ALL} SELECT query_id, chunk_id, round(model_score, 6) AS model_score, metadata_boost, round(final_score, 6) AS final_score, rank_position FROM ranked")
def rerank_boost(spark, folder):
    return ranked_hits(spark, folder).select("query_id", "chunk_id", F.round("model_score", 6).alias("model_score"), "metadata_boost", F.round("final_score", 6).alias("final_score"), "rank_position")


@query(f"""WITH {_ALL}, b AS (SELECT query_id, chunk_id, model_score, combined_score, row_number() OVER (PARTITION BY query_id ORDER BY model_score DESC, chunk_id) AS rank_position FROM finals)
SELECT query_id, chunk_id, round(model_score, 6) AS model_score, round(combined_score, 6) AS combined_score, rank_position FROM b WHERE rank_position <= 5""")
def rerank_blend(spark, folder):
    q = benchmark_questions(spark, folder).select("query_id", F.concat(F.lit("How to define coverage: "), "question").alias("question"))
    chunks = stored_chunk_view(spark, folder)
    full = score_pairs(se.attach_chunks(cut_lineage(fused_hits(spark, folder, chunks)), chunks).join(q, "query_id"))
    out = se.rerank_blend(full, 5)
    return out.select("query_id", "chunk_id", F.round("model_score", 6).alias("model_score"), F.round("combined_score", 6).alias("combined_score"), "rank_position")


_FORMAT = """CASE WHEN concat_ws(', ', 'Section: ' || nullif(section_header, ''), 'Type: ' || nullif(chunk_type, '')) <> '' THEN '[' || concat_ws(', ', 'Section: ' || nullif(section_header, ''), 'Type: ' || nullif(chunk_type, '')) || ']' || chr(10) ELSE '' END || text || chr(10)"""
_BUDGET = f"budget AS (SELECT * FROM (SELECT *, sum(length(formatted)) OVER (PARTITION BY query_id ORDER BY rank_position)::BIGINT AS used_chars FROM (SELECT *, {_FORMAT} AS formatted FROM ranked)) WHERE used_chars <= 2000)"


@query(f"WITH {_ALL}, {_BUDGET} SELECT query_id, chunk_id, rank_position, formatted, used_chars FROM budget")
def context_budget(spark, folder):
    return ctx.within_budget(ranked_hits(spark, folder), 2000).select("query_id", "chunk_id", "rank_position", "formatted", "used_chars")


@query(f"""WITH {_ALL}, {_BUDGET}, h AS (SELECT query_id, md5(string_agg(left(text, 100), '|' ORDER BY rank_position)) AS context_hash FROM ranked WHERE rank_position <= 10 GROUP BY query_id)
SELECT b.query_id, string_agg(formatted, chr(10) ORDER BY rank_position) AS context, count(*) AS context_chunks, any_value(h.context_hash) AS context_hash FROM budget b JOIN h ON h.query_id = b.query_id GROUP BY b.query_id""")
def context_text(spark, folder):
    ranked = cut_lineage(ranked_hits(spark, folder))
    return ctx.structured_context(ctx.within_budget(ranked, 2000)).join(ctx.context_hashes(ranked), "query_id")


@query(f"""WITH {_ALL} SELECT query_id, array_to_string(list_sort(list_distinct(list(section_header))), '|') AS sections, array_to_string(list_sort(list_distinct(list(chunk_type))), '|') AS content_types,
  CASE WHEN count(DISTINCT nullif(company_name, '')) = 1 THEN max(company_name) END AS primary_company,
  round(coalesce(avg(CASE WHEN semantic_score > 0 THEN semantic_score END), 0), 6) AS search_precision,
  round((count(company_name) + count(section_header) + count(section_type) + count(chunk_type)) / (5.0::DOUBLE * count(*)), 6) AS metadata_completeness,
  count(*) AS total_results, round(avg(semantic_score), 6) AS avg_semantic_score, round(avg(combined_score), 6) AS avg_combined_score, round(arg_min(combined_score, rank_position), 6) AS top_result_score FROM ranked GROUP BY query_id""")
def context_analysis(spark, folder):
    ranked = cut_lineage(ranked_hits(spark, folder))
    a, s = ctx.context_analysis(ranked), ctx.search_stats(ranked)
    return a.join(s, "query_id").select(
        "query_id", F.array_join("sections_involved", "|").alias("sections"), F.array_join("content_types", "|").alias("content_types"), "primary_company",
        *[F.round(c, 6).alias(c) for c in ("search_precision", "metadata_completeness")], "total_results",
        *[F.round(c, 6).alias(c) for c in ("avg_semantic_score", "avg_combined_score", "top_result_score")])


# --- filters ------------------------------------------------------------------------------

def wanted_filters(spark, folder) -> DataFrame:
    """One filter per (language, source, company), with a type containment test."""
    docs = table(spark, folder, "documents").select(F.col("lang").alias("namespace"), F.col("source").alias("filter_section_type")).distinct()
    companies = F.array(F.lit("ENGL"), F.lit("span"))
    out = docs.withColumn("filter_company_name", F.explode(companies)).withColumns({
        "filter_policy_uin": F.lit(None).cast("string"), "filter_policy_type": F.lit("o"), "filter_chunk_type": F.lit("coverage"), "filter_file_name": F.lit("/1")})
    return out.withColumn("query_id", F.concat_ws("|", "namespace", "filter_section_type", "filter_company_name"))


_WANTED = "wanted AS (SELECT ns || '|' || source || '|' || co AS query_id, ns, source, co FROM (SELECT DISTINCT lang AS ns, source FROM documents), (VALUES ('ENGL'), ('span')) v(co))"
_PASSES = "c.namespace = w.ns AND c.section_type = w.source AND contains(lower(c.company_name), lower(w.co)) AND contains(lower(c.policy_type), 'o') AND c.chunk_type = 'coverage' AND contains(c.file_name, '/1')"


@query(f"WITH {CHUNKS_SQL}, {_WANTED} SELECT query_id, chunk_id, confidence_score, chunk_index FROM wanted w JOIN chunk c ON {_PASSES}")
def metadata_filter(spark, folder):
    return se.metadata_filter(wanted_filters(spark, folder), chunk_view(spark, folder))


@query(f"WITH {CHUNKS_SQL}, {_WANTED} SELECT query_id, CASE WHEN EXISTS (SELECT 1 FROM chunk c WHERE {_PASSES}) THEN source END AS section_type, CASE WHEN EXISTS (SELECT 1 FROM chunk c WHERE {_PASSES}) THEN co END AS company_name FROM wanted w")
def filter_fall_open(spark, folder):
    """Filters that no chunk of the namespace passes are dropped."""
    out = se.effective_filters(wanted_filters(spark, folder), chunk_view(spark, folder))
    return out.select("query_id", F.col("filter_section_type").alias("section_type"), F.col("filter_company_name").alias("company_name"))


def filtered_questions(spark, folder) -> DataFrame:
    """Questions that ask for long chunks of one company in their namespace."""
    return embedded_questions(spark, folder).withColumns({"filter_chunk_type": F.lit("coverage"), "filter_company_name": F.lit("english")})


@query(f"""WITH {CHUNKS_SQL}, {TERMS_SQL}, {_SEMANTIC},
 ok AS (SELECT s.* FROM sims s JOIN chunk c USING (chunk_id) WHERE c.chunk_type = 'coverage' AND contains(lower(c.company_name), 'english')),
 hits AS (SELECT DISTINCT t.query_id, c.chunk_id, c.confidence_score, c.chunk_index FROM terms t JOIN chunk c ON c.namespace = t.namespace AND contains(lower(c.text), t.t) WHERE c.chunk_type = 'coverage' AND contains(lower(c.company_name), 'english'))
SELECT query_id, chunk_id, 'semantic' AS side, rank_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank_position FROM ok) WHERE rank_position <= {K}
UNION ALL SELECT query_id, chunk_id, 'keyword', rank_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, chunk_index, chunk_id) AS rank_position FROM hits) WHERE rank_position <= {K}""")
def filtered_search(spark, folder):
    """Both sides with the filter applied before ranking."""
    q = filtered_questions(spark, folder)
    chunks = stored_chunk_view(spark, folder)
    used = ["company_name", "chunk_type"]
    v = chunk_vectors(chunks, used)
    semantic = vec.vector_top_k(q, v, K, match=block_filter(used), query_scope=["namespace", *[f"filter_{n}" for n in used]], vector_scope=["namespace", *used])
    keyword = se.keyword_top_k(q, chunks, K)
    cols = ["query_id", "chunk_id", "side", "rank_position"]
    return semantic.withColumn("side", F.lit("semantic")).select(*cols).unionByName(keyword.withColumn("side", F.lit("keyword")).select(*cols))


# --- several searches per question -----------------------------------------------------------

_HALVES = f"""halves AS (SELECT query_id || '#' || h AS query_id, namespace, array_to_string(CASE h WHEN 0 THEN ws[1:len(ws) // 2] ELSE ws[len(ws) // 2 + 1:] END, ' ') AS question
  FROM (SELECT *, {sql_words('question')} AS ws FROM (SELECT item_id || '@' || ns AS query_id, ns AS namespace, text AS question FROM benchmark, (SELECT DISTINCT lang AS ns FROM documents) v)), (VALUES (0), (1)) x(h))"""


@query(f"""WITH {CHUNKS_SQL}, {_HALVES}, {_SEMANTIC.replace('questions', 'halves')},
 merged AS (SELECT split_part(query_id, '#', 1) AS query_id, chunk_id, max(score) AS score, min(rank_position) AS r FROM sem GROUP BY ALL)
SELECT query_id, chunk_id, score, rank_position FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r, chunk_id) AS rank_position FROM merged) WHERE rank_position <= {K}""")
def multi_query_merge(spark, folder):
    """Each half of a question searched on its own, lists merged by best score."""
    w = words(F.col("question"))
    half = F.floor(F.size(w) / 2).cast("int")
    parts = F.array(F.array_join(F.slice(w, 1, half), " "), F.array_join(F.slice(w, half + 1, F.size(w) - half), " "))
    sub = benchmark_questions(spark, folder).select(F.col("query_id").alias("_q"), "namespace", F.posexplode(parts).alias("_h", "question"))
    sub = sub.withColumn("query_id", F.concat_ws("#", "_q", F.col("_h").cast("string")))
    hits = vec.vector_top_k(hashed_embedding(sub, "question", "vector"), chunk_vectors(chunk_view(spark, folder)), K)
    return se.best_per_chunk(hits.withColumn("query_id", F.split("query_id", "#")[0]), K)


@query(f"""WITH {CHUNKS_SQL}, {TERMS_SQL}, few AS (SELECT query_id FROM (SELECT DISTINCT t.query_id, c.chunk_id FROM questions q LEFT JOIN terms t USING (query_id) JOIN chunk c ON c.namespace = t.namespace AND contains(lower(c.text), t.t)) GROUP BY query_id HAVING count(*) >= 50),
 poor AS (SELECT * FROM questions WHERE query_id NOT IN (SELECT query_id FROM few)), vowels AS (SELECT query_id, namespace, unnest(['the', 'de']) AS t FROM poor),
 hits AS (SELECT DISTINCT v.query_id, c.chunk_id, c.confidence_score, c.chunk_index FROM vowels v JOIN chunk c ON c.namespace = v.namespace AND contains(lower(c.text), v.t))
SELECT query_id, chunk_id, rank_position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence_score DESC, chunk_index, chunk_id) AS rank_position FROM hits) WHERE rank_position <= {K}""")
def fallback_search(spark, folder):
    """Questions with fewer than fifty candidates are searched again by general terms."""
    q, chunks = question_terms(spark, folder), stored_chunk_view(spark, folder)
    first = se.keyword_top_k(q, chunks, 50)
    enough = write_once(first.groupBy("query_id").count().filter("count >= 50"))  # the second search reads it several times
    poor = q.join(enough, "query_id", "left_anti").withColumn("terms", F.array(F.lit("the"), F.lit("de")))
    return se.keyword_top_k(poor, chunks, K).select("query_id", "chunk_id", "rank_position")


@query()
def hybrid_search_full(spark, folder):
    """The whole hybrid search with intent, strategies, fallback and re-ranking."""
    chunks = stored_chunk_view(spark, folder)
    v = write_once(chunk_vectors(chunks, FILTERS))
    out = hybrid_search(benchmark_questions(spark, folder), chunks, v, k=K, terms=lambda c: F.array_distinct(words(F.lower(c))))
    return out.select("query_id", "chunk_id", "semantic_score", "metadata_score", "model_score", "metadata_boost", "final_score", "rank_position")


@query()
def answers(spark, folder):
    """Questions to extractive answers with their analysis."""
    chunks = stored_chunk_view(spark, folder)
    v = write_once(chunk_vectors(chunks, FILTERS))
    out = answer(benchmark_questions(spark, folder), chunks, v, terms=lambda c: F.array_distinct(words(F.lower(c))))
    lists = [F.array_join(c, "|").alias(c) for c in ("sources", "sections_involved", "content_types")]
    return out.select(*[c for c in out.columns if c not in ("sources", "sections_involved", "content_types")], *lists)


