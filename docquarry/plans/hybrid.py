"""Hybrid retrieval for many questions at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import query_with_context
from docquarry.operators import expand, search
from docquarry.operators.intent import FILTERS, merge_filters, with_intent
from docquarry.operators.vectors import vector_top_k
from docquarry.scale import cut_lineage
from docquarry.slots import hashed_embedding, score_pairs


def plan_queries(queries: DataFrame, chunks: DataFrame, k: int, k_column: str | None, rules, domain_column: str | None = None) -> DataFrame:
    """Questions with filters, strategy, k and the texts to search for.

    With ``domain_column`` the expansion rules are those of each question's domain."""
    q = search.effective_filters(merge_filters(with_intent(queries)), chunks)
    question = F.col("question")

    def ruled(build) -> Column:
        return expand.per_domain(F.col(domain_column), lx.EXPANSION, build) if domain_column else build(rules)

    synonyms = ruled(lambda r: expand.pattern_terms(question, r))
    terms = F.when(F.col("strategy") == "original", expand.pattern_terms(F.lit(""), [])).when(
        F.col("strategy") == "pattern", synonyms).otherwise(expand.distinct_terms(synonyms, expand.numeric_terms(question)))
    multi = ruled(lambda r: expand.strategy_sub_queries(question, F.col("strategy"), r))
    texts = F.when(F.col("strategy") == "multi_query", multi).otherwise(F.array(expand.expanded_query(question, terms)))
    wanted = F.least(F.col(k_column), F.lit(k)) if k_column else F.lit(k)
    return q.withColumn("search_texts", texts).withColumn("_k", wanted.cast("int"))


def block_filter(names: list[str]):
    """The metadata filter between a block of queries and a block of vectors."""
    def match(side: DataFrame, blocks: DataFrame) -> Column:
        return search.filter_test({n: side[f"q_filter_{n}"] for n in names}, {n: blocks[n] for n in names})

    return match


def used_filters(q: DataFrame) -> list[str]:
    """Filter columns that any query sets; the others need not split the blocks."""
    row = q.agg(*[F.max(F.col(f"filter_{n}").isNotNull()).alias(n) for n in FILTERS]).first()
    return [n for n in FILTERS if row[n]]


def semantic_hits(q: DataFrame, vectors: DataFrame, k: int, embedder, context: Column | None, filters: list[str], salts: int) -> DataFrame:
    """Vector top-k of search rows (query_id, namespace, search_text, _k, filters)."""
    text = query_with_context(F.col("search_text"), context) if context is not None else F.col("search_text")
    q = embedder(q.withColumn("_t", text), "_t", "vector")
    return vector_top_k(
        q, vectors, k, per_query_k="_k", query_scope=["namespace", *[f"filter_{n}" for n in filters]],
        vector_scope=["namespace", *filters], match=block_filter(filters) if filters else None, salts=salts)


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    *,
    k: int = 20,
    k_column: str | None = None,
    embedder: Callable[[DataFrame, str, str], DataFrame] = hashed_embedding,
    scorer=None,
    rules=lx.EXPANSION["insurance"],
    terms: Callable[[Column], Column] = expand.enriched_terms,
    fallback_terms: Callable[[Column], Column] = expand.health_terms,
    fallback_below: int = 5,
    context: str | None = "insurance",
    salts: int = 1,
    sub_query_k: int | None = None,
    fused_k: int | None = None,
    rerank_k: int | None = None,
    domain_column: str | None = None,
) -> DataFrame:
    """Re-ranked results per question.

    ``queries``: query_id, namespace, question and optional user_<filter> columns.
    ``chunks``: the chunk table. ``vectors``: chunk_id, namespace, embedding and
    the filter columns of the chunk. The same plan serves every strategy: a
    question becomes one or more search texts, lists are merged per question, and
    multi-query questions with too few candidates are searched again without filters.

    ``sub_query_k`` bounds the list of each sub-query, ``fused_k`` the fused list and
    ``rerank_k`` what the scorer sees; by default 20, 60 and 40, or more where ``k`` asks
    for more. Lists are merged to the k of their question. ``domain_column`` names a column of
    ``queries`` whose domain chooses rules and context per question, instead of ``rules`` and
    ``context``.
    """
    domain = [domain_column] if domain_column else []
    context = F.col(domain_column) if domain_column else None if context is None else F.lit(context)
    sub_query_k, fused_k, rerank_k = sub_query_k or max(20, k), max(fused_k or 60, 2 * k), max(rerank_k or 40, k)
    q = cut_lineage(plan_queries(queries.withColumn("query_id", F.col("query_id").cast("string")), chunks, k, k_column, rules, domain_column))
    filters = used_filters(q)
    multi = F.col("strategy") == "multi_query"
    sub = q.select("query_id", "namespace", "strategy", *domain, *[f"filter_{n}" for n in filters],
                   F.posexplode("search_texts").alias("_sub", "search_text"),
                   F.when(multi, F.least("_k", F.lit(sub_query_k))).otherwise(F.col("_k")).alias("_limit"))
    sub = sub.withColumn("query_id", F.concat_ws("\u0001", "query_id", F.col("_sub").cast("string"))).withColumnRenamed("_limit", "_k")
    semantic = semantic_hits(sub, vectors, k, embedder, context, filters, salts)
    keyword = search.keyword_top_k(sub.withColumn("terms", expand.search_terms(terms(F.col("search_text")))), chunks, k, per_query_k="_k", salts=salts)

    def merged(hits: DataFrame) -> DataFrame:
        whole = hits.withColumn("query_id", F.split("query_id", "\u0001")[0])
        return search.best_per_chunk(whole.join(q.select("query_id", "_k"), "query_id"), k, per_query_k="_k")

    hits = merged(semantic).withColumn("side", F.lit("semantic")).unionByName(merged(keyword).withColumn("side", F.lit("keyword")))
    hits = cut_lineage(hits)

    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    poor = q.join(found, "query_id", "left").filter(multi & (F.coalesce("_n", F.lit(0)) < fallback_below))
    poor = poor.withColumn("_k", F.col("_k") * 3).withColumn("search_text", F.col("question"))
    again = poor.select("query_id", "namespace", "search_text", "_k", *domain)
    broad = semantic_hits(again, vectors, 3 * k, embedder, context, [], salts)
    own = search.keyword_top_k(again.withColumn("terms", expand.search_terms(terms(F.col("search_text")))), chunks, 3 * k, per_query_k="_k", salts=salts)
    extra = again.withColumn("terms", expand.search_terms(fallback_terms(F.col("search_text")))).withColumn("_k", (F.col("_k") * 2 / 3).cast("int"))
    extra = search.keyword_top_k(extra, chunks, 2 * k, per_query_k="_k", salts=salts)
    rescued = search.first_rank_per_chunk(own.unionByName(extra))
    kept = hits.join(poor.select("query_id"), "query_id", "left_anti")
    side = lambda name: kept.filter(F.col("side") == name).drop("side")
    fused = search.reciprocal_rank_fusion(
        side("semantic").unionByName(broad), side("keyword").unionByName(rescued), fused_k,
        per_query_k=q.select("query_id", F.least(F.col("_k") * 2, F.lit(fused_k)).alias("_k")))
    fused = fused.filter(F.col("rank_position") <= rerank_k)
    full = search.attach_chunks(fused, chunks).join(q.select("query_id", "question", "namespace", "_k"), "query_id")
    scored = score_pairs(full, scorer)
    ranked = search.rerank_with_boost(scored.withColumn("combined_score", F.col("combined_score") * 0.3 + F.col("model_score") * 0.7), "_k", bound=k)
    return ranked.drop("_k")
