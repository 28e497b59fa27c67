"""Keyword top-k, metadata filters, fusion and re-ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import contains_any
from docquarry.operators.intent import FILTERS
from docquarry.operators.keywords import best_per_term
from docquarry.operators.postings import best_by_postings, is_one_word, postings
from docquarry.scale import broadcast_if_small, top_k, write_once

EXACT = {"policy_uin", "section_type", "chunk_type"}


def filter_test(filters: dict[str, Column], columns: dict[str, Column]) -> Column:
    """A chunk passes when every given filter holds: equality for ids and types,
    containment in any case for names."""
    test = F.lit(True)
    for n, f in filters.items():
        c = columns[n]
        hit = (c == f) if n in EXACT else F.lower(c).contains(F.lower(f))
        test = test & (f.isNull() | F.coalesce(hit, F.lit(False)))
    return test


def metadata_filter(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Allowed chunks per query: query_id, chunk_id, confidence_score, chunk_index.

    Its size is that of its answer, so it serves reports on selective filters;
    the search operators apply the filter inside their own joins instead.
    """
    q = broadcast_if_small(queries.select("query_id", F.col("namespace").alias("_ns"), *[f"filter_{n}" for n in FILTERS]))
    test = filter_test({n: F.col(f"filter_{n}") for n in FILTERS}, {n: F.col(n) for n in FILTERS})
    c = chunks.select("namespace", "chunk_id", "confidence_score", "chunk_index", *FILTERS)
    joined = c.join(q, (F.col("namespace") == F.col("_ns")) & test)
    return joined.select("query_id", "chunk_id", "confidence_score", "chunk_index")


def effective_filters(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Drop the filters of a query that no chunk of its namespace passes.

    Chunks stream past the distinct filters of their namespace and leave only
    the filters that held, so what is shuffled is as small as the filters."""
    names = [f"filter_{n}" for n in FILTERS]
    wanted = queries.select(F.col("namespace").alias("_ns"), *names).distinct()
    test = filter_test({n: F.col(f"filter_{n}") for n in FILTERS}, {n: F.col(n) for n in FILTERS})
    seen = chunks.select("namespace", *FILTERS).join(broadcast_if_small(wanted), (F.col("namespace") == F.col("_ns")) & test)
    live = seen.select("_ns", *names).distinct()
    same = (F.col("namespace") == F.col("_l__ns")) & reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_l_{n}")) for n in names])
    flagged = live.select(*[F.col(c).alias(f"_l_{c}") for c in live.columns]).withColumn("_live", F.lit(True))
    joined = queries.join(broadcast_if_small(flagged), same, "left")
    kept = {n: F.when(F.col("_live"), F.col(n)) for n in names}
    return joined.withColumns(kept).select(*queries.columns)


def scope_key(*columns: Column) -> Column:
    """One string per combination of nullable columns."""
    return F.to_json(F.array(*[F.coalesce(c, F.lit("\u0000")) for c in columns]))


def keyword_top_k(queries: DataFrame, chunks: DataFrame, k: int = 20, *, terms: str = "terms", per_query_k: str | None = None,
                  salts: int = 1, indexed: bool = False) -> DataFrame:
    """Chunks that contain any search term, best confidence first:
    query_id, chunk_id, score, rank_position.

    The k best chunks of each distinct (namespace, filter, term) are found first; a query then
    only merges the short lists of its terms. Terms are looked for in blocks of texts, or with ``indexed`` in
    an inverted index of the scopes that are asked; terms that span words or are very long in blocks.
    """
    used = [n for n in FILTERS if f"filter_{n}" in queries.columns]
    names = [f"filter_{n}" for n in used]
    limit = F.col(per_query_k) if per_query_k else F.lit(k)
    asked = queries.select("query_id", F.col("namespace").alias("_ns"), *names, limit.alias("_k"),
                           F.explode(F.array_distinct(F.transform(terms, lambda t: F.lower(t)))).alias("term"))
    asked = asked.withColumn("_scope", scope_key(F.col("_ns"), *[F.col(n) for n in names])).filter("term <> ''")
    wanted = asked.select("_ns", *names, "_scope", "term").distinct()
    wanted = write_once(wanted) if indexed else wanted
    texts = [F.lower("text")] + ([F.lower(F.array_join("keywords", " "))] if "keywords" in chunks.columns else [])
    c = chunks.select("namespace", "chunk_id", "confidence_score", "chunk_index", *used, F.concat_ws("\u0000", *texts).alias("haystack"))
    match = filter_test({n: F.col(f"filter_{n}") for n in used}, {n: F.col(n) for n in used})
    order = [F.col("confidence_score").desc(), F.col("chunk_index"), F.col("chunk_id")]
    if not indexed:
        best = best_per_term(c, wanted, k, names, match, used, salts)
    elif wanted.isEmpty():
        best = queries.sparkSession.createDataFrame([], "_scope string, term string, chunk_id string, confidence_score double, chunk_index bigint")
    else:
        scopes = broadcast_if_small(wanted.select("_ns", *names, "_scope").distinct())
        scoped = c.join(scopes, (F.col("namespace") == F.col("_ns")) & match)
        index = write_once(postings(scoped, ["_scope"], k, salts))
        best = best_by_postings(index, wanted.filter(is_one_word(F.col("term"))), k, salts=salts)
        spanning = wanted.filter(~is_one_word(F.col("term")))
        if not spanning.isEmpty():
            best = best.unionByName(best_per_term(c, spanning, k, names, match, used, salts))
    hits = asked.select("query_id", "_scope", "term", "_k").join(best, ["_scope", "term"])
    hits = hits.select("query_id", "_k", "chunk_id", "confidence_score", "chunk_index").distinct()
    ranked = top_k(hits, ["query_id"], order, "_k", bound=k)
    score = (F.lit(1.0) - (F.col("rank_position") - 1) * F.lit(0.01)) * F.col("confidence_score")
    return ranked.select("query_id", "chunk_id", score.alias("score"), "rank_position")


def keyword_predicate(text: Column, keywords: Column, terms: Column, wildcards: bool = False) -> Column:
    """Any term in the text or the keywords, any case. ``%`` and ``_`` are literal
    unless ``wildcards`` asks for the pattern reading."""
    low, kw = F.lower(text), F.lower(F.array_join(keywords, " "))
    if wildcards:
        like = lambda c, t: F.like(c, F.concat(F.lit("%"), F.lower(t), F.lit("%")))
        return F.exists(terms, lambda t: like(low, t) | like(kw, t))
    return F.exists(terms, lambda t: F.contains(low, F.lower(t)) | F.contains(kw, F.lower(t)))


def best_per_chunk(hits: DataFrame, k: int, keys=("query_id",), score: str = "score", per_query_k: str | None = None) -> DataFrame:
    """Merge ranked result sets: best score per chunk, then top-k; earlier ranks win ties.

    ``per_query_k`` names a column with the limit of each query, at most ``k``."""
    limit = [F.max(per_query_k).alias(per_query_k)] if per_query_k else []
    merged = hits.groupBy(*keys, "chunk_id").agg(F.max(score).alias(score), F.min("rank_position").alias("_r"), *limit)
    ranked = top_k(merged, keys, [F.col(score).desc(), F.col("_r"), F.col("chunk_id")], per_query_k or k, bound=k).drop("_r")
    return ranked.drop(per_query_k) if per_query_k else ranked


def first_rank_per_chunk(hits: DataFrame) -> DataFrame:
    """Merge ranked lists of one side: best rank and best score per chunk, re-ranked."""
    merged = hits.groupBy("query_id", "chunk_id").agg(F.min("rank_position").alias("_r"), F.max("score").alias("score"))
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy("_r", F.col("score").desc(), "chunk_id")
    return merged.withColumn("rank_position", F.row_number().over(order)).drop("_r")


def reciprocal_rank_fusion(semantic: DataFrame, keyword: DataFrame, k: int, *, per_query_k: DataFrame | None = None) -> DataFrame:
    """Fuse two ranked lists: query_id, chunk_id, semantic_score, metadata_score,
    combined_score, rank_position.

    A chunk found by only one side gets nothing from the other; the keyword score
    is reported only for chunks the semantic side did not find.
    """
    s = semantic.select("query_id", "chunk_id", F.col("rank_position").alias("sr"), F.col("score").alias("ss"))
    w = keyword.select("query_id", "chunk_id", F.col("rank_position").alias("kr"), F.col("score").alias("ks"))
    both = s.join(w, ["query_id", "chunk_id"], "full_outer")
    part = lambda r, weight: F.coalesce(F.lit(1.0) / (F.lit(lx.RRF_K) + F.col(r)) * F.lit(weight), F.lit(0.0))
    fused = both.select(
        "query_id", "chunk_id", F.coalesce("ss", F.lit(0.0)).alias("semantic_score"),
        F.when(F.col("sr").isNull(), F.coalesce("ks", F.lit(0.0))).otherwise(F.lit(0.0)).alias("metadata_score"),
        F.round(part("sr", lx.RRF_SEMANTIC) + part("kr", lx.RRF_KEYWORD), 12).alias("combined_score"))
    order = [F.col("combined_score").desc(), F.col("chunk_id")]
    if per_query_k is None:
        return top_k(fused, ["query_id"], order, k)
    return top_k(fused.join(per_query_k, "query_id"), ["query_id"], order, "_k", bound=k).drop("_k")


def attach_chunks(hits: DataFrame, chunks: DataFrame, columns=("text", *FILTERS, "section_header")) -> DataFrame:
    """Full chunk text and metadata of the hits.

    Hits are few per query; a checked broadcast of them keeps the chunk table
    unshuffled. Beyond the bound Spark joins on the key, pruned by its runtime filter.
    """
    payload = chunks.select("chunk_id", *columns)
    return payload.join(broadcast_if_small(hits, 200_000), "chunk_id")


def rerank_blend(results: DataFrame, k: int, model_score: str = "model_score") -> DataFrame:
    """Blend 0.3 of the fused score with 0.7 of the model score; order by the model score."""
    m = F.coalesce(F.col(model_score), F.lit(0.0))
    blended = F.when(F.col(model_score).isNotNull(), F.col("combined_score") * 0.3 + m * 0.7).otherwise(F.col("combined_score"))
    df = results.drop("rank_position").withColumn("combined_score", blended).withColumn(model_score, m)
    return top_k(df, ["query_id"], [F.col(model_score).desc(), F.col("chunk_id")], k)


def metadata_boost(question: Column, columns: dict[str, Column], rules=lx.BOOST_RULES, cap: float = lx.BOOST_CAP) -> Column:
    """Capped sum of additions for chunk metadata that suits the question."""
    q = F.lower(question)
    total = F.lit(0.0)
    for words, tests in rules:
        asked = contains_any(q, words)
        for name, kind, values, boost in tests:
            column = F.coalesce(columns[name], F.lit(""))
            hit = column.isin(values) if kind == "is" else contains_any(F.lower(column), values)
            total = total + F.when(asked & hit, boost).otherwise(0.0)
    return F.round(F.least(total, F.lit(cap)), 6)


def rerank_with_boost(results: DataFrame, k: int | str, question: str = "question", model_score: str = "model_score", bound: int | None = None) -> DataFrame:
    """final_score = model score + metadata boost, top-k per query."""
    columns = {n: F.col(n) for n in ("chunk_type", "section_type", "section_header")}
    df = results.drop("rank_position").withColumn("metadata_boost", metadata_boost(F.col(question), columns))
    df = df.withColumn("final_score", F.round(F.coalesce(F.col(model_score), F.lit(0.0)) + F.col("metadata_boost"), 9))
    return top_k(df, ["query_id"], [F.col("final_score").desc(), F.col("chunk_id")], k, bound=bound)
