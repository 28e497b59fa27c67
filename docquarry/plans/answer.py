"""Questions to answers: retrieval, context, reply, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.ids import context_hash, memo_key
from docquarry.functions.replies import parse_reply
from docquarry.functions.text import lit_array, query_with_suffix
from docquarry.operators import context as ctx
from docquarry.operators.domain import detect_domain, metadata_text, with_domain_settings
from docquarry.plans.hybrid import hybrid_search
from docquarry.plans.reuse import replies_with_memo
from docquarry.scale import cut_lineage
from docquarry.slots import answer_prompts

NOT_FOUND = "No relevant information found in the document for this query."


def prepare_questions(queries: DataFrame) -> DataFrame:
    """Add domain, its settings, the question with its domain suffix and the document
    level filters. Document columns may be missing."""
    def column(name: str) -> Column:
        return F.col(name) if name in queries.columns else F.lit(None).cast("string")

    text = metadata_text(column("document_text"), column("title"), column("policy_type"), column("company_name"))
    df = with_domain_settings(queries.withColumn("domain", detect_domain(text, column("file_type"), column("title"))))
    df = df.withColumn("asked", F.col("question"))
    df = df.withColumn("question", F.when(F.col("expands"), query_with_suffix(F.col("question"), F.col("domain"))).otherwise(F.col("question")))
    return df.withColumns({f"user_{n}": column(n) for n in ("policy_type", "company_name", "policy_uin")})


def answer(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, *, answerer=None, k: int = 60,
           budget: int = lx.CONTEXT_BUDGET, memo: str | None = None, now: Column | None = None, **search) -> DataFrame:
    """One answer row per question, with its analysis and retrieval statistics.

    Questions without results get a fixed row with confidence 0. A question whose prompt the
    answerer fails on gets an error row; the others are answered. With ``memo``, the path of a
    stored table, a reply for the same context and question is used again while it is fresh."""
    q = prepare_questions(queries.withColumn("query_id", F.col("query_id").cast("string")))
    results = cut_lineage(hybrid_search(
        q.select("query_id", "namespace", "question", "top_k", "domain", *[c for c in q.columns if c.startswith("user_")]),
        chunks, vectors, k=k, k_column="top_k", domain_column="domain", **search))
    analysis = ctx.context_analysis(results)
    within = ctx.within_budget(results, budget)
    context = ctx.structured_context(within).join(ctx.context_sources(within), "query_id")
    stats = ctx.search_stats(results)
    best = results.filter(F.col("rank_position") == 1).select("query_id", F.col("text").alias("best_text"), F.col("final_score").alias("best_match_score"))
    ready = q.select("query_id", "namespace", "domain", "asked", "question").join(best, "query_id").join(context, "query_id")
    ready = ready.join(analysis, "query_id").join(stats, "query_id")
    ready = ready.withColumn("prompt", F.concat(
        ctx.system_prompt(F.col("primary_policy_uin"), F.col("primary_company"), F.col("sections_involved"), F.col("content_types")),
        F.lit("\n"), ctx.user_prompt(F.col("asked"), F.col("context"))))

    def reply(rows: DataFrame) -> DataFrame:
        return answer_prompts(rows, answerer, sources="source_chunks", score="best_match_score")

    if memo is None:
        replied = reply(ready)
    else:
        texts = F.transform(F.sort_array(F.collect_list(F.struct("rank_position", "text"))), lambda x: x["text"])
        ready = ready.join(results.filter("rank_position <= 10").groupBy("query_id").agg(context_hash(texts).alias("context_key")), "query_id")
        replied = replies_with_memo(ready, memo, now if now is not None else F.current_timestamp(), reply, memo_key(F.lit("answer"), F.col("context_key"), F.col("asked")))
    parsed = parse_reply(F.col("reply"))
    failed = F.col("reply_error").isNotNull()
    instead = {"answer": F.concat(F.lit("Error processing query: "), "reply_error"), "confidence": F.lit(0.0), "reasoning": F.concat(F.lit("Processing error: "), "reply_error"), "sources": lit_array([]), "error": F.lit(True)}
    replied = replied.withColumns({f"r_{n}": F.when(failed, instead[n]).otherwise(c) if n in instead else c for n, c in parsed.items()})
    keep = ["primary_policy_uin", "primary_company", "sections_involved", "content_types", "search_precision", "metadata_completeness",
            "total_results", "avg_semantic_score", "avg_combined_score", "top_result_score", "best_match_score"]
    done = replied.select("query_id", *[c for c in replied.columns if c.startswith("r_")], *keep)
    out = q.select("query_id", "namespace", "domain", F.col("asked").alias("question"), F.col("question").alias("enhanced_query")).join(done, "query_id", "left")
    found = F.col("r_answer").isNotNull()
    return out.select(
        "query_id", "namespace", "domain", "question", "enhanced_query",
        F.coalesce("r_answer", F.lit(NOT_FOUND)).alias("answer"), F.coalesce("r_confidence", F.lit(0.0)).alias("confidence"),
        F.when(found, F.col("r_reasoning")).otherwise(F.lit("No matching content found")).alias("reasoning"),
        F.coalesce("r_sources", lit_array([])).alias("sources"), F.coalesce("r_error", F.lit(False)).alias("error"), *keep,
    ).withColumn("total_results", F.coalesce("total_results", F.lit(0)))
