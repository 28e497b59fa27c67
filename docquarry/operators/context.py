"""From ranked results to prompts, and statistics of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.ids import context_hash

ANALYSED = ["policy_uin", "company_name", "section_header", "section_type", "chunk_type"]


def format_chunk(text: Column, policy_uin: Column, section_header: Column, chunk_type: Column) -> Column:
    """Chunk text under a bracketed line with its known metadata."""
    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    head = F.concat_ws(", ", part("Policy UIN: ", policy_uin), part("Section: ", section_header), part("Type: ", chunk_type))
    return F.concat(F.when(head != "", F.concat(F.lit("["), head, F.lit("]\n"))).otherwise(F.lit("")), text, F.lit("\n"))


def within_budget(results: DataFrame, budget: int = lx.CONTEXT_BUDGET) -> DataFrame:
    """Results in rank order while the formatted text stays within the budget;
    the first overflow ends the context. Adds ``formatted`` and ``used_chars``."""
    df = results.withColumn("formatted", format_chunk(F.col("text"), F.col("policy_uin"), F.col("section_header"), F.col("chunk_type")))
    running = Window.partitionBy("query_id").orderBy("rank_position").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("used_chars", F.sum(F.length("formatted")).over(running))
    return df.filter(F.col("used_chars") <= budget)


def structured_context(selected: DataFrame) -> DataFrame:
    """One context string per query from budgeted results, in rank order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank_position", "formatted")))
    return selected.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["formatted"]), "\n").alias("context"),
        F.count(F.lit(1)).cast("int").alias("context_chunks"))


def context_hashes(results: DataFrame, items: int = 10, chars: int = 100) -> DataFrame:
    head = results.filter(F.col("rank_position") <= items).select("query_id", "rank_position", F.left("text", F.lit(chars)).alias("head"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank_position", "head"))), lambda x: x["head"])
    return head.groupBy("query_id").agg(context_hash(ordered, items, chars).alias("context_hash"))


def context_analysis(results: DataFrame) -> DataFrame:
    """Per query: distinct metadata, the primary policy and company if unique,
    precision (mean positive semantic score) and metadata completeness."""
    filled = {n: F.nullif(F.col(n), F.lit("")) for n in ANALYSED}

    def values(n: str) -> Column:
        return F.array_sort(F.collect_set(filled[n]))

    present = sum((F.when(filled[n].isNotNull(), 1).otherwise(0) for n in ANALYSED), F.lit(0))
    df = results.groupBy("query_id").agg(
        values("policy_uin").alias("_uins"), values("company_name").alias("_companies"),
        values("section_header").alias("sections_involved"), values("chunk_type").alias("content_types"),
        values("section_type").alias("section_types"),
        F.coalesce(F.avg(F.when(F.col("semantic_score") > 0, F.col("semantic_score"))), F.lit(0.0)).alias("search_precision"),
        (F.sum(present) / (F.count(F.lit(1)) * len(ANALYSED))).alias("metadata_completeness"))
    only = lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))
    return df.withColumn("primary_policy_uin", only("_uins")).withColumn("primary_company", only("_companies")).drop("_uins", "_companies")


def context_sources(within: DataFrame) -> DataFrame:
    """Chunk ids of each context in rank order; the budget bounds their number."""
    ids = F.sort_array(F.collect_list(F.struct("rank_position", "chunk_id")))
    return within.groupBy("query_id").agg(F.transform(ids, lambda x: x["chunk_id"]).alias("source_chunks"))


def search_stats(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("total_results"), F.avg("semantic_score").alias("avg_semantic_score"),
        F.avg("combined_score").alias("avg_combined_score"),
        F.min_by("combined_score", "rank_position").alias("top_result_score"))


def system_prompt(policy: Column, company: Column, sections: Column, types: Column) -> Column:
    """Instructions for an answering model, from the analysis of the context."""
    scope = (
        F.when(policy.isNotNull(), F.concat(F.lit("The question concerns policy "), policy, F.lit(".\n")))
        .when(company.isNotNull(), F.concat(F.lit("The question concerns documents of "), company, F.lit(".\n")))
        .otherwise(F.lit("The question is not tied to one document.\n")))
    listed = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c, ", "), F.lit(".\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("Answer from the given passages only. Quote figures, limits and terms exactly, list every condition "
              "that applies, and say so when the passages do not settle the question.\n"),
        scope, listed("Sections present: ", sections), listed("Kinds of content: ", types),
        F.lit("Reply with one JSON object: answer, confidence (0 to 1), reasoning, sources, additional_info.\n"))


def user_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nPassages:\n---\n"), context,
                    F.lit("---\n\nUse nothing but these passages and cover every detail that matters.\n"))


def expansion_prompt(question: Column, domain: str, kind: Column) -> Column:
    """Prompt that asks a model for search terms, definitions or three sub-queries."""
    goal = (
        F.when(kind == "procedural", F.lit("Rewrite it as three searches, one per line, marked A) keywords, B) plain question, C) section titles."))
        .when(kind == "definition", F.lit("List terms and titles under which it may be defined, one per line."))
        .otherwise(F.lit("List five to eight related terms, one per line.")))
    return F.concat(F.lit(f"A reader of {domain} documents asks: \""), question, F.lit("\"\n"), goal)


