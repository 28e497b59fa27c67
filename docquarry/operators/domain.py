"""Document classification by lexicon: company, policy type, domain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import first_match, let, occurrences, pattern_count, policy_id

SCORED = "array<struct<score:double,ord:int,name:string>>"


def _total(cols) -> Column:
    return reduce(lambda a, b: a + b, cols)


def _best(scores: list[tuple[str, Column]]) -> Column:
    """Highest score as a struct(score, ord, name); the earlier entry wins a tie."""
    entries = [
        F.struct(s.cast("double").alias("score"), F.lit(-i).alias("ord"), F.lit(n).alias("name"))
        for i, (n, s) in enumerate(scores)
    ]
    return F.array_max(F.array(*entries).cast(SCORED))


def company_hits(text: Column, companies=lx.COMPANY_PATTERNS, lowered: bool = False) -> Column:
    """Best company by its most frequent pattern: struct(score, ord, name).

    ``lowered`` says that the text is lower-cased already."""

    def best(low: Column) -> Column:
        scored = []
        for name, patterns in companies:
            counts = [pattern_count(low, p) for p in patterns]
            scored.append((name, F.greatest(*counts) if len(counts) > 1 else counts[0]))
        return _best(scored)

    return let(text if lowered else F.lower(text), best)


def company_columns(text: Column, companies=lx.COMPANY_PATTERNS) -> dict[str, Column]:
    best = company_hits(text, companies)
    return {
        "company_name": F.when(best["score"] > 0, best["name"]),
        "confidence_score": F.least(best["score"] / F.lit(10.0), F.lit(1.0)),
    }


def policy_type(text: Column, types=lx.POLICY_TYPE_TERMS, lowered: bool = False) -> Column:
    """Type whose terms occur most often; NULL when none occurs.

    ``lowered`` says that the text is lower-cased already."""

    def best(low: Column) -> Column:
        return _best([(name, _total([occurrences(low, t) for t in terms])) for name, terms in types])

    return let(let(text if lowered else F.lower(text), best), lambda b: F.when(b["score"] > 0, b["name"]))


def _best_domain(text: Column, lexicon) -> Column:
    def best(low: Column) -> Column:
        scored = []
        for name, keywords, patterns in lexicon:
            present = [F.when(low.contains(k), F.lit(0.05)).otherwise(F.lit(0.0)) for k in keywords]
            matches = [F.regexp_count(low, F.lit("(?i)" + p)) * F.lit(0.1) for p in patterns]
            scored.append((name, F.round(_total(present + matches), 2)))
        return _best(scored)

    return let(F.lower(text), best)


def domain_by_score(text: Column, lexicon=lx.DOMAIN_LEXICON, threshold: float = lx.DOMAIN_THRESHOLD) -> dict[str, Column]:
    """Weighted presence of words and pattern matches; general below the threshold."""
    best = _best_domain(text, lexicon)
    return {
        "domain": let(best, lambda b: F.when(b["score"] > threshold, b["name"]).otherwise(F.lit("general"))),
        "domain_score": best["score"],
    }


def domain_by_vote(text: Column, lexicon=lx.DOMAIN_VOTE) -> Column:
    """Domain with most distinct words present; the first one when nothing occurs."""

    def best(low: Column) -> Column:
        return _best([(n, _total([F.when(low.contains(k), 1).otherwise(0) for k in ks])) for n, ks in lexicon])

    return let(F.lower(text), best)["name"]


def domain_by_metadata(file_type: Column, title: Column) -> Column:
    by_title = first_match(F.lower(F.coalesce(title, F.lit(""))), lx.TITLE_DOMAIN, F.lit("general"))
    return first_match(F.lower(F.coalesce(file_type, F.lit(""))), lx.FILE_TYPE_DOMAIN, by_title)


def detect_domain(text: Column, file_type: Column, title: Column, lexicon=lx.DOMAIN_LEXICON) -> Column:
    """Metadata decides when it can, the text otherwise."""
    by_meta = domain_by_metadata(file_type, title)
    return F.when(by_meta != "general", by_meta).otherwise(domain_by_score(text, lexicon)["domain"])


def metadata_text(document_text: Column, title: Column, policy: Column, company: Column) -> Column:
    """Text used for detection when the document text is missing."""
    parts = [F.coalesce(c, F.lit("")) for c in (title, policy, company)]
    return F.when(F.coalesce(document_text, F.lit("")) != "", document_text).otherwise(F.concat_ws(" ", *parts))


def named_domain(name: Column, text: Column) -> Column:
    """Requested domain name; ``auto`` votes on the text; unknown names are insurance."""
    low = F.lower(name)
    auto = (low == "auto") & (F.coalesce(text, F.lit("")) != "")
    return F.when(auto, domain_by_vote(text)).when(low.isin(lx.NAMED_DOMAINS), low).otherwise(F.lit("insurance"))


def is_primary_domain(domain: Column) -> Column:
    return domain.isin(lx.PRIMARY_DOMAINS)


def domain_settings(spark) -> DataFrame:
    return spark.createDataFrame(
        lx.DOMAIN_SETTINGS,
        "domain STRING, chunk_size INT, chunk_overlap INT, top_k INT, rerank_k INT, expands BOOLEAN",
    )


def with_domain_settings(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Attach the settings row of each domain; unknown domains get the general row.

    The settings are a handful of literals, so they are columns of the plan and
    not a join."""
    names = ["chunk_size", "chunk_overlap", "top_k", "rerank_k", "expands"]
    rows = {row[0]: row[1:] for row in lx.DOMAIN_SETTINGS}
    chosen = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, rows["general"])])
    for name, values in rows.items():
        chosen = F.when(F.col(domain) == name,
                        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])).otherwise(chosen)
    return df.withColumn("_s", chosen).select("*", "_s.*").drop("_s")


def document_metadata(
    df: DataFrame,
    text: str = "text",
    source: str = "source",
    companies=lx.COMPANY_PATTERNS,
    types=lx.POLICY_TYPE_TERMS,
    id_patterns=lx.POLICY_ID_PATTERNS,
) -> DataFrame:
    """Add file_name, policy_uin, company_name, policy_type, confidence_score."""
    t = F.col(text)
    best = company_hits(t, companies)
    return (
        df.withColumn("file_name", F.element_at(F.split(F.col(source), "/"), -1))
        .withColumn("policy_uin", policy_id(t, id_patterns))
        .withColumn("_company", best)
        .withColumn("company_name", F.when(F.col("_company.score") > 0, F.col("_company.name")))
        .withColumn("confidence_score", F.least(F.col("_company.score") / F.lit(10.0), F.lit(1.0)))
        .withColumn("policy_type", policy_type(t, types))
        .drop("_company")
    )


