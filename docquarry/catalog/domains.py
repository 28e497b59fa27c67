"""Document classification over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.catalog.views import COMPANIES, COMPANY_SQL, TYPE_SQL, TYPES, sql_any, sql_best, sql_case, sql_matches, sql_text, table, tidy
from docquarry.operators import domain as dm

QUERIES, SQL = {}, {}
LANGUAGES = [
    ("english", ["the", "and", "that", "with", "which"], [r"of\s+the", r"\sin\s"]),
    ("french", ["les", "des", "que", "pour", "avec"], [r"de\s+la", r"\sle\s"]),
    ("german", ["der", "und", "nicht", "sch", "ich"], [r"in\s+der", r"\sdie\s"]),
    ("spanish", ["el", "los", "para", "ñ", "ción"], [r"de\s+los", r"\sel\s"]),
]
VOTES = [(n, words) for n, words, _ in LANGUAGES]


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _score_sql(lexicon) -> str:
    scored = []
    for name, words, patterns in lexicon:
        parts = [f"(CASE WHEN contains(low, {sql_text(w)}) THEN 0.05::DOUBLE ELSE 0 END)" for w in words]
        parts += [f"{sql_matches('low', '(?i)' + p)} * 0.1::DOUBLE" for p in patterns]
        scored.append((name, f"round({' + '.join(parts)}, 2)"))
    return sql_best(scored)


@query(f"""
WITH b AS (SELECT doc_id, lang, {_score_sql(LANGUAGES)} AS best FROM (SELECT doc_id, lang, lower(text) AS low FROM documents))
SELECT doc_id, lang, CASE WHEN best.s > 0.1 THEN best.n ELSE 'general' END AS domain, best.s AS domain_score FROM b""")
def domain_score(spark, folder):
    """Weighted words and patterns, with the languages as domains."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "lang", *[c.alias(n) for n, c in dm.domain_by_score(F.col("text"), LANGUAGES).items()])


@query(f"""
WITH b AS (SELECT page_id, {_score_sql(lx.DOMAIN_LEXICON)} AS best FROM (SELECT page_id, lower(html) AS low FROM pages))
SELECT page_id, CASE WHEN best.s > 0.1 THEN best.n ELSE 'general' END AS domain, best.s AS domain_score FROM b""")
def page_domain(spark, folder):
    """The default domain lexicon on raw pages."""
    return table(spark, folder, "pages").select("page_id", *[c.alias(n) for n, c in dm.domain_by_score(F.col("html")).items()])


@query("SELECT doc_id, " + sql_best([(n, " + ".join(f"contains(lower(text), {sql_text(w)})::INT" for w in words)) for n, words in VOTES]) + ".n AS domain FROM documents")
def domain_vote(spark, folder):
    return table(spark, folder, "documents").select("doc_id", dm.domain_by_vote(F.col("text"), VOTES).alias("domain"))


@query(f"""
SELECT page_id, {sql_case("lower(url)", lx.FILE_TYPE_DOMAIN, sql_case("lower(html)", lx.TITLE_DOMAIN, "'general'"))} AS by_metadata,
  {sql_any("domain", lx.PRIMARY_DOMAINS).replace("contains(domain, ", "(domain = ")} AS is_primary,
  CASE domain {' '.join(f"WHEN '{r[0]}' THEN {r[3]}" for r in lx.DOMAIN_SETTINGS)} END::BIGINT AS top_k,
  CASE domain {' '.join(f"WHEN '{r[0]}' THEN {r[4]}" for r in lx.DOMAIN_SETTINGS)} END::BIGINT AS rerank_k
FROM (SELECT *, {sql_case("lower(html)", lx.TITLE_DOMAIN, "'general'")} AS domain FROM pages)""")
def domain_metadata(spark, folder):
    """Domain by file type and title, and the settings of the domain by title."""
    pages = table(spark, folder, "pages")
    df = pages.withColumn("by_metadata", dm.domain_by_metadata(F.col("url"), F.col("html")))
    df = dm.with_domain_settings(df.withColumn("domain", dm.domain_by_metadata(F.lit(""), F.col("html"))))
    return df.select("page_id", "by_metadata", dm.is_primary_domain(F.col("domain")).alias("is_primary"), "top_k", "rerank_k")


@query(f"""
WITH m AS (SELECT doc_id, {COMPANY_SQL} AS co, {TYPE_SQL} AS ty FROM documents)
SELECT doc_id, CASE WHEN co.s > 0 THEN co.n END AS company_name, least(co.s / 10.0, 1.0)::DOUBLE AS confidence_score, CASE WHEN ty.s > 0 THEN ty.n END AS policy_type FROM m""")
def category_argmax(spark, folder):
    """Company by its most frequent pattern and type by summed term counts."""
    t = F.col("text")
    cols = dm.company_columns(t, COMPANIES)
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in cols.items()], dm.policy_type(t, TYPES).alias("policy_type"))


@query(f"""
SELECT doc_id, CASE WHEN lang = 'en' THEN {sql_best([(n, " + ".join(f"contains(lower(text), {sql_text(w)})::INT" for w in ws)) for n, ws in lx.DOMAIN_VOTE])}.n
  WHEN lang = 'fr' THEN 'finance' ELSE 'insurance' END AS domain FROM documents""")
def requested_domain(spark, folder):
    """English documents ask for automatic detection, French name a domain, others an unknown one."""
    name = F.when(F.col("lang") == "en", F.lit("auto")).when(F.col("lang") == "fr", F.lit("Finance")).otherwise(F.col("lang"))
    return table(spark, folder, "documents").select("doc_id", dm.named_domain(name, F.col("text")).alias("domain"))


@query(f"""
WITH f AS (SELECT doc_id, coalesce(nullif(text, ''), concat_ws(' ', source, '', lang)) AS used FROM documents),
b AS (SELECT doc_id, {_score_sql(LANGUAGES)} AS best FROM (SELECT doc_id, lower(used) AS low FROM f))
SELECT doc_id, CASE WHEN best.s > 0.1 THEN best.n ELSE 'general' END AS domain FROM b""")
def domain_fallback_text(spark, folder):
    """Detection on metadata text where the document text is missing."""
    used = dm.metadata_text(F.col("text"), F.col("source"), F.lit(None).cast("string"), F.col("lang"))
    docs = table(spark, folder, "documents").withColumn("used", used)
    return docs.select("doc_id", dm.domain_by_score(F.col("used"), LANGUAGES)["domain"].alias("domain"))
