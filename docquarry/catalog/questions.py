"""Question understanding and expansion over all user turns and benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.catalog.views import TURNS_SQL, sql_any, sql_ascii, sql_case, sql_list, sql_text, sql_words, table, tidy, user_turns
from docquarry.operators import context as ctx
from docquarry.operators import expand as ex
from docquarry.operators import intent as it

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _questions(spark, folder):
    """User turns, and every benchmark text behind one of the question openings."""
    openings = F.array(*[F.lit(o) for o in OPENINGS])
    items = table(spark, folder, "benchmark").withColumn("opening", F.explode(openings))
    asked = items.select(F.concat_ws("#", F.col("item_id").cast("string"), F.md5("opening")).alias("query_id"), F.concat_ws(" ", "opening", "text").alias("question"))
    return user_turns(spark, folder).unionByName(asked)


OPENINGS = [
    "What is not covered for health treatment in", "How to claim and which claim process applies to", "Show the benefit schedule table with the sub-limit of",
    "Define the waiting period and cumulative bonus of ICICI Lombard", "What does zone co-payment mean for travel",
    "Coverage for accident or disability under Bajaj", "steps to notify the Star hospital of a maternity claim with documents",
    "conditions for ENT and reset benefit of the home policy", "OPD",
]
_Q = f"""{TURNS_SQL}, q AS (SELECT * FROM turns UNION ALL SELECT item_id || '#' || md5(o), o || ' ' || text FROM benchmark, (SELECT unnest({sql_list(OPENINGS)}) AS o))"""


def _intent_sql() -> str:
    words, also, value = lx.SCHEDULE_INTENT
    schedule = f"CASE WHEN {sql_any('low', words)} AND contains(low, {sql_text(also)}) THEN {sql_text(value)} END"
    kinds, limits, tab = lx.TABLE_INTENT
    confidence = " + ".join(
        ["(CASE WHEN section_type IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END)", "(CASE WHEN chunk_type IS NOT NULL THEN 0.3::DOUBLE ELSE 0 END)",
         f"(CASE WHEN len({sql_words('question')}) < 3 THEN -0.1::DOUBLE ELSE 0 END)"]
        + [f"(CASE WHEN {sql_any('low', ws)} THEN {w}::DOUBLE ELSE 0 END)" for ws, w in lx.CONFIDENCE_PHRASES])
    return f"""WITH {_Q}, low AS (SELECT *, lower(question) AS low FROM q),
 i AS (SELECT *, {sql_case('low', lx.SECTION_INTENT, schedule)} AS section_type, CASE WHEN {sql_any('low', kinds)} AND {sql_any('low', limits)} THEN {sql_text(tab)} END AS chunk_type,
   {sql_case('low', lx.POLICY_TYPE_INTENT)} AS policy_type, {sql_case('low', lx.COMPANY_INTENT)} AS company_name,
   {sql_case('low', lx.QUERY_INTENT, "'general'")} AS query_intent, {sql_case('low', lx.QUERY_TYPE, "'general'")} AS query_type FROM low),
 c AS (SELECT *, round(least(greatest({confidence}, 0), 1), 2) AS confidence FROM i)"""


@query(_intent_sql() + """
SELECT query_id, section_type, chunk_type, policy_type, company_name, confidence, query_intent, query_type,
  CASE WHEN confidence >= 0.8 THEN 'original' WHEN confidence >= 0.6 THEN 'pattern' WHEN query_type = 'procedural' THEN 'multi_query' ELSE 'full' END AS strategy FROM c""")
def intent_rules(spark, folder):
    df = it.with_intent(_questions(spark, folder))
    return df.select("query_id", *[F.col(f"intent_{n}").alias(n) for n in ("section_type", "chunk_type", "policy_type", "company_name")],
                     F.col("intent_confidence").alias("confidence"), "query_intent", "query_type", "strategy")


@query(_intent_sql() + """
SELECT query_id, CASE WHEN query_intent = 'claim' THEN 'claims' ELSE section_type END AS section_type, chunk_type, policy_type,
  CASE WHEN query_type = 'definition' THEN 'Given' ELSE company_name END AS company_name, query_type AS file_name FROM c""")
def filter_merge(spark, folder):
    """Given filters (made from the question type) win over the parsed intent when not empty."""
    df = it.with_intent(_questions(spark, folder)).withColumns({
        "user_section_type": F.when(F.col("query_intent") == "claim", F.lit("claims")).otherwise(F.lit("")),
        "user_company_name": F.when(F.col("query_type") == "definition", F.lit("Given")), "user_file_name": F.col("query_type")})
    return it.merge_filters(df).select("query_id", *[F.col(f"filter_{n}").alias(n) for n in ("section_type", "chunk_type", "policy_type", "company_name", "file_name")])


def _append(rules) -> str:
    parts = [f"(CASE WHEN {test} THEN {sql_list(terms)} ELSE []::VARCHAR[] END)" for test, terms in rules]
    out = "[]::VARCHAR[]"
    for p in parts:
        out = f"list_concat({out}, {p})"
    return out


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


_PATTERN = _append([(sql_any("low", ts), syn) for ts, syn in lx.EXPANSION["insurance"]])
_NUMERIC = _append([(f"regexp_matches(low, {sql_text('(?s)' + p)})" if "(?=" not in p else "contains(low, 'ent') AND contains(low, 'conditions')", terms) for p, terms in lx.NUMERIC_EXPANSION])
_PROCEDURAL = _append([(sql_any("low", ts), terms) for ts, terms in lx.PROCEDURAL_EXPANSION])
_HEALTH = _append([(f"contains(low, {sql_text(k)})", ts) for k, ts in lx.HEALTH_TERMS] + [(sql_any("low", lx.HEALTH_INDICATORS), lx.HEALTH_GENERAL)])


@query(f"""
WITH {_Q}, t AS (SELECT query_id, question, {_PATTERN} AS pattern, {_NUMERIC} AS numeric_terms FROM (SELECT *, lower(question) AS low FROM q)),
 a AS (SELECT *, list_concat(pattern, numeric_terms) AS every_term FROM t), d AS (SELECT *, {_ordered_distinct('every_term')} AS terms FROM a)
SELECT query_id, array_to_string(terms, '|') AS terms, CASE WHEN len(terms) > 0 THEN array_to_string(list_transform(list_concat([question], terms), lambda x: '"' || x || '"'), ' OR ') ELSE question END AS expanded,
  array_to_string(CASE WHEN len(terms) > 0 THEN terms ELSE [question] END, '|') AS sub_queries,
  len(list_filter(terms, lambda x: contains(x, 'definition'))) > 0 AS has_definitions, len(list_filter(terms, lambda x: contains(x, 'cover'))) > 0 AS has_coverage,
  len(list_filter(terms, lambda x: contains(x, 'exclusion'))) > 0 AS has_exclusions, len(list_filter(terms, lambda x: contains(x, 'claim'))) > 0 AS has_claims,
  len(list_filter(terms, lambda x: regexp_matches(x, '[0-9]'))) > 0 AS has_numerical_details FROM d""")
def pattern_expansion(spark, folder):
    q = F.col("question")
    df = _questions(spark, folder).withColumn("terms", ex.distinct_terms(ex.pattern_terms(q), ex.numeric_terms(q)))
    df = df.withColumn("expanded", ex.expanded_query(q, F.col("terms")))
    return df.select("query_id", F.array_join("terms", "|").alias("terms"), "expanded", F.array_join(ex.sub_queries(F.col("expanded"), q), "|").alias("sub_queries"),
                     *[c.alias(n) for n, c in ex.search_flags(F.col("terms")).items()])


_BY_DOMAIN = "CASE domain " + " ".join(f"WHEN {sql_text(d)} THEN {_append([(sql_any('low', ts), syn) for ts, syn in rules])}" for d, rules in lx.EXPANSION.items()) + f" ELSE {_PATTERN} END"
_DOMAINS = [*lx.EXPANSION, "general"]


@query(f"""
WITH {_Q}, d AS (SELECT *, unnest({sql_list(_DOMAINS)}) AS domain, lower('Audit review of the contract, leave and waiting period: ' || question) AS low FROM q)
SELECT query_id, domain, array_to_string({_BY_DOMAIN}, '|') AS terms FROM d""")
def domain_expansion(spark, folder):
    """Every question in every domain, expanded by the rules of that domain; others use the default rules."""
    asked = F.concat(F.lit("Audit review of the contract, leave and waiting period: "), "question")
    df = _questions(spark, folder).withColumn("question", asked).withColumn("domain", F.explode(F.array(*[F.lit(d) for d in _DOMAINS])))
    terms = ex.per_domain(F.col("domain"), lx.EXPANSION, lambda rules: ex.pattern_terms(F.col("question"), rules))
    return df.select("query_id", "domain", F.array_join(terms, "|").alias("terms"))


@query(f"""
WITH {_Q}, low AS (SELECT *, lower(question) AS low FROM q), t AS (SELECT query_id, {_PROCEDURAL}[1:8] AS procedural, {_HEALTH} AS h FROM low)
SELECT query_id, array_to_string(procedural, '|') AS procedural, array_to_string({_ordered_distinct('h')}[1:10], '|') AS health FROM t""")
def rule_terms(spark, folder):
    q = F.col("question")
    return _questions(spark, folder).select("query_id", F.array_join(ex.procedural_terms(q), "|").alias("procedural"), F.array_join(ex.health_terms(q), "|").alias("health"))


def _enrich_sql() -> str:
    rules = [(" AND ".join(sql_any("low", g) for g in groups), terms) for groups, terms in lx.QUERY_ENRICHMENT]
    found = " , ".join(f"regexp_extract_all({sql_ascii('low')}, {sql_text(chr(92) + 'b(?:' + '|'.join(ws) + ')' + chr(92) + 'b')})" for ws in (lx.KEYWORD_TERMS, lx.KEYWORD_COMPANIES))
    return f"""WITH {_Q}, k AS (SELECT query_id, low, list_sort(list_distinct(list_concat({found}))) AS keywords FROM (SELECT *, lower(question) AS low FROM q)),
 t AS (SELECT *, CASE WHEN len(keywords) > 0 THEN list_concat(keywords, {_append(rules)}) ELSE []::VARCHAR[] END AS terms FROM k)
SELECT query_id, array_to_string(terms, '|') AS terms, array_to_string(list_concat(list_filter(terms, lambda x: regexp_matches(x, '[0-9]'))[1:3], list_filter(terms, lambda x: NOT regexp_matches(x, '[0-9]'))[1:5]), '|') AS used FROM t"""


@query(_enrich_sql())
def query_terms(spark, folder):
    df = _questions(spark, folder).withColumn("terms", ex.enriched_terms(F.col("question")))
    return df.select("query_id", F.array_join("terms", "|").alias("terms"), F.array_join(ex.search_terms(F.col("terms"), 3, 5), "|").alias("used"))


@query(f"""
WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: regexp_replace(trim(l, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '^[0-9\\-.\\s]+', '')) AS lines FROM documents)
SELECT doc_id, array_to_string(list_filter(lines, lambda l: length(l) > 2)[1:8], '|') AS terms FROM r""")
def model_term_cleanup(spark, folder):
    """Every document read as a model reply with one term per line; eight terms are the feature."""
    return table(spark, folder, "documents").select("doc_id", F.array_join(ex.model_terms(F.col("text")), "|").alias("terms"))


@query(f"""
WITH p AS (SELECT conv_id, turn, text, 'A) ' || text || chr(10) || ' B) ' || role || chr(10) || CASE WHEN turn % 2 = 0 THEN 'C) ' || conv_id ELSE 'none' END AS reply FROM conversations),
 l AS (SELECT *, list_transform(list_filter(list_transform(string_split(reply, chr(10)), lambda x: trim(x, ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))), lambda x: regexp_matches(x, '^[ABC]\\)')), lambda x: trim(substr(x, 3), ' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13))) AS found FROM p)
SELECT conv_id, turn, CASE WHEN len(list_filter(found, lambda x: x <> '')) >= 3 THEN array_to_string(list_filter(found, lambda x: x <> ''), '|')
  ELSE array_to_string((SELECT {_PROCEDURAL.replace('low', 'lower(text)')})[1:8], '|') END AS sub_queries FROM l""")
def model_sub_queries(spark, folder):
    reply = F.concat(F.lit("A) "), "text", F.lit("\n B) "), "role", F.lit("\n"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("C) "), F.col("conv_id").cast("string"))).otherwise(F.lit("none")))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.array_join(ex.model_sub_queries(reply, F.col("text")), "|").alias("sub_queries"))


@query(_intent_sql() + """
SELECT query_id, 'A reader of insurance documents asks: "' || question || '"' || chr(10) || CASE query_type
  WHEN 'procedural' THEN 'Rewrite it as three searches, one per line, marked A) keywords, B) plain question, C) section titles.'
  WHEN 'definition' THEN 'List terms and titles under which it may be defined, one per line.'
  ELSE 'List five to eight related terms, one per line.' END AS prompt FROM c""")
def expansion_prompts(spark, folder):
    q = F.col("question")
    return _questions(spark, folder).select("query_id", ctx.expansion_prompt(q, "insurance", it.query_type(q)).alias("prompt"))
