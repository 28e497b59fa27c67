"""Terms and sub-queries added to a question."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import contains_any, extract_keywords, lit_array, strip


def _appended(rules: Sequence[tuple[Column, Sequence[str]]]) -> Column:
    return F.concat(lit_array([]), *[F.when(test, lit_array(terms)).otherwise(lit_array([])) for test, terms in rules])


def pattern_terms(question: Column, rules=lx.EXPANSION["insurance"]) -> Column:
    """Synonyms of every category that a trigger of the question names."""
    q = F.lower(question)
    return _appended([(contains_any(q, triggers), synonyms) for triggers, synonyms in rules])


def per_domain(domain: Column, tables: Mapping[str, Sequence], build: Callable[[Sequence], Column], default: str = "insurance") -> Column:
    """``build`` with the table of each row's domain; domains without a table get the default one."""
    out = build(tables[default])
    for name, table in tables.items():
        if name != default:
            out = F.when(F.lower(domain) == name, build(table)).otherwise(out)
    return out


def numeric_terms(question: Column, rules=lx.NUMERIC_EXPANSION) -> Column:
    q = F.lower(question)
    return _appended([(q.rlike("(?s)" + p), terms) for p, terms in rules])


def procedural_terms(question: Column, limit: int = 8) -> Column:
    q = F.lower(question)
    return F.slice(_appended([(contains_any(q, words), terms) for words, terms in lx.PROCEDURAL_EXPANSION]), 1, limit)


def health_terms(question: Column, limit: int = 10) -> Column:
    q = F.lower(question)
    rules = [(q.contains(key), terms) for key, terms in lx.HEALTH_TERMS]
    rules.append((contains_any(q, lx.HEALTH_INDICATORS), lx.HEALTH_GENERAL))
    return F.slice(F.array_distinct(_appended(rules)), 1, limit)


def enriched_terms(question: Column, terms: Column | None = None, rules=lx.QUERY_ENRICHMENT) -> Column:
    """Search terms of a question: its keywords, then conditional additions; none without keywords."""
    q = F.lower(question)
    base = extract_keywords(question) if terms is None else terms
    extra = []
    for groups, added in rules:
        test = F.lit(True)
        for alternatives in groups:
            test = test & contains_any(q, alternatives)
        extra.append((test, added))
    return F.when(F.size(base) > 0, F.concat(base, _appended(extra))).otherwise(lit_array([]))


def search_terms(terms: Column, numeric: int | None = None, other: int | None = None) -> Column:
    """The terms a keyword search uses: those with digits, then the others.

    ``numeric`` and ``other`` keep the first so many of each, for results like those of a
    search that bounds its predicate (3 and 5); by default all terms are searched."""
    digits = F.filter(terms, lambda t: t.rlike("[0-9]"))
    plain = F.filter(terms, lambda t: ~t.rlike("[0-9]"))
    return F.concat(digits if numeric is None else F.slice(digits, 1, numeric), plain if other is None else F.slice(plain, 1, other))


def model_terms(reply: Column, limit: int = 8) -> Column:
    """Terms from a model reply with one term per line, numbering removed."""
    cleaned = F.transform(F.split(reply, "\n"), lambda l: F.regexp_replace(strip(l), r"^[\d\-.\s]+", ""))
    return F.slice(F.filter(cleaned, lambda t: F.length(t) > 2), 1, limit)


def model_sub_queries(reply: Column, question: Column) -> Column:
    """Sub-queries from the A) B) C) lines of a reply; rule-based terms if fewer than three."""
    lines = F.transform(F.split(reply, "\n"), strip)
    found = F.transform(F.filter(lines, lambda l: l.rlike(r"^[ABC]\)")), lambda l: strip(F.substring(l, 3, 1 << 30)))
    found = F.filter(found, lambda l: l != "")
    return F.when(F.size(found) >= 3, found).otherwise(procedural_terms(question))


def distinct_terms(*lists: Column) -> Column:
    return F.array_distinct(F.concat(*lists))


def expanded_query(question: Column, terms: Column) -> Column:
    """"q" OR "t1" OR ..., or the question alone without terms."""
    quoted = F.transform(F.concat(F.array(question), terms), lambda t: F.concat(F.lit('"'), t, F.lit('"')))
    return F.when(F.size(terms) > 0, F.array_join(quoted, " OR ")).otherwise(question)


def sub_queries(expanded: Column, question: Column) -> Column:
    """Back from the string form: its parts without the question, or the question alone."""
    parts = F.transform(F.split(expanded, " OR "), lambda p: F.btrim(strip(p), F.lit('"')))
    parts = F.filter(parts, lambda p: (p != "") & (p != question))
    return F.when(expanded.contains(" OR ") & (F.size(parts) > 0), parts).otherwise(F.array(question))


def search_flags(terms: Column) -> dict[str, Column]:
    def mentions(word: str) -> Column:
        return F.exists(terms, lambda t: F.lower(t).contains(word))

    flags = {name: mentions(word) for name, word in lx.EXPANSION_FLAGS.items()}
    flags["has_numerical_details"] = F.exists(terms, lambda t: t.rlike("[0-9]"))
    return flags


def strategy_sub_queries(question: Column, strategy: Column, rules=lx.EXPANSION["insurance"], limit: int = 3) -> Column:
    """Sub-queries by strategy: the question itself, pattern terms, or rule-based
    procedural terms; at most ``limit``, and the question when nothing was added."""
    terms = (
        F.when(strategy == "original", lit_array([]))
        .when(strategy == "multi_query", distinct_terms(pattern_terms(question, rules), procedural_terms(question)))
        .when(strategy == "pattern", pattern_terms(question, rules))
        .otherwise(distinct_terms(pattern_terms(question, rules), numeric_terms(question)))
    )
    return F.when(F.size(terms) > 0, F.slice(terms, 1, limit)).otherwise(F.array(question))
