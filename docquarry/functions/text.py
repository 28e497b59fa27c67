"""Text functions: Column in, Column out, all evaluated inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry import lexicon as lx

WHITESPACE = " \t\n\r\x0b\x0c"
# Word boundaries that treat accented letters as letters on every Java version.
WORD_START, WORD_END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def lit_array(values: Sequence[str]) -> Column:
    """A string array literal that stays typed when it is empty."""
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once; keeps nested expressions small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every ASCII whitespace character, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def words(c: Column) -> Column:
    """Whitespace separated tokens; empty array for blank or NULL text."""
    s = strip(c)
    return F.when(is_blank(c), lit_array([])).otherwise(F.split(s, r"\s+"))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def has_words(c: Column, n: int) -> Column:
    """True when the text has at least ``n`` words; looks no further than the n-th."""
    return F.coalesce(c.rlike(rf"^\s*+(?:\S++\s++){{{n - 1}}}\S"), F.lit(False))


def contains_any(c: Column, terms: Sequence[str]) -> Column:
    """True when any term is a substring of the (already lower-cased) column."""
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms], F.lit(False))


def first_match(c: Column, rules, default: Column | None = None) -> Column:
    """Value of the first ``(terms, value)`` rule with a term contained in ``c``."""
    chain = default if default is not None else F.lit(None).cast("string")
    for terms, value in reversed(list(rules)):
        chain = F.when(contains_any(c, terms), F.lit(value)).otherwise(chain)
    return chain


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a literal term, from lengths in bytes, which are known."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(term)))) / F.lit(len(term.encode()))).cast("int")


def pattern_count(c: Column, pattern: str) -> Column:
    """Matches of a pattern; one of letters, digits and blanks alone is counted as a literal term."""
    return occurrences(c, pattern) if re.fullmatch(r"[A-Za-z0-9_ ]+", pattern) else F.regexp_count(c, F.lit(pattern))


# --- cleaning and statistics ---------------------------------------------------

def clean_text(c: Column) -> Column:
    """Collapse whitespace, limit dot and dash runs, straighten single quotes."""
    s = strip(F.regexp_replace(c, r"\s+", " "))
    s = F.regexp_replace(s, r"[.]{3,}", "...")
    s = F.regexp_replace(s, r"[-]{3,}", "---")
    s = strip(F.translate(s, "‘’", "''"))
    return F.when(is_blank(c), F.lit("")).otherwise(s)


def sentence_count(c: Column) -> Column:
    pieces = F.split(c, r"[.!?]+(?:\s|$)")
    return F.coalesce(F.size(F.filter(pieces, lambda s: strip(s) != "")), F.lit(0))


def paragraph_count(c: Column, separator: str = "\n\n") -> Column:
    pieces = F.split(c, separator)
    return F.coalesce(F.size(F.filter(pieces, lambda s: strip(s) != "")), F.lit(0))


def text_statistics(c: Column, separator: str = "\n\n") -> dict[str, Column]:
    """Named statistics of a text; ratios are 0 where the divisor is 0."""
    n_words, n_sent, n_chars = word_count(c), sentence_count(c), F.coalesce(F.length(c), F.lit(0))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))

    return {
        "character_count": n_chars,
        "word_count": n_words,
        "sentence_count": n_sent,
        "paragraph_count": paragraph_count(c, separator),
        "avg_words_per_sentence": ratio(n_words, n_sent),
        "avg_chars_per_word": ratio(n_chars, n_words),
        "reading_time_minutes": n_words.cast("double") / F.lit(200.0),
    }


def capitalised_phrases(c: Column) -> Column:
    """All runs of capitalised words, in reading order."""
    return F.regexp_extract_all(c, F.lit(WORD_START + r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*" + WORD_END), F.lit(0))


# --- keywords, identifiers, entities ---------------------------------------------

def extract_keywords(
    c: Column,
    terms: Sequence[str] = lx.KEYWORD_TERMS,
    companies: Sequence[str] = lx.KEYWORD_COMPANIES,
    identifier: str | None = lx.IDENTIFIER_PATTERN,
) -> Column:
    """Distinct lexicon words and identifier-like tokens, sorted.

    One-word terms are looked up among the words of the text; only terms of
    several words need a search of their own."""
    listed = [*terms, *companies]
    single = [t for t in listed if re.fullmatch(r"\w+", t)]
    several = [t for t in listed if t not in single]

    def found(low: Column) -> Column:
        parts = [F.array_intersect(F.split(low, r"[^\p{L}\p{N}_]+"), lit_array(single))]
        for t in several:
            whole = low.contains(t) & low.rlike(WORD_START + re.escape(t) + WORD_END)
            parts.append(F.when(whole, lit_array([t])).otherwise(lit_array([])))
        return F.concat(*parts)

    lists = [let(F.lower(c), found)]
    if identifier:
        lists.append(F.regexp_extract_all(c, F.lit(identifier), F.lit(0)))
    return F.array_sort(F.array_distinct(F.concat(*lists)))


def first_group(c: Column, patterns: Sequence[str]) -> Column:
    """Group 1 of the first pattern that matches (any case); NULL when none does."""
    hits = [F.nullif(F.regexp_extract(c, "(?i)" + p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*hits) if len(hits) > 1 else hits[0]


def policy_id(c: Column, patterns: Sequence[str] = lx.POLICY_ID_PATTERNS) -> Column:
    return first_group(c, patterns)


def entities(c: Column, patterns: Mapping[str, Sequence[str]] = lx.ENTITY_PATTERNS) -> dict[str, Column]:
    """Per entity kind, all matches of its patterns in pattern order."""
    return {
        kind: F.concat(*[F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(0)) for p in ps])
        for kind, ps in patterns.items()
    }


def pattern_counts(c: Column, patterns: Mapping[str, Sequence[str]] = lx.FAST_PATTERNS) -> dict[str, Column]:
    """Per family, the number of matches over all of its patterns."""
    return {
        kind: reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit("(?i)" + p)) for p in ps])
        for kind, ps in patterns.items()
    }


def terms_present(c: Column, terms: Sequence[str]) -> Column:
    """The terms (original spelling, list order) that occur in the text, any case."""
    return let(F.lower(c), lambda low: F.filter(lit_array(terms), lambda t: F.contains(low, F.lower(t))))


# --- question and chunk text preparation ---------------------------------------------

def optimise_query(c: Column, limit: int = 500) -> Column:
    """Drop punctuation except ``-`` and ``.``, collapse blanks, cut at a word boundary."""
    s = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s\-.]", " "), r"\s+", " ")
    head = F.left(s, F.lit(limit))
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return strip(F.when(F.length(s) <= limit, s).when(head.contains(" "), cut).otherwise(head))


def emphasise(c: Column, kind: str | Column, terms: Mapping[str, Sequence[str]] = lx.EMPHASIS_TERMS) -> Column:
    """Double every whole-word term of the text kind; other kinds pass through."""
    kind_col = F.lower(F.lit(kind) if isinstance(kind, str) else kind)
    out = c
    for name, term_list in reversed(list(terms.items())):
        doubled = c
        for t in term_list:
            doubled = F.regexp_replace(doubled, f"(?i){WORD_START}{t}{WORD_END}", f"{t} {t}")
        out = F.when(kind_col == name, doubled).otherwise(out)
    return out


def query_with_context(c: Column, domain: Column, contexts: Mapping[str, str] = lx.QUERY_CONTEXT) -> Column:
    out = c
    for name, context in contexts.items():
        out = F.when(F.lower(domain) == name, F.concat(F.lit(context + ": "), c)).otherwise(out)
    return out


def query_with_suffix(c: Column, domain: Column, suffixes: Mapping[str, str] = lx.QUERY_SUFFIX) -> Column:
    out = c
    for name, suffix in suffixes.items():
        out = F.when(domain == name, F.concat(c, F.lit(" " + suffix))).otherwise(out)
    return out
