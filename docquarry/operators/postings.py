"""Inverted index: the k best chunks of every word of a scope.

The order of keyword hits does not depend on the question, so of each word only its k
best chunks can ever be among a question's k best. A search term without white space lies within
one word of a text, so terms are looked up in the vocabulary: words and terms meet on runs of
up to three letters, and the few pairs left are tested for containment. What a search costs follows
from the vocabulary, and not from the number of terms times the text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.scale import broadcast_if_small, explode_rows, top_k, write_once

GRAM = 3
SEGMENT, OVERLAP = 512, 256  # longer words are looked at in overlapping segments
APART = r"[\s\x00]"  # between words
ORDER = (F.desc, "confidence_score"), (F.asc, "chunk_index"), (F.asc, "chunk_id")


def hit_order() -> list[Column]:
    return [direction(c) for direction, c in ORDER]


def is_one_word(term: Column) -> Column:
    """Whether a term lies within one word, or one segment of a long word, of every text that contains it."""
    return ~term.rlike(APART) & (F.length(term) <= OVERLAP + 1)


def index_words(haystack: Column) -> Column:
    """Distinct words of a text; a longer word as segments, of which neighbours share OVERLAP letters."""
    found = F.filter(F.split(haystack, APART + "+"), lambda w: w != "")
    segments = lambda w: F.regexp_extract_all(w, F.lit(f"(?s)(?=(.{{1,{SEGMENT}}})).{{1,{OVERLAP}}}"), F.lit(1))
    cut = F.flatten(F.transform(found, lambda w: F.when(F.length(w) > SEGMENT, segments(w)).otherwise(F.array(w))))
    return F.array_distinct(F.when(F.exists(found, lambda w: F.length(w) > SEGMENT), cut).otherwise(found))


def postings(chunks: DataFrame, scope: Sequence[str], k: int, salts: int = 1) -> DataFrame:
    """``chunks(*scope, chunk_id, confidence_score, chunk_index, haystack)`` -> ``*scope``, ``word``, and
    the ``chunk_id``, ``confidence_score``, ``chunk_index`` of the k best chunks of each word.

    One pass and one shuffle, before which each task keeps k rows per word. A NULL confidence is 0,
    a NULL index too; chunks without words are not listed."""
    rows = chunks.select(
        *scope, F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)).alias("confidence_score"),
        F.coalesce(F.col("chunk_index").cast("bigint"), F.lit(0)).alias("chunk_index"), index_words(F.col("haystack")).alias("_words"))
    rows = explode_rows(rows, [*scope, "chunk_id", "confidence_score", "chunk_index"], "_words", "_at", "word").drop("_at")
    return top_k(rows, [*scope, "word"], hit_order(), k, rank="_r", salt=F.col("chunk_id"), salts=salts).drop("_r")


def words_with(terms: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs (term, word) of ``terms(term)`` and distinct ``words(word)`` in which the word contains the term.

    Each word is listed once per distinct run of GRAM letters, or of as many as shorter terms
    have; a term waits at its first such run."""
    asked = terms.filter("term <> ''").distinct().select("term", F.substring("term", 1, GRAM).alias("gram"))
    lengths = [r[0] for r in asked.select(F.length("gram")).distinct().collect()]  # at most GRAM numbers
    if not lengths:
        return terms.select("term", F.col("term").alias("word")).limit(0)

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("word") - (n - 1), F.lit(1)))
        return F.when(F.length("word") >= n, F.transform(starts, lambda at: F.substring(F.col("word"), at, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    listed = explode_rows(words, ["word"], F.array_distinct(F.concat(*map(runs, sorted(lengths)))), "_at", "gram").drop("_at")
    met = listed.join(broadcast_if_small(asked), "gram").filter(F.contains("word", "term"))
    return met.select("term", "word").distinct()


HEAD = 2_000  # best chunks of a scope that are looked at first
HITS = 500_000  # pairs of term and word that are sent to every task, if their bytes allow it


def _best(rows: DataFrame, wanted: DataFrame, scope: str, k: int, salts: int) -> DataFrame:
    """The k best chunks of each wanted (scope, term) among the postings ``rows``."""
    hits = write_once(words_with(wanted.select("term"), rows.select("word").distinct()))
    found = rows.join(broadcast_if_small(hits, HITS), "word").join(broadcast_if_small(wanted), [scope, "term"])
    found = found.select(scope, "term", "chunk_id", "confidence_score", "chunk_index").distinct()
    return top_k(found, [scope, "term"], hit_order(), k, rank="_r", salt=F.col("chunk_id"), salts=salts).drop("_r")


def best_by_postings(index: DataFrame, wanted: DataFrame, k: int, scope: str = "_scope", salts: int = 1, head: int = HEAD) -> DataFrame:
    """The k best chunks of each wanted (scope, term) from stored postings of that scope column.

    All terms of a scope share the order of its chunks. So the ``head`` best chunks of each scope come
    first: terms with k hits among them are done, and those are the frequent terms, which most of the
    vocabulary contains. Only the others are looked up in the whole index."""
    wanted = wanted.select(scope, "term").distinct()
    chunk = F.struct((-F.col("confidence_score")).alias("c"), "chunk_index", "chunk_id")
    bound = top_k(index.select(scope, "confidence_score", "chunk_index", "chunk_id").distinct(), [scope], hit_order(), head, salt=F.col("chunk_id"), salts=salts)
    bound = write_once(bound.groupBy(scope).agg(F.max(chunk).alias("_last")))
    first = write_once(_best(write_once(index.join(broadcast_if_small(bound), scope).filter(chunk <= F.col("_last")).drop("_last")), wanted, scope, k, salts))
    done = write_once(first.groupBy(scope, "term").count().filter(F.col("count") >= k).select(scope, "term"))
    rest = write_once(wanted.join(done, [scope, "term"], "left_anti"))
    return first.join(broadcast_if_small(done), [scope, "term"], "left_semi").unionByName(_best(index, rest, scope, k, salts))
