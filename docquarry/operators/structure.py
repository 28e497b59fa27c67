"""Headers and section ranges, computed inside the document row (no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import first_match, strip
from docquarry.operators.expand import per_domain
from docquarry.scale import explode_rows


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _any_of(patterns) -> str:
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _level_is(levels, header: Column, per_level: dict[int, Column]) -> Column:
    chain = per_level[levels[-1]]
    for lv in reversed(levels[:-1]):
        chain = F.when(header["level"] == lv, per_level[lv]).otherwise(chain)
    return chain


def with_headers(
    df: DataFrame,
    text: str = "text",
    patterns=lx.HEADER_PATTERNS,
    titles=lx.SECTION_TITLES["insurance"],
    section_words=lx.SECTION_WORDS,
    min_length: int = 3,
    domain: Column | None = None,
) -> DataFrame:
    """Add ``lines`` and ``headers`` (line, text, type, level, section_type, content_start, content_end).

    General patterns are tried in order; a line none of them matches may still be
    a section title of the domain, where the last matching type wins. A section
    ends before the next header of the same or a higher level. ``titles`` may map domains to
    their titles; then ``domain`` chooses per row, and other domains have the general ones.
    """
    def titled(build) -> Column:
        return per_domain(domain, titles, build, "general") if isinstance(titles, Mapping) else build(titles)

    def is_header(line: Column) -> Column:
        return titled(lambda some: line.rlike(_any_of([p for p, _, _ in patterns] + [p for _, p in some])))

    def classify(x: Column) -> Column:
        line_text = x["text"]
        kind = F.when(F.lit(False), F.struct(F.lit("").alias("type"), F.lit(0).alias("level")))
        for p, name, level in patterns:
            kind = kind.when(line_text.rlike("(?i)" + p), F.struct(F.lit(name).alias("type"), F.lit(level).alias("level")))
        title = titled(lambda some: reduce(lambda found, t: found.when(line_text.rlike("(?i)" + t[1]), F.lit(t[0])), reversed(list(some)), F.when(F.lit(False), F.lit(""))))
        return F.struct(x["line"].alias("line"), line_text.alias("text"), kind.alias("kind"), title.alias("title"))

    def settle(x: Column) -> Column:
        general = x["kind"].isNotNull()
        return F.struct(
            x["line"].alias("line"),
            x["text"].alias("text"),
            F.coalesce(x["kind"]["type"], F.lit("domain_specific")).alias("type"),
            F.coalesce(x["kind"]["level"], F.lit(2)).alias("level"),
            F.when(general, first_match(F.lower(x["text"]), section_words, F.lit("general")))
            .otherwise(x["title"]).alias("section_type"),
        )

    numbered = F.transform(F.col("lines"), lambda l, i: F.struct(i.alias("line"), strip(l).alias("text")))
    candidates = F.filter(numbered, lambda x: (F.length(x["text"]) >= min_length) & is_header(x["text"]))
    df = df.withColumn("lines", split_lines(F.col(text)))
    df = df.withColumn("_found", F.transform(F.transform(candidates, classify), settle))

    levels = sorted({lv for _, _, lv in patterns} | {2})

    def lines_up_to(level: int) -> Column:
        return F.transform(F.filter(F.col("_found"), lambda h: h["level"] <= level), lambda h: h["line"])

    df = df.withColumns({f"_cut{lv}": lines_up_to(lv) for lv in levels})

    def bounded(h: Column) -> Column:
        cut = _level_is(levels, h, {lv: F.col(f"_cut{lv}") for lv in levels})
        following = F.try_element_at(cut, (F.array_position(cut, h["line"]) + 1).cast("int"))
        return F.struct(
            *[h[n].alias(n) for n in ("line", "text", "type", "level", "section_type")],
            (h["line"] + 1).alias("content_start"),
            (F.coalesce(following, F.size("lines")) - 1).alias("content_end"),
        )

    return df.withColumn("headers", F.transform(F.col("_found"), bounded)).drop("_found", *[f"_cut{lv}" for lv in levels])


def line_range(lines: Column, start: Column, end: Column) -> Column:
    """Stripped text of lines start..end (0-based, inclusive)."""
    return strip(F.array_join(F.slice(lines, start + 1, F.greatest(end - start + 1, F.lit(0))), "\n"))


def sections(df: DataFrame, keys=("doc_id",), min_chars: int = 20) -> DataFrame:
    """Exploded section boundaries with more than ``min_chars`` characters of content."""
    texts = F.transform(
        F.col("headers"),
        lambda h, i: F.struct(
            i.alias("section"), h.alias("h"),
            F.length(line_range(F.col("lines"), h["content_start"], h["content_end"])).alias("content_length"),
        ),
    )
    rows = explode_rows(df, keys, F.filter(texts, lambda s: s["content_length"] > min_chars), "_i", "s")
    return rows.select(
        *keys, "s.section", F.col("s.h.text").alias("title"), F.col("s.h.section_type").alias("section_type"),
        F.col("s.h.type").alias("header_type"), F.col("s.h.level").alias("level"),
        F.col("s.h.content_start").alias("content_start"), F.col("s.h.content_end").alias("content_end"),
        "s.content_length",
    )


def with_simple_sections(df: DataFrame, text: str = "text", patterns=lx.SIMPLE_SECTIONS, levels=lx.SIMPLE_LEVELS) -> DataFrame:
    """Add ``lines`` and ``simple_sections`` (line, title, pattern, level) by the short pattern list."""

    def level(t: Column) -> Column:
        chain = F.when(F.lit(False), F.lit(0))
        for p, lv in levels:
            chain = chain.when(t.rlike(p), F.lit(lv))
        return F.coalesce(chain, F.lit(lx.SIMPLE_DEFAULT_LEVEL))

    def which(t: Column) -> Column:
        return reduce(lambda acc, ip: acc.when(t.rlike("(?i)" + ip[1]), F.lit(ip[0])), enumerate(patterns), F.when(F.lit(False), F.lit(0)))

    numbered = F.transform(F.col("lines"), lambda l, i: F.struct(i.alias("line"), strip(l).alias("title")))
    hits = F.filter(numbered, lambda x: (x["title"] != "") & x["title"].rlike(_any_of(patterns)))
    found = F.transform(hits, lambda x: F.struct(x["line"].alias("line"), x["title"].alias("title"),
                                                 which(x["title"]).alias("pattern"), level(x["title"]).alias("level")))
    return df.withColumn("lines", split_lines(F.col(text))).withColumn("simple_sections", found)
