"""Chunkers. Every chunker works inside the document row and explodes once,
so splitting a corpus needs no shuffle and a hot source costs nothing extra."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import lexicon as lx
from docquarry.functions.text import let, sentence_count, strip, word_count
from docquarry.operators.structure import line_range, with_simple_sections
from docquarry.operators.tables import table_chunk_text
from docquarry.scale import explode_rows

# Fields of one chunk before document metadata is attached.
PIECE = [
    ("text", "string"), ("section_header", "string"), ("section_type", "string"), ("chunk_type", "string"),
    ("header_type", "string"), ("header_level", "int"), ("start_line", "int"), ("end_line", "int"),
    ("is_sub_chunk", "boolean"), ("sub_chunk_index", "int"), ("split_level", "string"),
    ("parent_chunk_tokens", "int"), ("sub_chunk_tokens", "int"), ("is_large_chunk", "boolean"),
    ("is_orphaned", "boolean"), ("is_fallback", "boolean"), ("is_definition", "boolean"),
    ("is_exclusion", "boolean"), ("is_table", "boolean"), ("table_index", "int"), ("row_count", "int"),
]
_FLAGS = {n for n, t in PIECE if t == "boolean"}
PACK = "struct<done:array<struct<text:string,tokens:int,level:string>>,cur:array<string>,n:int>"


@lru_cache(maxsize=4)
def _missing(_context: int) -> dict[str, Column]:
    """Typed columns for fields a producer leaves out, built once per session."""
    return {n: (F.lit(False) if n in _FLAGS else F.lit(None).cast(t)).alias(n) for n, t in PIECE}


def piece(**values: Column) -> Column:
    """A chunk struct; missing flags are false, other missing fields NULL."""
    missing = _missing(id(SparkContext._active_spark_context))
    return F.struct(*[values[n].cast(t).alias(n) if n in values else missing[n] for n, t in PIECE])


def _with(p: Column, **values: Column) -> Column:
    return F.struct(*[values[n].cast(t).alias(n) if n in values else p[n].alias(n) for n, t in PIECE])


# --- greedy packing ----------------------------------------------------------------

def _pack(units: Column, limit: int, count: Callable[[Column], Column], render: Callable[[Column], Column],
          level: str, giant: Callable[[Column, Column], Column] | None = None) -> Column:
    """Fold text units into packs of at most ``limit`` tokens (a lone unit may exceed it)."""
    zero = F.struct(F.array().alias("done"), F.array().alias("cur"), F.lit(0).alias("n")).cast(PACK)

    def out(cur: Column, n: Column) -> Column:
        return F.array(F.struct(render(cur).alias("text"), n.alias("tokens"), F.lit(level).alias("level")))

    def state(done: Column, cur: Column, n: Column) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("n")).cast(PACK)

    def step(s: Column, u: Column) -> Column:
        def add(t: Column) -> Column:
            full = (s["n"] + t > limit) & (F.size(s["cur"]) > 0)
            nxt = F.when(full, state(F.concat(s["done"], out(s["cur"], s["n"])), F.array(u), t)).otherwise(
                state(s["done"], F.concat(s["cur"], F.array(u)), s["n"] + t))
            if giant is None:
                return nxt
            # Pieces of an oversized unit come out at once; the open pack keeps growing.
            return let(giant(u, t), lambda g: F.when(g.isNotNull(), state(F.concat(s["done"], g), s["cur"], s["n"])).otherwise(nxt))

        return let(count(u), add)

    return F.aggregate(units, zero, step, lambda s: F.when(
        F.size(s["cur"]) > 0, F.concat(s["done"], out(s["cur"], s["n"]))).otherwise(s["done"]))


def greedy_pieces(text: Column, separator: str = "\n\n", target: int = lx.TARGET_TOKENS, maximum: int = lx.MAX_TOKENS,
                  count: Callable[[Column], Column] = word_count) -> Column:
    """Pack paragraphs to the target; a paragraph above the maximum is packed by sentences."""

    def units(parts: Column) -> Column:
        return F.filter(F.transform(parts, strip), lambda p: p != "")

    def by_sentence(p: Column, t: Column) -> Column:
        joined = lambda cur: F.concat(F.array_join(cur, ". "), F.lit("."))
        return F.when(t > maximum, _pack(units(F.split(p, r"[.!?]+")), target, count, joined, "sentence"))

    return _pack(units(F.split(text, separator)), target, count, lambda cur: F.array_join(cur, separator),
                 "paragraph", by_sentence)


def exceeds_tokens(text: Column, maximum: int = lx.MAX_TOKENS, count=word_count) -> Column:
    return count(text) > maximum


def _subdivide(base: Column, separator: str, target: int, maximum: int, count) -> Column:
    """The piece itself, or its greedy sub-pieces when it exceeds the maximum."""
    def split(total: Column) -> Column:
        packs = F.transform(
            greedy_pieces(base["text"], separator, target, maximum, count),
            lambda g, i: _with(base, text=g["text"], is_sub_chunk=F.lit(True), sub_chunk_index=i, split_level=g["level"],
                               parent_chunk_tokens=total, sub_chunk_tokens=g["tokens"], is_large_chunk=F.lit(False)))
        return F.when(total > maximum, packs).otherwise(F.array(base))

    return let(count(base["text"]), split)


def greedy_chunks(df: DataFrame, keys=("doc_id",), text: str = "text", separator: str = "\n\n",
                  target: int = lx.TARGET_TOKENS, maximum: int = lx.MAX_TOKENS) -> DataFrame:
    """Exploded greedy packs of whole texts."""
    rows = explode_rows(df, keys, greedy_pieces(F.col(text), separator, target, maximum), "sub_chunk_index", "g")
    return rows.select(*keys, "sub_chunk_index", F.col("g.text").alias("text"), F.col("g.tokens").alias("sub_chunk_tokens"),
                       F.col("g.level").alias("split_level"))


# --- chunks of a document with detected structure ------------------------------------

def with_pieces(df: DataFrame, separator: str = "\n\n", target: int = lx.TARGET_TOKENS, maximum: int = lx.MAX_TOKENS,
                min_section: int = 20, min_preamble: int = 20, min_paragraph: int = 50, min_fallback: int = 50,
                fallback_below: int = 50, fallback_headers: int = 100, count=word_count, starts=lx.ITEM_STARTS) -> DataFrame:
    """Add ``pieces``: section chunks with preamble and fallback, or paragraph chunks
    when the document has no headers, then table chunks. Sections of definitions and
    exclusions become one chunk per item. Needs ``lines``, ``headers`` and ``table_blocks``."""
    lines, headers = F.col("lines"), F.col("headers")

    def section_piece(h: Column) -> Column:
        def build(body: Column) -> Column:
            large = let(count(body), lambda n: (n > target) & (n <= maximum)) & (h["level"] <= 2)
            return piece(text=body, section_header=h["text"], section_type=h["section_type"], chunk_type=h["section_type"],
                         header_type=h["type"], header_level=h["level"], start_line=h["content_start"],
                         end_line=h["content_end"], is_large_chunk=large)

        return let(line_range(lines, h["content_start"], h["content_end"]), build)

    def parts(p: Column) -> Column:
        """Items of a section of definitions or exclusions, each subdivided like any section."""
        items = F.transform(_typed_items(p["text"], p["section_type"], starts), lambda t: _with(
            p, text=t, chunk_type=F.when(p["section_type"] == "definitions", F.lit("definition")).otherwise(F.lit("exclusion")),
            is_definition=p["section_type"] == "definitions", is_exclusion=p["section_type"] == "exclusions"))
        itemised = F.coalesce(p["section_type"].isin("definitions", "exclusions"), F.lit(False))
        return let(F.when(itemised & (F.size(items) > 0), items).otherwise(F.array(p)), lambda a: F.flatten(F.transform(a, lambda x: _subdivide(x, separator, target, maximum, count))))

    bodies = F.filter(F.transform(headers, section_piece), lambda p: F.length(p["text"]) >= min_section)
    df = df.withColumn("_sections", F.flatten(F.transform(bodies, parts)))

    first = F.try_element_at(headers, F.lit(1))["line"]
    preamble = line_range(lines, F.lit(0), first - 1)
    orphan = F.when((first > 0) & (F.length(preamble) > min_preamble), F.array(piece(
        text=preamble, section_header=F.lit("Document Preamble"), section_type=F.lit("preamble"),
        chunk_type=F.lit("preamble"), header_type=F.lit("orphaned"), header_level=F.lit(0), start_line=F.lit(0),
        end_line=first - 1, is_orphaned=F.lit(True))))
    df = df.withColumn("_orphans", F.coalesce(orphan, _none()))

    mains = F.filter(headers, lambda h: h["level"] == 1)

    def main_piece(h: Column, i: Column) -> Column:
        nxt = F.try_element_at(F.col("_mains"), i + 2)["line"]
        end = F.coalesce(nxt, F.size(lines)) - 1
        return piece(text=line_range(lines, h["line"], end), section_header=h["text"], section_type=h["section_type"],
                     chunk_type=h["section_type"], header_type=F.lit("fallback_main"), header_level=F.lit(1),
                     is_fallback=F.lit(True))

    sparse = (F.size("_sections") + F.size("_orphans") < fallback_below) & (F.size(headers) > fallback_headers)
    df = df.withColumn("_mains", F.when(sparse, mains))
    grouped = F.filter(F.transform(F.col("_mains"), main_piece), lambda p: F.length(p["text"]) > min_fallback)
    fallback = F.flatten(F.transform(grouped, lambda p: _subdivide(p, separator, target, maximum, count)))

    tables = F.transform("table_blocks", lambda b, i: piece(
        text=table_chunk_text(b["markdown"], b["original_text"]), section_header=F.lit("Tables"),
        section_type=F.lit("table"), chunk_type=F.lit("table_markdown"), is_table=F.lit(True), table_index=i,
        row_count=b["row_count"]))

    structured = F.concat(F.col("_sections"), F.col("_orphans"), F.coalesce(fallback, _none()))
    df = df.withColumn("_whole", F.array_join(lines, "\n")).withColumn("_tokens", count(F.col("_whole")))
    whole = F.col("_whole")
    general = dict(section_header=F.lit("General Content"), section_type=F.lit("general"), chunk_type=F.lit("text"))
    paragraphs = F.transform(paragraph_texts(whole, separator, min_paragraph), lambda p: piece(text=p["text"], **general))
    plain = F.when(F.col("_tokens") > maximum, _subdivide(piece(text=whole, **general), separator, target, maximum, count)).otherwise(paragraphs)
    body = F.when(F.size(headers) > 0, structured).otherwise(plain)
    return df.withColumn("_text_pieces", body).withColumn("pieces", F.concat("_text_pieces", tables)).withColumn(
        "text_pieces", F.size("_text_pieces")).drop("_sections", "_orphans", "_mains", "_text_pieces", "_whole", "_tokens")


def _none() -> Column:
    return F.filter(F.array(piece()), lambda p: F.lit(False))


def paragraph_texts(text: Column, separator: str = "\n\n", min_chars: int = 50) -> Column:
    """Array of struct(index, text) of paragraphs longer than ``min_chars``; the
    index counts all pieces, blank ones included."""
    parts = F.transform(F.split(text, separator), lambda p, i: F.struct(i.alias("index"), strip(p).alias("text")))
    return F.filter(parts, lambda p: F.length(p["text"]) > min_chars)


def paragraph_chunks(df: DataFrame, keys=("doc_id",), text: str = "text", separator: str = "\n\n", min_chars: int = 50) -> DataFrame:
    rows = explode_rows(df, keys, paragraph_texts(F.col(text), separator, min_chars), "chunk_index", "p")
    return rows.select(*keys, "chunk_index", F.col("p.index").alias("paragraph_index"), F.col("p.text").alias("text"))


def text_counts(text: Column) -> dict[str, Column]:
    return {"char_count": F.length(text), "word_count": word_count(text), "line_count": F.size(F.split(text, "\n"))}


def explode_pieces(df: DataFrame, keys) -> DataFrame:
    """One row per piece with its running index in the document and its text counts."""
    rows = explode_rows(df, keys, "pieces", "chunk_index", "p").select(*keys, "chunk_index", "p.*")
    return rows.withColumns(text_counts(F.col("text")))


# --- splitting a section into items ------------------------------------------------------

def item_texts(text: Column, patterns, ignore_case: bool = False) -> Column:
    """A line that matches a start pattern opens a new item; blank lines are dropped."""
    rx = ("(?i)" if ignore_case else "") + "|".join(f"(?:{p})" for p in patterns)
    lines = F.filter(F.split(text, "\n"), lambda l: strip(l) != "")
    opens = F.filter(F.transform(lines, lambda l, i: F.when((i == 0) | strip(l).rlike(rx), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(opens, 2, F.greatest(F.size(opens) - 1, F.lit(0))), F.array(F.size(lines)))
    bounds = F.zip_with(opens, F.slice(ends, 1, F.size(opens)), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    items = F.transform(bounds, lambda b: strip(F.array_join(F.slice(lines, b["s"] + 1, b["e"] - b["s"]), "\n")))
    return F.filter(items, lambda t: t != "")


def _typed_items(text: Column, section_type: Column, starts) -> Column:
    """Items of sections of definitions and exclusions; none of other sections."""
    return F.when(section_type == "definitions", item_texts(text, starts["definitions"], ignore_case=True)).when(
        section_type == "exclusions", item_texts(text, starts["exclusions"])).otherwise(F.filter(F.array(text), lambda t: F.lit(False)))


def section_items(df: DataFrame, keys=("doc_id",), text: str = "text", section_type: str = "section_type",
                  section_header: str = "section_header", starts=lx.ITEM_STARTS) -> DataFrame:
    """Definitions and exclusions one by one, other sections by enumerators and
    bullets, and by paragraphs when nothing else applies."""
    t, st = F.col(text), F.col(section_type)
    paragraphs = F.filter(F.transform(F.split(t, "\n\n"), strip), lambda p: p != "")
    items = (
        F.when(st == "definitions", item_texts(t, starts["definitions"], ignore_case=True))
        .when(st == "exclusions", item_texts(t, starts["exclusions"]))
        .otherwise(item_texts(t, starts["subsections"]))
    )
    found = let(items, lambda a: F.when(F.size(a) > 0, a).otherwise(paragraphs))
    rows = explode_rows(df, [*keys, section_header, section_type], found, "item_index", "text")
    return rows.withColumns({
        "chunk_type": F.when(st == "definitions", F.lit("definition")).when(st == "exclusions", F.lit("exclusion"))
        .otherwise(F.coalesce(F.nullif(st, F.lit("")), F.lit("text"))),
        "is_definition": F.coalesce(st == "definitions", F.lit(False)),
        "is_exclusion": F.coalesce(st == "exclusions", F.lit(False)),
    })


# --- windows over characters ---------------------------------------------------------------

BLOCK = 4096


def text_blocks(text: Column) -> Column:
    """The text in blocks of BLOCK characters. A substring of a long text counts its characters from
    the start each time; one of a block does not."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def block_substring(blocks: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the 0-based ``start`` on, of a text in blocks."""
    first, inside = F.floor(start / BLOCK).cast("int"), (start % BLOCK).cast("int")
    some = F.slice(blocks, first + 1, F.floor((inside + F.greatest(length, F.lit(0))) / BLOCK).cast("int") + 1)
    return F.substring(F.array_join(some, ""), inside + 1, length)


WINDOWS = "struct<start:int,done:array<struct<start_char:int,end_char:int,text:string>>>"


def _sentence_end(window: Column) -> Column:
    """Characters up to the last sentence end in the window; NULL without one."""
    def last(w: Column, p: str) -> Column:
        return F.nullif(F.length(F.regexp_extract(w, rf"(?s)^(.*{p}(?:\s|$))", 1)), F.lit(0))

    return let(window, lambda w: F.coalesce(last(w, r"\."), last(w, "[!?]"), last(w, ";")))


def sliding_windows(text: Column, size: int | Column = 1000, overlap: int | Column = 200) -> Column:
    """Windows cut at the last sentence end of their final fifth, with overlap.

    The next window starts ``overlap`` before the end of this one. The bound on
    the number of windows follows from the smallest possible step.
    """
    return let(F.struct(text.alias("text"), text_blocks(text).alias("blocks")), lambda t: _windows(t, size, overlap))


def _windows(source: Column, size: int | Column, overlap: int | Column) -> Column:
    size, overlap = (F.lit(v) if isinstance(v, int) else v for v in (size, overlap))
    text, blocks = source["text"], source["blocks"]
    total, head = F.length(text), F.floor(size * F.lit(0.8)).cast("int")
    smallest = F.greatest(head + 1 - overlap, F.lit(1))
    zero = F.struct(F.lit(0).alias("start"), F.array().alias("done")).cast(WINDOWS)

    def step(s: Column, _: Column) -> Column:
        start = s["start"]
        search = start + F.greatest(head, F.lit(1))
        snapped = search + _sentence_end(block_substring(blocks, search, start + size - search))
        end = F.when(start + size < total, F.coalesce(snapped, start + size)).otherwise(start + size)

        def cut(w: Column) -> Column:
            entry = F.filter(F.array(w), lambda x: x["text"] != "")
            return F.struct(F.greatest(start + 1, w["end_char"] - overlap).alias("start"),
                            F.concat(s["done"], entry).alias("done")).cast(WINDOWS)

        moved = let(end, lambda e: let(F.struct(
            start.alias("start_char"), e.alias("end_char"), strip(block_substring(blocks, start, e - start)).alias("text")), cut))
        return F.when(start >= total, s).otherwise(moved)

    bound = F.ceil(total / smallest).cast("int")
    folded = F.aggregate(F.sequence(F.lit(0), bound), zero, step, lambda s: s["done"])
    return F.when(total > 0, folded).otherwise(F.slice(folded, 1, 0))


def fixed_windows(text: Column, size: int, overlap: int) -> Column:
    """Windows at a fixed stride: struct(start_char, text)."""
    stride = size - overlap
    if stride < 1:
        raise ValueError("overlap must be smaller than size")
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride)))
    return let(text_blocks(text), lambda blocks: F.transform(starts, lambda s: F.struct(s.alias("start_char"), block_substring(blocks, s, F.lit(size)).alias("text"))))


# --- section-aware line accumulation ----------------------------------------------------------

SECTION = "struct<line:int,title:string,level:int>"
LINES = (
    f"struct<done:array<struct<text:string,start_line:int,end_line:int,section:{SECTION},chunk_type:string>>,"
    f"cur:array<string>,size:int,section:{SECTION},first:int>"
)


def _size(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda a, l: a + F.length(l) + 1)


def overlap_tail(lines: Column, overlap: int) -> Column:
    """Last whole lines whose total length (with line breaks) fits the overlap."""
    def take(s: Column, l: Column) -> Column:
        grown = s["size"] + F.length(l) + 1
        fits = s["open"] & (grown <= overlap)
        return F.struct((s["n"] + fits.cast("int")).alias("n"), grown.alias("size"), fits.alias("open"))

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(True).alias("open"))
    kept = F.aggregate(F.reverse(lines), zero, take, lambda s: s["n"])
    return let(kept, lambda n: F.slice(lines, F.size(lines) - n + 1, n))


def _split_point(lines: Column, target: float) -> Column:
    """How many lines go into the finished chunk when it is split for size."""
    reached = F.aggregate(
        lines, F.struct(F.lit(0).alias("i"), F.lit(0).alias("size"), F.lit(-1).alias("at")),
        lambda s, l: F.struct(
            (s["i"] + 1).alias("i"), (s["size"] + F.length(l) + 1).alias("size"),
            F.when((s["at"] < 0) & (s["size"] + F.length(l) + 1 >= target), s["i"]).otherwise(s["at"]).alias("at")),
        lambda s: s["at"])

    def choose(at: Column) -> Column:
        line = strip(F.try_element_at(lines, at + 1))
        after = (line == "") | line.rlike(r"[.!?;]$")
        return F.when(at < 0, F.floor(F.size(lines) / 2).cast("int")).when(after, at + 1).otherwise(F.greatest(at, F.lit(1)))

    return let(reached, choose)


def section_aware_chunks(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Add ``line_chunks``: lines accumulate; a level 1-2 header closes a chunk that is
    more than half full, and a full chunk is split near four fifths of the size.
    Needs ``lines`` and ``simple_sections``. Line numbers are exact."""
    sec = F.transform("simple_sections", lambda s: F.struct(s["line"].alias("line"), s["title"].alias("title"), s["level"].alias("level")))
    df = df.withColumn("_sec", F.map_from_arrays(F.transform(sec, lambda s: s["line"]), sec))
    zero = F.struct(F.array().alias("done"), F.array().alias("cur"), F.lit(0).alias("size"), F.lit(None).alias("section"),
                    F.lit(0).alias("first")).cast(LINES)

    def state(done, cur, n, section, first) -> Column:
        return F.struct(done.alias("done"), cur.alias("cur"), n.alias("size"), section.alias("section"), first.alias("first")).cast(LINES)

    def emit(s: Column, lines: Column, section: Column, first: Column, kind: str) -> Column:
        return F.concat(s["done"], F.array(F.struct(
            strip(F.array_join(lines, "\n")).alias("text"), first.alias("start_line"),
            (first + F.size(lines) - 1).alias("end_line"), section.alias("section"), F.lit(kind).alias("chunk_type"))))

    def step(s: Column, x: Column) -> Column:
        line, here = x["line"], x["section"]
        width = F.length(line) + 1
        boundary = here.isNotNull() & (here["level"] <= 2) & (s["size"] > size * 0.5) & (F.size(s["cur"]) > 0)
        opened = let(overlap_tail(s["cur"], overlap), lambda tail: state(
            emit(s, s["cur"], s["section"], s["first"], "section_boundary"), F.concat(tail, F.array(line)),
            _size(tail) + width, here, x["i"] - F.size(tail)))

        def split(p: Column) -> Column:
            rest = F.concat(p["kept"], p["tail"])
            return state(emit(s, p["head"], section, s["first"], "size_split"), rest, _size(p["kept"]) + _size(p["tail"]), section,
                         s["first"] + F.size(p["head"]) - F.size(p["kept"]))

        def parts(cur: Column, cut: Column) -> Column:
            return let(F.slice(cur, 1, cut), lambda head: F.struct(
                head.alias("head"), overlap_tail(head, overlap).alias("kept"),
                F.slice(cur, cut + 1, F.size(cur) - cut).alias("tail")))

        def grow(cur: Column) -> Column:
            full = (s["size"] + width >= size) & (F.size(cur) > 1)
            halves = let(_split_point(cur, size * 0.8), lambda cut: let(parts(cur, cut), split))
            return F.when(full, halves).otherwise(state(s["done"], cur, s["size"] + width, section, s["first"]))

        section = F.coalesce(here, s["section"])
        return F.when(boundary, opened).otherwise(let(F.concat(s["cur"], F.array(line)), grow))

    def finish(s: Column) -> Column:
        left = strip(F.array_join(s["cur"], "\n")) != ""
        return F.when(left, emit(s, s["cur"], s["section"], s["first"], "final")).otherwise(s["done"])

    inputs = F.transform("lines", lambda l, i: F.struct(l.alias("line"), i.alias("i"), F.try_element_at(F.col("_sec"), i).alias("section")))
    return df.withColumn("_in", inputs).withColumn("line_chunks", F.aggregate("_in", zero, step, finish)).drop("_sec", "_in")


def chunk_text(df: DataFrame, keys=("doc_id",), text: str = "text", size: int = 1000, overlap: int = 200,
               preserve_sections: bool = True) -> DataFrame:
    """Front-end: section-aware chunks where the text has sections, sliding windows otherwise."""
    common = "array<struct<text:string,chunk_type:string,start_line:int,end_line:int,start_char:int,end_char:int,section_title:string>>"
    df = df.filter(F.length(strip(F.col(text))) >= 10)
    windows = F.transform(sliding_windows(F.col(text), size, overlap), lambda w: F.struct(
        w["text"], F.lit("sliding_window"), F.lit(None), F.lit(None), w["start_char"], w["end_char"], F.lit(None))).cast(common)
    if preserve_sections:
        df = section_aware_chunks(with_simple_sections(df, text), size, overlap)
        by_section = F.transform("line_chunks", lambda c: F.struct(
            c["text"], c["chunk_type"], c["start_line"], c["end_line"], F.lit(None), F.lit(None), c["section"]["title"])).cast(common)
        df = df.withColumn("_c", F.when(F.size("simple_sections") > 0, by_section).otherwise(windows))
    else:
        df = df.withColumn("_c", windows)
    rows = explode_rows(df, [*keys, F.size("_c").alias("total_chunks")], "_c", "chunk_id", "c")
    return rows.select(*keys, "chunk_id", "total_chunks", "c.*").withColumns({
        "char_count": F.length("text"), "word_count": word_count(F.col("text")), "sentences": sentence_count(F.col("text"))})


__all__ = [
    "chunk_text", "exceeds_tokens", "explode_pieces", "fixed_windows", "greedy_chunks", "greedy_pieces", "item_texts",
    "overlap_tail", "paragraph_chunks", "piece", "section_aware_chunks", "section_items", "sliding_windows",
    "text_counts", "with_pieces",
]
