"""Pipe tables: detection, removal from the text, conversion to markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions.text import occurrences, strip
from docquarry.scale import explode_rows

# separator to look for in the first row, pattern that splits every row
SEPARATORS = [("|", r"\|"), ("\t", r"\t"), ("  ", r"\s{2,}"), ("   ", r"\s{2,}")]


def markdown_table(rows: Column) -> Column:
    """Markdown of table lines; NULL when no separator yields two usable rows.

    The first usable row is the header; rows with another column count are dropped.
    """
    lines = F.filter(F.transform(rows, strip), lambda l: l != "")
    first = F.try_element_at(lines, F.lit(1))

    def bar(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def render(split: str) -> Column:
        cells = F.filter(
            F.transform(lines, lambda l: F.transform(F.split(l, split), strip)), lambda c: F.size(c) > 1
        )
        head = F.try_element_at(cells, F.lit(1))
        width = F.size(head)
        rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), width), "|"), F.lit("|"))
        body = F.transform(F.filter(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), lambda c: F.size(c) == width), bar)
        text = F.array_join(F.concat(F.array(bar(head), rule), body), "\n")
        return F.when(F.size(cells) >= 2, text)

    attempts = [F.when(first.contains(found), render(split)) for found, split in SEPARATORS]
    return F.when(F.size(lines) >= 2, F.coalesce(*attempts))


def with_tables(df: DataFrame, lines: str = "lines", min_pipes: int = 2, max_lines: int | None = None) -> DataFrame:
    """Add ``table_blocks`` and ``text_lines`` (the lines with each table as one blank line).

    A block is a run of consecutive lines with at least ``min_pipes`` pipes; runs
    that cannot be converted stay in the text. ``max_lines`` restricts detection
    to the head of the text; by default the whole text is scanned.
    """
    scanned = F.col(lines) if max_lines is None else F.slice(F.col(lines), 1, max_lines)
    df = df.withColumn("_t", F.transform(scanned, lambda l: occurrences(l, "|") >= min_pipes))
    t = F.col("_t")
    edge = lambda keep: F.filter(F.transform(t, lambda f, i: F.when(f & keep(i), i)), lambda i: i.isNotNull())
    starts = edge(lambda i: (i == 0) | ~F.coalesce(F.try_element_at(t, i), F.lit(False)))
    ends = edge(lambda i: ~F.coalesce(F.try_element_at(t, i + 2), F.lit(False)))
    df = df.withColumn("_runs", F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start_line"), e.alias("end_line"))))

    def block(r: Column) -> Column:
        rows = F.slice(F.col(lines), r["start_line"] + 1, r["end_line"] - r["start_line"] + 1)
        return F.struct(
            F.array_join(rows, "\n").alias("original_text"), markdown_table(rows).alias("markdown"),
            r["start_line"].alias("start_line"), r["end_line"].alias("end_line"), F.size(rows).alias("row_count"),
        )

    df = df.withColumn("table_blocks", F.filter(F.transform(F.col("_runs"), block), lambda b: b["markdown"].isNotNull()))
    blocks, all_lines = F.col("table_blocks"), F.col(lines)

    def until(b: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(-1)).otherwise(F.try_element_at(blocks, i)["end_line"])
        return F.concat(F.slice(all_lines, before + 2, b["start_line"] - before - 1), F.array(F.lit("")))

    last = F.try_element_at(blocks, F.size(blocks))["end_line"]
    rest = F.slice(all_lines, last + 2, F.size(all_lines) - last - 1)
    rebuilt = F.concat(F.flatten(F.transform(blocks, until)), rest)
    df = df.withColumn("text_lines", F.when(F.size(blocks) == 0, all_lines).otherwise(rebuilt))
    return df.drop("_t", "_runs")


def table_blocks(df: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Exploded table blocks of a frame prepared by ``with_tables``."""
    rows = explode_rows(df, keys, "table_blocks", "table_index", "b")
    return rows.select(*keys, "table_index", "b.*")


def table_chunk_text(markdown: Column, original: Column) -> Column:
    return F.concat(F.lit("TABLE:\n"), markdown, F.lit("\n\nORIGINAL FORMAT:\n"), original)


def html_table_to_markdown(html: Column) -> Column:
    """Line-based conversion of an HTML table with one tag per line."""

    def convert(line: Column) -> Column:
        cell = line.contains("<td>") | line.contains("<th>")
        content = strip(F.regexp_replace(line, r"</?t[dh]>", ""))
        return (
            F.when(line.contains("<tr>"), F.lit(None).cast("string"))
            .when(line.contains("</tr>"), F.lit("|"))
            .when(cell, F.concat(F.lit("| "), content, F.lit(" ")))
            .otherwise(line)
        )

    return F.array_join(F.filter(F.transform(F.split(html, "\n"), convert), lambda l: l.isNotNull()), "\n")
