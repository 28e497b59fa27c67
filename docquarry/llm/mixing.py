"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.store import stored
from docquarry.scale import broadcast_if_small

WEIGHTS = (3, 1, 2)
BUDGET = 1.5  # share of all words that the mix takes
MOST = 2  # copies of a document at most
BLOCK_ROWS = 4096  # documents that one leaf of the tree rounds
FAN = 64  # leaves or nodes whose rests meet in one node above
SEED = 20
ROUNDED = "source_no bigint, block bigint, doc_id bigint, size bigint, n bigint, share double, more int"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for NULL: each word and the space around it become one letter."""
    words = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x"))
    return F.when(text.rlike(r"[^\x20\x09-\x0D]"), words).otherwise(0).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``sources(source, source_size, documents)`` -> the same and ``source_no``, ``weight``, ``target``.

    Sources in code point order, NULL last, weigh ``weights`` in turn and share ``budget`` times
    all sizes. A target stops at ``most`` times its source's size, and what is above is shared
    again by weight among the others until none is above. Positions are counted per range
    partition, so that no task sees all sources; the driver sees one sum per round.
    """
    order = F.col("source").asc_nulls_last()
    ordered = stored(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))  # a row per range
    turn = F.array(*map(F.lit, weights))
    ranked = ordered.join(F.broadcast(parts), "part").withColumn("source_no", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    ranked = ranked.withColumns({"weight": turn[(F.col("source_no") % len(weights)).cast("int")], "most": most * F.col("source_size").cast("double")}).drop("at", "part", "before")

    total, heavy = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, mark = (budget * total / heavy if heavy else 0.0), None
    while heavy:
        above = F.col("most") < level * F.col("weight")
        full, open_weight, n = ranked.agg(F.sum(F.when(above, F.col("most"))), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == mark or not open_weight:
            break
        level, mark = (budget * total - (full or 0.0)) / open_weight, n
    return ranked.withColumn("target", F.least(F.col("most"), level * F.col("weight"))).drop("most")


def rounded_block(rows: Sequence[tuple], random: np.random.Generator, equal_shares: bool, last: bool) -> tuple[list[tuple], tuple | None]:
    """Pivotal steps within one block of rows (doc_id, size, n, share), largest documents first.

    A step pairs the document left over with the next one and moves words between them until
    one takes all or nothing of its size; which way is drawn so that either expectation and the
    sum of words stay. ``n`` equal rows keep one fractional row. Where shares are equal, a
    document that its successors can hardly balance one by one is drawn while they still can
    together, and the difference goes to their shares. Returns decided rows (doc_id, size, n,
    0 or 1) and the row left over; at the ``last`` level that row is drawn by its share.
    """
    decided, rest, drift = [], None, 0.0  # rest: [doc_id, size, words taken of it]
    behind = np.cumsum([size * n for _, size, n, _ in rows][::-1])[::-1].tolist() + [0]

    def settle(item):
        """The item itself if it is still between nothing and all of its size."""
        doc, size, words = item
        if 1e-9 * size < words < (1 - 1e-9) * size:
            return item
        decided.append((doc, size, 1, int(2 * words > size)))
        return None

    for i, (doc, size, n, share) in enumerate(rows):
        share = min(1.0, max(0.0, share + drift))
        if equal_shares and rest is not None:
            room = min(share, 1 - share)
            if behind[i] * room >= rest[1] > behind[i + 1] * room:
                taken = int(random.random() < rest[2] / rest[1])
                decided.append((rest[0], rest[1], 1, taken))
                moved = (rest[2] - taken * rest[1]) / behind[i]
                drift, share, rest = drift + moved, min(1.0, max(0.0, share + moved)), None
        if n > 1:
            ones = min(n, math.floor(n * share + 1e-9))
            share = max(0.0, n * share - ones)
            whole = share < 1e-9
            decided += [(doc, size, k, more) for more, k in ((1, ones), (0, n - ones - (not whole))) if k]
            if whole:
                continue
        item = [doc, size, share * size]
        if rest is None:
            rest = settle(item)
            continue
        up, down = min(rest[1] - rest[2], item[2]), min(rest[2], size - item[2])
        moved = up if random.random() * (up + down) < down else -down
        rest[2], item[2] = rest[2] + moved, item[2] - moved
        rest, item = settle(rest), settle(item)
        rest = rest or item
    if rest is not None and last:
        decided.append((rest[0], rest[1], 1, int(random.random() < rest[2] / rest[1])))
        rest = None
    return decided, rest and (rest[0], rest[1], 1, rest[2] / rest[1])


def rounded(rows: DataFrame, level: int, last: bool, seed: int = SEED) -> DataFrame:
    """One level of the tree: ``rounded_block`` for each (source_no, block).

    ``more`` is 0 or 1 where a row is decided and NULL in the one row that a block leaves
    for the level above."""

    def batch(group, block):
        random = np.random.Generator(np.random.Philox(key=np.array([seed << 32 | level, group[0] << 32 ^ group[1]], np.uint64)))
        decided, rest = rounded_block(block, random, level == 0, last)
        out = [(*group, doc, size, n, 0.0, more) for doc, size, n, more in decided] + ([(*group, *rest, None)] if rest else [])
        types = [pa.int64()] * 5 + [pa.float64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["source_no", "block", "doc_id", "size", "n", "share", "more"])

    def run(batches):
        group, block = None, []
        for part in batches:
            for source, number, *row in zip(*(part.column(i).to_pylist() for i in range(6))):
                if (source, number) != group:
                    if block:
                        yield batch(group, block)
                    group, block = (source, number), []
                block.append(row)
        if block:
            yield batch(group, block)

    rows = rows.select("source_no", "block", "doc_id", "size", "n", "share").repartition("source_no", "block")
    return rows.sortWithinPartitions("source_no", "block", F.desc("size"), "doc_id").mapInArrow(run, ROUNDED)


def mix_sources(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    block_rows: int = BLOCK_ROWS,
    fan: int = FAN,
    seed: int = SEED,
) -> DataFrame:
    """How often each document enters a mix in which every source has its target of words.

    ``documents(doc_id, source, text)`` -> one row per input row: ``doc_id``, ``source``,
    ``size`` (words), ``source_size``, ``target`` (of the source, see ``source_targets``),
    ``copies``, ``taken`` (``copies * size``).

    Every document of a source has the same fractional number of copies. Its whole part is
    taken; the fractions are rounded by pivotal steps that keep the words of the source: in
    leaves of about ``block_rows`` documents first, then the one document that each leaf leaves
    over meets those of ``fan`` leaves in the node above, until one is left per source. Leaves
    start with their longest document, so what is left is short, and a source misses its
    target by less than one such document. Only ids and sizes are shuffled. Draws follow from
    ``seed``, source and block, so reruns agree.

    NULL, empty and blank texts have size 0 and take nothing. A NULL source is a source of
    its own. Equal rows (doc_id, source, size) are rounded as a group, so they do not fill one leaf;
    NULL ids stay. Other columns are ignored; an empty table gives an empty result.
    """
    sized = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    sized = stored(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("documents"))
    sources = stored(source_targets(sources, weights, budget, most))
    names = broadcast_if_small(sources.withColumnRenamed("source", "name"))
    rows = sized.join(names, F.col("source").eqNullSafe(F.col("name")))
    rate = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    blocks = F.ceil(F.col("documents") / block_rows)
    rows = rows.select(
        "source_no", F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"), "doc_id", "size", "n",
        (rate - F.floor(rate)).alias("share"), F.lit(0).alias("more"))
    done = [rows.filter("share = 0")]
    width = math.ceil((sources.agg(F.max("documents")).first()[0] or 0) / block_rows)
    open_rows, level = rows.filter("share > 0"), 0
    while width:
        made = stored(rounded(open_rows, level, width == 1, seed))
        done.append(made.filter("more IS NOT NULL"))
        open_rows = made.filter("more IS NULL").withColumn("block", F.expr(f"block div {fan}"))
        level, width = level + 1, (0 if width == 1 else math.ceil(width / fan))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    found = found.select("source_no", "doc_id", "size", "more", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("_row"))
    found = found.join(broadcast_if_small(sources.select("source_no", "source", "source_size", "target")), "source_no")
    whole = F.when(F.col("size") > 0, F.floor(F.least(F.lit(float(most)), F.col("target") / F.col("source_size")))).otherwise(0)
    copies = (whole + F.col("more")).cast("bigint")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
