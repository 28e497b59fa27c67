"""Fixity audit of record archives by Merkle trees over ordered offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.store import rows_of, stored

FANOUT = 64


def _number(digest: Column, start: int) -> Column:
    """Eight hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def leaves(chunks: DataFrame) -> DataFrame:
    """One leaf per archive and offset: namespace, chunk_index, hash, records.

    ``chunks(namespace, chunk_id, chunk_index, text)``: records of an archive at their ordered offsets.
    Records at one offset are added up whatever their number and order, so no group is collected."""
    part = [F.concat(F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(c).cast("string"))), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in ("chunk_id", "text")]
    rows = chunks.select(
        F.coalesce(F.col("namespace").cast("string"), F.lit("")).alias("namespace"), F.coalesce(F.col("chunk_index").cast("bigint"), F.lit(-1)).alias("chunk_index"),
        F.col("chunk_id").cast("string").alias("chunk_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("namespace", "chunk_index", F.sha2(F.concat(*part), 256).alias("digest"))
    sums = [F.sum(_number(F.col("digest"), 1 + 8 * i)).alias(f"s{i}") for i in range(8)]
    mixed = [F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in range(2)]
    found = rows.groupBy("namespace", "chunk_index").agg(F.count(F.lit(1)).alias("records"), *sums, *mixed)
    names = [*(f"s{i}" for i in range(8)), "x0", "x1"]
    return found.select("namespace", "chunk_index", F.sha2(F.concat_ws(",", F.col("records").cast("string"), *(F.col(n).cast("string") for n in names)), 256).alias("hash"), "records")


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: one hash per ``fanout`` consecutive ranges, over their hashes in order."""
    child = F.struct(F.col("chunk_index").alias("i"), F.col("hash").alias("h"))
    listed = level.groupBy("namespace", F.expr(f"chunk_index div {fanout}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("c"))
    text = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["i"].cast("string"), x["h"])), ",")
    return listed.select("namespace", F.col("up").alias("chunk_index"), F.sha2(text, 256).alias("hash"))


def merkle_levels(chunks: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored levels of the trees of all archives, leaves first, ``height`` levels of ranges above."""
    levels = [stored(leaves(chunks))]
    for _ in range(height):
        levels.append(stored(parents(levels[-1], fanout)))
    return levels


def needed_height(*replicas: DataFrame, fanout: int = FANOUT) -> int:
    """Levels until every archive has one root."""
    most = max((r.agg(F.max(F.col("chunk_index").cast("bigint"))).first()[0] or 0 for r in replicas), default=0)
    height = 1
    while most >= fanout**height:
        height += 1
    return height


def audit(expected: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records of a replica that differ, found from the roots downwards.

    Both are ``chunks(namespace, chunk_id, chunk_index, text)``: archives of records at ordered
    offsets. Result: ``namespace``, ``chunk_index``, ``status`` (changed, missing, extra) and the
    ``expected_records`` and ``found_records`` at that offset.

    Both sides are hashed once into trees whose nodes are ranges of ``fanout`` offsets, so an archive
    with a third of all records is as many groups as its ranges. Roots are compared, then
    only the children of differing nodes, level by level; equal branches are never read again.

    A NULL offset counts as -1, a NULL namespace as the empty one; NULL and empty contents differ.
    Repeated records count: another number of copies is a change. Other columns are ignored.
    """
    height = needed_height(expected, replica, fanout=fanout)
    left, right = merkle_levels(expected, height, fanout), merkle_levels(replica, height, fanout)
    suspects = None
    for depth in range(height, -1, -1):
        sides = []
        for name, levels in (("a", left), ("b", right)):
            level = levels[depth].withColumn("key", F.xxhash64("namespace", F.expr(f"chunk_index div {fanout}")))
            if suspects is not None:
                level = rows_of(level, suspects, "key")
            columns = ["hash", "records"] if depth == 0 else ["hash"]
            sides.append(level.select("namespace", "chunk_index", *(F.col(c).alias(f"{c}_{name}") for c in columns)))
        differing = sides[0].join(sides[1], ["namespace", "chunk_index"], "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        if depth:
            suspects = stored(differing.select(F.xxhash64("namespace", "chunk_index").alias("key")))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("changed")
    return differing.select("namespace", "chunk_index", status.alias("status"), F.coalesce("records_a", F.lit(0)).alias("expected_records"), F.coalesce("records_b", F.lit(0)).alias("found_records"))
