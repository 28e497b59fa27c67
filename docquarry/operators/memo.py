"""Reuse of earlier results by key and age."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh(memo: DataFrame, now: Column) -> DataFrame:
    """Latest entry per key that has not outlived its own time to live.

    ``memo`` has key, payload, created_at and ttl_seconds."""
    alive = memo.filter(F.unix_micros("created_at") > F.unix_micros(now) - F.col("ttl_seconds") * F.lit(1_000_000))
    latest = F.max_by(F.struct(*memo.columns), F.struct("created_at", "payload"))
    return alive.groupBy("key").agg(latest.alias("_row")).select("_row.*")


def split_by_memo(items: DataFrame, memo: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(hits with their payload, misses). Items have a key."""
    known = fresh(memo, now).select("key", "payload")
    return items.join(known, "key"), items.join(known.select("key"), "key", "left_anti")


def distinct_work(items: DataFrame, key: Column, payload: str = "text") -> DataFrame:
    """One row per distinct key, so equal texts are computed once."""
    return items.select(key.alias("key"), payload).groupBy("key").agg(F.first(payload).alias(payload))


def compute_with_memo(items: DataFrame, memo: DataFrame, now: Column, compute: Callable[[DataFrame], DataFrame], payload: str = "text") -> DataFrame:
    """Payload per item: from the memo where fresh, else computed once per distinct key.

    ``compute`` maps (key, text) rows to (key, payload) rows."""
    hits, misses = split_by_memo(items, memo, now)
    computed = compute(distinct_work(misses, F.col("key"), payload)).select("key", "payload")
    return hits.unionByName(misses.join(computed, "key", "left"))


def latest_versions(rows: DataFrame, keys: list[str], version: str, tie: str | None = None) -> DataFrame:
    """Upsert inside a frame: the row of the highest version per key.

    An aggregate and not a window: the maximum combines inside the tasks, so a key
    with very many versions stays cheap. ``tie`` orders rows of equal version."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(version, *([tie] if tie else [])))
    return rows.groupBy(*keys).agg(best.alias("_row")).select(*[c if c in keys else F.col("_row").getField(c).alias(c) for c in rows.columns])


def not_processed(documents: DataFrame, processed: DataFrame) -> DataFrame:
    """Documents of namespaces that were not processed before."""
    return documents.join(processed.select("namespace").distinct(), "namespace", "left_anti")
