"""URL filters whose list entries hold for a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals that are sent to every task, at most; a host name has 253 characters at most.
BROADCAST_ENTRIES = 100_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and trailing dot; NULL where there is none. An IPv6 host keeps its brackets."""
    host = F.regexp_extract(F.lower(F.trim(url.cast("string"))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and every parent domain of it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated events ``entries(list_name, domain, action, listed_at)`` -> list_name, domain, valid_from, valid_to.

    ``add`` opens an interval and the next event of the same list and domain ends it; the last one is
    open (NULL). Of events at one time ``remove`` wins. Rows without list, domain, time or a known
    action are ignored."""
    rows = entries.select(F.col("list_name").cast("string").alias("list_name"), F.lower(F.trim(F.col("domain"))).alias("domain"), F.lower(F.col("action")).alias("action"), F.col("listed_at").cast("timestamp").alias("listed_at"))
    rows = rows.filter("list_name IS NOT NULL AND domain <> '' AND listed_at IS NOT NULL AND action IN ('add', 'remove')")
    once = rows.groupBy("list_name", "domain", "listed_at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list_name", "domain").orderBy("listed_at")
    ends = once.withColumn("valid_to", F.lead("listed_at").over(order))
    return ends.filter("action = 'add'").select("list_name", "domain", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_captures(documents: DataFrame, entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """Which lists held each captured URL when it was fetched.

    ``documents(doc_id, source, fetched_at)``, ``source`` being the URL, and dated ``entries`` ->
    ``doc_id``, ``source``, ``host``, ``lists`` (sorted names), ``blocked``: one row per document row.

    Entries become validity intervals; each distinct host and fetch time is joined as of its time on
    the host and its parent domains, an equi-join with a range condition. A host with a third of
    all captures is first combined to its distinct times. At most ``broadcast_entries`` counted intervals go to
    all tasks; more are joined by a shuffle whose hot domains adaptive execution splits.

    An URL without a host, or a NULL fetch time, is on no list. Repeated rows stay rows. Columns beside these
    are ignored.
    """
    spans = validity_intervals(entries)
    small = spans.limit(broadcast_entries + 1).count() <= broadcast_entries
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), host_of(F.col("source")).alias("host"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    asked = rows.filter("host IS NOT NULL AND fetched_at IS NOT NULL").select("host", "fetched_at").distinct()
    asked = asked.select("host", "fetched_at", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    active = (F.col("fetched_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched_at") < F.col("valid_to")))
    held = asked.join(F.broadcast(spans) if small else spans, "domain").filter(active)
    lists = held.groupBy("host", "fetched_at").agg(F.sort_array(F.collect_set("list_name")).alias("lists"))
    out = rows.join(lists, ["host", "fetched_at"], "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
    return out.select("doc_id", "source", "host", "lists", (F.size("lists") > 0).alias("blocked"))
