"""Searches and answers that outlive a run: a stored table of results by key and age.

The key holds everything that a result depends on, k and filters included. Entries are
merged as upserts of a few rows, and belong to their namespace, so deleting a namespace from
the table forgets what was found in it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.ids import memo_key, struct_key
from docquarry.operators.memo import fresh
from docquarry.scale import write_once
from docquarry.sources import index

# Seconds that results of each kind stay valid.
SEARCH_SECONDS, ANSWER_SECONDS = 1800, 3600
ENTRIES = "namespace string, key string, payload string, created_at timestamp, ttl_seconds bigint"


def read_memo(spark: SparkSession, path: str) -> DataFrame:
    """All entries of the table, fresh or not; none before the first one was kept."""
    if not index.exists(spark, path):
        return spark.createDataFrame([], ENTRIES)
    return index.read_table(spark, path, key="key", version="created_at").select("namespace", "key", "payload", "created_at", "ttl_seconds")


def remember(entries: DataFrame, path: str) -> None:
    """Keep entries; of one key the latest stays."""
    index.upsert(entries, path, key="key", version="created_at")


def forget_expired(spark: SparkSession, path: str, now: Column) -> list[str]:
    """Fold the table into one layer without entries that have outlived their time."""
    alive = F.unix_micros("created_at") > F.unix_micros(now) - F.col("ttl_seconds") * F.lit(1_000_000)
    return index.compact(spark, path, key="key", version="created_at", keep=alive)


def entries_of(keyed: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rows (namespace, key, payload) as entries made now."""
    return keyed.select("namespace", "key", "payload", now.cast("timestamp").alias("created_at"), F.lit(seconds).cast("bigint").alias("ttl_seconds"))


def reuse_results(
    queries: DataFrame, memo: DataFrame, now: Column, compute: Callable[[DataFrame], DataFrame], key: Sequence[str], *,
    kind: str = "search", seconds: int = SEARCH_SECONDS, order: str = "rank_position",
) -> tuple[DataFrame, DataFrame]:
    """Results of all queries and the entries that are new.

    ``queries`` has query_id, namespace and the columns ``key``, on which a result depends;
    ``compute`` maps such rows to result rows with query_id and ``order``. A query whose key has
    a fresh entry is served from it; of the others each distinct key is computed once. That a
    query has no results is remembered too. Results of one query must fit a row, as a top-k list does.
    """
    keyed = write_once(queries.withColumn("key", memo_key(F.lit(kind), struct_key("namespace", *key))))
    known = fresh(memo, now).select("key", "payload")
    served = keyed.join(known, "key").select("query_id", "payload")
    missed = keyed.join(known, "key", "left_anti")
    work = write_once(missed.dropDuplicates(["key"]))
    found = compute(work.drop("key"))
    fields = [f for f in found.schema.fields if f.name != "query_id"]
    listed = F.sort_array(F.collect_list(F.struct(order, *[f.name for f in fields if f.name != order])))
    packed = found.groupBy("query_id").agg(F.to_json(listed).alias("payload"))
    packed = work.select("query_id", "namespace", "key").join(packed, "query_id", "left").select("namespace", "key", F.coalesce("payload", F.lit("[]")).alias("payload"))
    packed = write_once(packed)
    rows = served.unionByName(missed.select("query_id", "key").join(packed, "key").select("query_id", "payload"))
    schema = T.ArrayType(T.StructType(fields))
    rows = rows.select("query_id", F.explode(F.from_json("payload", schema)).alias("_row")).select("query_id", "_row.*")
    return rows, entries_of(packed, now, seconds)


def search_with_memo(queries: DataFrame, path: str, now: Column, search: Callable[[DataFrame], DataFrame], key: Sequence[str], **options) -> DataFrame:
    """``reuse_results`` with the stored table at ``path``, which then has the new results too."""
    rows, entries = reuse_results(queries, read_memo(queries.sparkSession, path), now, search, key, **options)
    rows = write_once(rows)
    remember(entries, path)
    return rows


def replies_with_memo(ready: DataFrame, path: str, now: Column, reply: Callable[[DataFrame], DataFrame], key: Column, seconds: int = ANSWER_SECONDS) -> DataFrame:
    """``ready`` with a reply column, from the table where one for the same context and question is fresh.

    ``reply`` adds ``reply`` and ``reply_error``; failed replies are not kept."""
    spark = ready.sparkSession
    keyed = write_once(ready.withColumn("key", key))
    known = fresh(read_memo(spark, path), now).select("key", F.col("payload").alias("reply"))
    served = keyed.join(known, "key").withColumn("reply_error", F.lit(None).cast("string"))
    missed = keyed.join(known, "key", "left_anti")
    made = write_once(reply(missed.dropDuplicates(["key"])).select("key", "namespace", "reply", "reply_error"))
    out = write_once(served.unionByName(missed.join(made.drop("namespace"), "key")).drop("key"))
    remember(entries_of(made.filter("reply_error IS NULL").withColumnRenamed("reply", "payload"), now, seconds), path)
    return out
