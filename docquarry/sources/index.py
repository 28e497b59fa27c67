"""The chunk and vector tables on shared storage: small commits, merged on read.

A table is a folder of layers, which are never changed, and a log. A commit first writes its
layer, the new rows or the names of deleted namespaces, and then one line of the log. Spark
moves the one file of that line into place in one rename, so a reader sees the table before
or after a commit and a job that dies in between leaves the table as it was. An upsert
writes its own rows only, however large the table is; ``compact`` folds the layers into one.

Namespaces can be as many as documents, so layers are partitioned by a fixed number of namespace
buckets and sorted by namespace inside; readers prune buckets by partition and namespaces
by row-group statistics. Rows are range partitioned before a write, so a namespace with
a third of all rows still spreads over tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.text import is_blank
from docquarry.operators.memo import latest_versions, not_processed

BUCKETS = 64
SEQ, NEW = "_seq", "_tomb"


def bucket_of(namespace: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(namespace), F.lit(buckets)).cast("int")


# --- the log ---------------------------------------------------------------------------

def _log(spark: SparkSession, path: str) -> list[dict]:
    """All commits in order; a few short lines per commit since the table began."""
    try:
        lines = spark.read.text(f"{path}/log").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((json.loads(r[0]) for r in lines), key=lambda e: (e["number"], e["id"]))


def live_layers(spark: SparkSession, path: str) -> list[dict]:
    """Commits that a reader merges: those that no compaction replaced. Of two compactions of the same layers the first counts."""
    replaced, live = set(), []
    for entry in _log(spark, path):
        if replaced & set(entry["replaces"]):
            continue
        replaced |= set(entry["replaces"])
        live.append(entry)
    return [e for e in live if e["id"] not in replaced]


def _commit(spark: SparkSession, path: str, entry: dict) -> None:
    """Append one line to the log: one file, which its rename makes visible."""
    spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.mode("append").text(f"{path}/log")


def _next(spark: SparkSession, path: str) -> tuple[int, str]:
    return max((e["number"] for e in _log(spark, path)), default=0) + 1, uuid.uuid4().hex


def _write(df: DataFrame, path: str, key: str, buckets: int) -> None:
    rows = df.withColumn("ns_bucket", bucket_of(F.col("namespace"), buckets))
    rows = rows.repartitionByRange("ns_bucket", "namespace", key).sortWithinPartitions("ns_bucket", "namespace", key)
    rows.write.partitionBy("ns_bucket").parquet(path)


def _add(path: str, rows: DataFrame | None, gone: DataFrame | None, key: str, buckets: int, spark: SparkSession, replaces: Sequence[str] = (), seq: int | None = None) -> None:
    """Write the layers of one commit, then the commit. ``gone`` has the namespaces whose earlier rows go."""
    number, name = _next(spark, path)
    entry = {"number": number, "id": name, "seq": seq or number, "rows": None, "gone": None, "schema": None, "replaces": list(replaces)}
    if rows is not None:
        entry["rows"], entry["schema"] = f"layers/{name}-rows", rows.schema.jsonValue()
        _write(rows, f"{path}/{entry['rows']}", key, buckets)
    if gone is not None:
        entry["gone"] = f"layers/{name}-gone"
        gone.select(F.col("namespace").cast("string").alias("namespace")).distinct().write.parquet(f"{path}/{entry['gone']}")
    _commit(spark, path, entry)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_log(spark, path))


# --- reading -----------------------------------------------------------------------------

def _latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row per namespace and key: the highest version."""
    return latest_versions(rows, ["namespace", key], version) if version in rows.columns else rows.dropDuplicates(["namespace", key])


def read_table(
    spark: SparkSession, path: str, namespaces: Sequence[str] | None = None, buckets: int = BUCKETS, key: str = "chunk_id", version: str = "version",
) -> DataFrame:
    """The table, or some namespaces of it with buckets pruned by partition.

    Rows of the oldest layer meet the keys of later layers, see ``_merged``. Names of deleted namespaces
    drop rows of earlier commits. Both lists are joined by a broadcast if their files are small."""
    live = live_layers(spark, path)
    if not live:
        raise FileNotFoundError(f"no table at {path}")

    def layer(entry: dict) -> DataFrame:
        rows = spark.read.schema(T.StructType.fromJson(entry["schema"]).add("ns_bucket", T.IntegerType())).parquet(f"{path}/{entry['rows']}")
        if namespaces is not None:
            wanted = [bucket_of(F.lit(n), buckets) for n in namespaces]
            rows = rows.filter(F.col("ns_bucket").isin(*wanted) & F.col("namespace").isin(list(namespaces)))
        rows = rows.drop("ns_bucket")
        later = [e for e in live if e["gone"] and e["seq"] > entry["seq"]]
        for e in later:
            rows = rows.join(spark.read.schema("namespace string").parquet(f"{path}/{e['gone']}"), "namespace", "left_anti")
        return rows

    layers = [layer(e).withColumn(SEQ, F.lit(n)) for n, e in enumerate(sorted((e for e in live if e["rows"]), key=lambda e: e["seq"]))]
    if not layers:
        raise FileNotFoundError(f"no rows at {path}")
    oldest, *newer = layers
    if not newer:
        return oldest.drop(SEQ)
    return _merged(oldest, newer, key, version).drop(SEQ)


def _merged(oldest: DataFrame, newer: Sequence[DataFrame], key: str, version: str) -> DataFrame:
    """Rows of layers in the order of SEQ, each of which has a key once: of every key the row that ``_latest`` takes.

    Which row stays follows from namespaces, keys and versions alone, so a reader moves, once, the other columns it uses only."""
    changed = newer[0]
    for rows in newer[1:]:
        changed = changed.unionByName(rows, allowMissingColumns=True)
    schema = oldest.unionByName(changed, allowMissingColumns=True).schema

    def age(rows: DataFrame) -> Column:
        if version not in schema.names:
            return F.struct(SEQ)
        number = F.col(version) if version in rows.columns else F.lit(None)
        return F.struct(number.cast(schema[version].dataType).alias("v"), SEQ)

    top = changed.groupBy(F.col("namespace").alias("_ns"), F.col(key).alias("_key")).agg(F.max(age(changed)).alias("_top"))
    same = (F.col("namespace") == F.col("_ns")) & (F.col(key) == F.col("_key"))
    kept = oldest.join(top, same, "left").filter(F.col("_top").isNull() | (age(oldest) > F.col("_top"))).select(oldest.columns)
    equal = F.col("namespace").eqNullSafe(F.col("_ns")) & F.col(key).eqNullSafe(F.col("_key"))
    columns = changed.columns
    if len(newer) > 1:
        changed = changed.join(top, equal & (age(changed) >= F.col("_top"))).select(columns)
    held = oldest.join(top, same & (age(oldest) > F.col("_top"))).select("_ns", "_key")  # by a higher version in the oldest layer
    return kept.unionByName(changed.join(held, equal, "left_anti"), allowMissingColumns=True)


# --- writing -----------------------------------------------------------------------------

def upsert(new: DataFrame, path: str, key: str = "chunk_id", version: str = "version", buckets: int = BUCKETS) -> None:
    """Insert or replace by key; the higher version wins, and the new row if versions are equal.
    Only the new rows are written."""
    _add(path, _latest(new, key, version), None, key, buckets, new.sparkSession)


def append_vectors(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Add vectors of namespaces that are not in the table yet; blank namespaces are refused."""
    spark = new.sparkSession
    if new.filter(is_blank(F.col("namespace"))).limit(1).count():
        raise ValueError("vectors need a namespace")
    if exists(spark, path):
        new = not_processed(new, read_table(spark, path).select("namespace").distinct())
    _add(path, _latest(new, "chunk_id", "version"), None, "chunk_id", buckets, spark)


def delete_namespaces(spark: SparkSession, path: str, doomed: Column, key: str = "chunk_id", buckets: int = BUCKETS) -> None:
    """Drop the rows of every namespace for which the predicate holds: its names are written, no row is."""
    _add(path, None, read_table(spark, path, key=key).filter(doomed).select("namespace"), key, buckets, spark)


def matches_pattern(namespace: Column, patterns: Sequence[str] = ("test-%", "dev-%")) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | namespace.like(p)
    return out


def replace_namespaces(new: DataFrame, path: str, key: str = "chunk_id", version: str = "version", buckets: int = BUCKETS) -> None:
    """Reprocess: the namespaces of ``new`` are replaced as a whole in one commit, never deleted
    first and then missing."""
    _add(path, _latest(new, key, version), new.select("namespace"), key, buckets, new.sparkSession)


def compact(spark: SparkSession, path: str, key: str = "chunk_id", version: str = "version", buckets: int = BUCKETS, keep: Column | None = None) -> list[str]:
    """Fold all layers into one, of the rows for which ``keep`` holds, and return the folders that readers no longer need.

    Commits that others make meanwhile stay valid: the new layer stands for the commits it
    read and has their place in the order."""
    live = live_layers(spark, path)
    if len(live) < (2 if keep is None else 1):
        return []
    rows = read_table(spark, path, buckets=buckets, key=key, version=version)
    rows = rows if keep is None else rows.filter(keep)
    _add(path, rows, None, key, buckets, spark, [e["id"] for e in live], max(e["seq"] for e in live))
    return [f"{path}/{e[kind]}" for e in live for kind in ("rows", "gone") if e[kind]]


def sanitise_metadata(df: DataFrame) -> DataFrame:
    """Columns a vector table can hold: scalars stay, lists become string lists,
    structs and maps JSON, other types strings; NULL stays NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.transform(c, lambda x: x.cast("string"))
        elif not isinstance(f.dataType, (T.StringType, T.NumericType, T.BooleanType)):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def save_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Write training pairs as JSON lines; returns the header: total and pairs per category."""
    pairs.write.mode("overwrite").json(path)
    return pairs.groupBy("category").agg(F.count(F.lit(1)).alias("pairs"))


def load_pairs(spark: SparkSession, path: str) -> DataFrame:
    from docquarry.operators.curate import PAIRS

    return spark.read.schema(PAIRS).json(path)
