"""Choices that depend on data size: checked broadcasts, salted top-k, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 * 1024 * 1024


def _width(f: T.StructField) -> Column:
    """Bytes of a value: texts and arrays by their length, other types a fixed number."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.StringType):
        size = F.octet_length(c)
    elif isinstance(f.dataType, T.BinaryType):
        size = F.length(c)
    elif isinstance(f.dataType, T.ArrayType):
        inner = F.octet_length(F.array_join(c, "")) if isinstance(f.dataType.elementType, T.StringType) else F.lit(0)
        size = F.size(c) * 16 + inner
    else:
        size = F.lit(16)
    return F.coalesce(size, F.lit(0)).cast("bigint") + 16


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when a bounded look proves the side small, in rows and bytes.

    Beyond either bound the frame is returned without a hint: the same join then
    runs as a shuffled join, and adaptive execution splits its skewed keys.
    """
    width = sum((_width(f) for f in df.schema.fields), F.lit(0).cast("bigint"))
    rows, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int | str,
    *,
    bound: int | None = None,
    rank: str = "rank_position",
    salt: Column | None = None,
    salts: int = 1,
) -> DataFrame:
    """First ``k`` rows per key in the given order, with their 1-based rank.

    The literal bound lets Spark prune to ``bound`` rows per key and task before
    the shuffle. With ``salts`` > 1 a first round ranks within (key, salt), so a
    key fed by very many tasks is reduced by many tasks. ``k`` may name a column.
    """
    limit = int(k) if bound is None else int(bound)
    order = list(order)
    if salts > 1 and salt is not None:
        salted = Window.partitionBy(*keys, F.pmod(F.hash(salt), F.lit(salts))).orderBy(*order)
        df = df.withColumn("_r", F.row_number().over(salted)).filter(F.col("_r") <= limit).drop("_r")
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranked = ranked.filter(F.col(rank) <= limit)
    return ranked.filter(F.col(rank) <= F.col(k)) if isinstance(k, str) else ranked


SMALL_INPUT = 64 * 1024 * 1024


def spread_small(df: DataFrame, max_bytes: int = SMALL_INPUT) -> DataFrame:
    """Spread a small table over all cores; a large one has splits enough as it is.

    A file of one row group is one task whatever the number of cores. The size is
    the optimizer's estimate from file lengths, so no job runs."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if int(str(size)) <= max_bytes else df


def explode_rows(df: DataFrame, keys: Sequence, array: str | Column, position: str, value: str) -> DataFrame:
    """One row per array element with its 0-based position.

    An outer explode followed by a NULL filter: the inner form would make the
    optimizer evaluate the (often expensive) array a second time in a filter.
    """
    rows = df.select(*keys, F.posexplode_outer(array).alias(position, value))
    return rows.filter(F.col(position).isNotNull())


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame that several branches reuse, in the shared checkpoint folder.

    The folder is the cluster's ``spark.checkpoint.dir``. Without one the plan is
    returned as it is: recomputing is slower but survives lost executors too.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def write_once(df: DataFrame) -> DataFrame:
    """Write a large frame as Parquet in the shared checkpoint folder and read it again.

    Unlike a checkpoint the copy is columnar: each reader gets its columns and filters only.
    Without ``spark.checkpoint.dir`` a local session uses a temporary folder; a cluster must set it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-")
    path = f"{folder.rstrip('/')}/docquarry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
