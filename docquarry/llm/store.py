"""Intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where it is unset, as in local tests,
    a new temporary folder becomes the setting of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docquarry-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write a frame once as Parquet in the shared folder and read it again.

    Later steps start from files that outlive any executor, with column pruning
    and with the sizes of the files as statistics."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docquarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Longest id list that is sent to every task: 2,000,000 ids of 8 bytes.
BROADCAST_IDS = 2_000_000


def rows_of(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (one column ``key``), or is not (``left_anti``).

    A counted list of at most ``limit`` ids of a fixed 8 bytes goes to all tasks, so
    texts stay where they are; a longer one is joined by a shuffle."""
    small = ids.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(ids) if small else ids, key, how)
