"""Continuous ingest and request metrics with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.plans.ingest import chunks, prepare


def first_per_namespace(documents: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """At most one document per namespace. With a watermark (column, delay) the
    state of old namespaces is dropped; without one it is kept for good."""
    if watermark is not None:
        return documents.withWatermark(*watermark).dropDuplicatesWithinWatermark(["namespace"])
    return documents.dropDuplicates(["namespace"])


def ingest_stream(documents: DataFrame, path: str, checkpoint: str, *, watermark: tuple[str, str] | None = None,
                  available_now: bool = True, **settings) -> StreamingQuery:
    """Documents with a namespace to a chunk table under ``path``.

    Each batch is written into its own ``batch_id`` partition, overwritten when a
    batch is replayed after a failure, so no chunk is stored twice."""
    fresh = first_per_namespace(documents, watermark)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = chunks(prepare(batch, namespace=F.col("namespace"), **settings)).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_metrics(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: Column | None = None,
                    window: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Requests and mean value per window and kind; rows later than the delay are dropped."""
    rows = events if delay is None else events.withWatermark(ts, delay)
    measured = F.col("value") if value is None else value
    grouped = rows.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count(F.lit(1)).alias("requests"), F.avg(measured).alias("avg_value"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "requests", "avg_value")
