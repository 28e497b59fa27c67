"""Table statistics, memo, upsert, request logs and streams over whole tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from docquarry.catalog.views import CHUNKS_SQL, chunk_view, sql_words, table, tidy
from docquarry.functions.text import word_count
from docquarry.operators import memo, stats
from docquarry.operators.vectors import pair_chunks_with_vectors
from docquarry.sources import index
from docquarry.streaming import jobs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def flagged_chunks(spark, folder):
    return chunk_view(spark, folder).withColumns({
        "is_definition": F.col("chunk_type") == "definition", "is_exclusion": F.col("text").contains("the"), "is_table": F.col("text").contains("|")})


@query(f"""WITH {CHUNKS_SQL} SELECT namespace, CASE WHEN g = 1 THEN 'chunk_type' WHEN g = 2 THEN 'section_type' ELSE 'total' END AS dimension, CASE WHEN g = 1 THEN chunk_type WHEN g = 2 THEN section_type END AS value, n AS chunks
FROM (SELECT namespace, chunk_type, section_type, grouping(chunk_type, section_type) AS g, count(*) AS n FROM chunk GROUP BY GROUPING SETS ((namespace), (namespace, chunk_type), (namespace, section_type)))""")
def chunk_stats(spark, folder):
    return stats.chunk_counts(chunk_view(spark, folder))


@query(f"""WITH {CHUNKS_SQL}, asked AS (SELECT DISTINCT lang AS namespace FROM documents UNION SELECT DISTINCT source FROM documents)
SELECT a.namespace, count(c.chunk_id) > 0 AS exists, count(c.chunk_id) AS total_chunks, count(*) FILTER (c.chunk_type = 'definition') AS definitions_count,
  count(*) FILTER (contains(c.text, 'the')) AS exclusions_count, count(*) FILTER (contains(c.text, '|')) AS tables_count FROM asked a LEFT JOIN chunk c USING (namespace) GROUP BY a.namespace""")
def document_info(spark, folder):
    """Languages are namespaces of the chunk view, sources are not."""
    docs = table(spark, folder, "documents")
    asked = docs.select(F.col("lang").alias("namespace")).union(docs.select("source"))
    return stats.document_info(asked, flagged_chunks(spark, folder))


@query("""SELECT label::VARCHAR AS namespace, count(*) AS vectors, 1::BIGINT AS namespaces FROM embeddings GROUP BY label UNION ALL SELECT NULL, count(*), count(DISTINCT label) FROM embeddings""")
def vector_store_totals(spark, folder):
    return stats.vector_counts(table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("namespace")))


@query("""WITH d AS (SELECT doc_id, md5(text) AS key, text FROM documents), m AS (SELECT DISTINCT md5(text) AS key, sha256(text) AS payload FROM documents WHERE lang = 'en')
SELECT d.doc_id, d.key, CASE WHEN m.key IS NOT NULL THEN 'hit:' || payload ELSE 'new:' || length(text) END AS payload FROM d LEFT JOIN m USING (key)""")
def embedding_reuse(spark, folder):
    """Texts of English documents are in the memo, twice and once too old; others are computed once per distinct text."""
    docs = table(spark, folder, "documents").select("doc_id", F.md5("text").alias("key"), "text", "lang")
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    english = docs.filter("lang = 'en'").select("key", F.concat(F.lit("hit:"), F.sha2("text", 256)).alias("payload"))
    ages = F.array(F.struct(F.lit(60).alias("age"), F.lit("").alias("s")), F.struct(F.lit(600).alias("age"), F.lit("older").alias("s")))
    kept = english.withColumn("a", F.explode(ages)).select(
        "key", F.concat("payload", "a.s").alias("payload"), F.timestamp_micros(F.unix_micros(now) - F.col("a.age") * 1_000_000).alias("created_at"), F.lit(1800).alias("ttl_seconds"))
    stale = docs.select("key", F.lit("stale").alias("payload"), F.timestamp_micros(F.unix_micros(now) - 9_000_000_000).alias("created_at"), F.lit(1800).alias("ttl_seconds"))
    out = memo.compute_with_memo(docs.select("doc_id", "key", "text"), kept.unionByName(stale), now,
                                 lambda todo: todo.select("key", F.concat(F.lit("new:"), F.length("text").cast("string")).alias("payload")))
    return out.select("doc_id", "key", "payload")


@query("""SELECT md5(text) AS chunk_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY md5(text)""")
def upsert_latest(spark, folder):
    """Copies of one text are versions of one row; the highest document id wins."""
    rows = table(spark, folder, "documents").select(F.md5("text").alias("chunk_id"), "doc_id", "source")
    return memo.latest_versions(rows, ["chunk_id"], "doc_id")


@query("SELECT doc_id, source AS namespace FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE lang = 'de' AND doc_id < n_chars / 40)")
def unprocessed_documents(spark, folder):
    docs = table(spark, folder, "documents").withColumnRenamed("source", "namespace")
    return memo.not_processed(docs, docs.filter("lang = 'de' AND doc_id < n_chars / 40")).select("doc_id", "namespace")


@query(f"WITH {CHUNKS_SQL} SELECT c.chunk_id, len(e.embedding) AS dim, c.chunk_index FROM chunk c JOIN (SELECT vec_id, embedding, lang AS ns FROM embeddings JOIN documents ON doc_id = vec_id) e ON c.chunk_id = e.vec_id || '_0' AND c.namespace = e.ns")
def chunk_vector_pairing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("namespace"))
    e = table(spark, folder, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"))
    e = e.select("namespace", F.concat(F.col("vec_id").cast("string"), F.lit("_0")).alias("chunk_id"), "embedding")
    return pair_chunks_with_vectors(chunk_view(spark, folder), e).select("chunk_id", F.size("embedding").alias("dim"), "chunk_index")


@query("""SELECT user_id, count(*) AS total_questions, count(*) FILTER (event_type <> 'error') AS successful_queries, count(*) FILTER (event_type = 'error') AS failed_queries FROM events GROUP BY user_id""")
def success_counts(spark, folder):
    e = table(spark, folder, "events").withColumn("error", F.col("event_type") == "error")
    return stats.success_counts(e, ["user_id"])


def request_rows(spark, folder):
    """Events as documents of a request per user; error events failed with ten questions."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("document_order"), F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
        F.lit(1).alias("successful"), F.lit(0).alias("failed"), F.lit(10).alias("questions"), (F.col("event_id") % 7).alias("chunks"), (F.col("event_id") % 3).alias("tables"),
        F.col("event_type").alias("namespace"), F.array("props", "event_type").alias("answers"))


@query("""SELECT user_id AS request_id, count(*) FILTER (event_type <> 'error') AS successful_queries, (count(*) FILTER (event_type = 'error') * 10)::BIGINT AS failed_queries,
  sum(CASE WHEN event_type <> 'error' THEN event_id % 7 ELSE 0 END)::BIGINT AS document_chunks, sum(CASE WHEN event_type <> 'error' THEN event_id % 3 ELSE 0 END)::BIGINT AS tables_extracted,
  count(event_type) AS documents, count(*) FILTER (event_type = 'error' AND props IS NOT NULL) AS errors FROM events GROUP BY user_id""")
def request_totals(spark, folder):
    return stats.request_totals(request_rows(spark, folder))


@query("""SELECT user_id AS request_id, event_id AS document_order, n AS answer_order, event_type AS document_namespace, CASE WHEN event_type = 'error' THEN props END AS error_detail,
  CASE n WHEN 0 THEN props ELSE event_type END AS answer FROM events, (VALUES (0::BIGINT), (1::BIGINT)) v(n)""")
def request_details(spark, folder):
    return stats.request_details(request_rows(spark, folder))


@query("""SELECT event_type, count(*) AS total_requests, sum(event_id % 100)::BIGINT AS total_tokens, round(count(*) FILTER (user_id % 2 = 0) * 100.0::DOUBLE / count(*), 2) AS cache_hit_rate_percent,
  round(avg(value) * 1000.0::DOUBLE, 2) AS avg_response_time_ms, round(sum(event_id % 100) * 0.00013::DOUBLE / 1000.0::DOUBLE, 9) AS estimated_cost_usd FROM events GROUP BY event_type""")
def usage_stats(spark, folder):
    calls = table(spark, folder, "events").select("event_type", (F.col("event_id") % 100).alias("tokens"), (F.col("user_id") % 2 == 0).alias("cached"), F.col("value").alias("seconds"))
    return stats.usage_stats(calls, keys=["event_type"]).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 9))


@query("""SELECT event_type AS kind, count(*) AS entries, sum(user_id)::BIGINT AS total_hits, round(count(*) * 100.0::DOUBLE / 50000, 2) AS usage_percent FROM events GROUP BY event_type""")
def memo_totals(spark, folder):
    return stats.memo_stats(table(spark, folder, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("hits")), 50_000)


@query("""SELECT event_type AS query, count(*) AS runs, round(avg(value), 6) AS avg_seconds, min(value) AS min_seconds, max(value) AS max_seconds, round(avg((user_id % 5 > 0)::INT), 6) AS success_rate FROM events GROUP BY event_type""")
def run_summary(spark, folder):
    runs = table(spark, folder, "events").select(F.col("event_type").alias("query"), F.col("value").alias("seconds"), (F.col("user_id") % 5 > 0).alias("success"))
    return stats.run_summary(runs).withColumns({c: F.round(c, 6) for c in ("avg_seconds", "success_rate")})


@query("""SELECT vec_id, array_to_string(list_transform(embedding, lambda x: round(x, 3)::VARCHAR), ',') IS NOT NULL AS has_list, '{"label":' || label || ',"vec_id":' || vec_id || '}' AS meta, label::BIGINT AS label FROM embeddings""")
def sanitised_metadata(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("has_list"), F.struct("label", "vec_id").alias("meta"), "label")
    return index.sanitise_metadata(e).withColumn("has_list", F.array_join("has_list", ",").isNotNull())


# --- tables on storage and streams ------------------------------------------------------------

def scratch(spark) -> str:
    """A new folder below the cluster's checkpoint folder; a local one only in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix="docquarry-")
    return f"{base.rstrip('/')}/docquarry-{spark.sql('SELECT uuid()').first()[0]}"


@query(f"""WITH {CHUNKS_SQL} SELECT namespace, count(*) AS chunks, sum(len({sql_words('text')}))::BIGINT AS words FROM chunk WHERE namespace <> 'de' GROUP BY namespace""")
def stored_chunks(spark, folder):
    """Write the chunk view, upsert half of it again, delete one namespace, replace another, read back."""
    path = scratch(spark) + "/chunks"
    rows = chunk_view(spark, folder).withColumn("version", F.lit(1))
    index.upsert(rows, path)
    index.upsert(rows.filter("chunk_index < 5").withColumn("version", F.lit(2)), path)
    index.delete_namespaces(spark, path, F.col("namespace") == "de")
    index.replace_namespaces(rows.filter("namespace = 'fr'"), path)
    return index.read_table(spark, path).groupBy("namespace").agg(F.count(F.lit(1)).alias("chunks"), F.sum(word_count(F.col("text"))).alias("words"))


@query("SELECT lang AS namespace, count(*) AS documents FROM (SELECT lang, md5(text) AS t FROM documents GROUP BY ALL) GROUP BY lang")
def stream_distinct(spark, folder):
    """Each distinct text once through the stream, as ingest does per namespace."""
    base = scratch(spark)
    docs = spark.readStream.schema(table(spark, folder, "documents").schema).parquet(f"{folder}/documents.parquet*")
    once = jobs.first_per_namespace(docs.withColumn("namespace", F.md5("text")))

    def write(batch, batch_id):
        batch.select("namespace", "lang").write.mode("append").parquet(f"{base}/out")

    once.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy(F.col("lang").alias("namespace")).agg(F.count(F.lit(1)).alias("documents"))


@query()
def stream_ingest(spark, folder):
    """Streaming ingest of every document; each namespace is a distinct text."""
    base = scratch(spark)
    docs = spark.readStream.schema(table(spark, folder, "documents").schema).parquet(f"{folder}/documents.parquet*")
    docs = docs.withColumn("namespace", F.md5("text"))
    jobs.ingest_stream(docs, f"{base}/chunks", f"{base}/state", separator="\n", min_paragraph=0).awaitTermination()
    rows = spark.read.parquet(f"{base}/chunks")
    return rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS requests, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL""")
def stream_metrics(spark, folder):
    """Hourly request metrics; one file is one batch, so no row is late."""
    base = scratch(spark)
    events = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parquet*")
    rolled = jobs.request_metrics(events, delay=None)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{base}/out")

    rolled.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("avg_value", F.round("avg_value", 6))
