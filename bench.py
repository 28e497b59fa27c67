"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from docquarry.catalog import all_queries  # noqa: E402
from docquarry.session import local_session  # noqa: E402

HEADLINE = [
    "vector_topk", "cell_topk", "semantic_topk", "keyword_topk", "rrf_fusion", "filtered_search", "multi_query_merge", "rerank_boost",
    "context_text", "ingest_chunks", "headers", "table_blocks", "greedy_chunks", "snap_window_chunks", "domain_score", "category_argmax",
    "text_stats", "key_phrase_top", "intent_rules", "pattern_expansion", "chunk_stats", "upsert_latest", "embedding_reuse",
    "contrastive_pairs", "embedding_eval", "hybrid_search_full", "answers", "stored_chunks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cores, cores)
    registered = all_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in registered]
    # One small query starts the Python workers and warms the session.
    registered["vector_topk"](spark, folder).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    questions = spark.read.parquet(f"{folder}/benchmark.parquet").count() * 4
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "questions": questions, "cpus": cores,
        "hybrid_sec_per_question": round(seconds["hybrid_search_full"] / questions, 4) if "hybrid_search_full" in seconds else None}))


if __name__ == "__main__":
    main()
