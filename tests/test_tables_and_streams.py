import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from docquarry.functions import ids, replies, text as tx
from docquarry.operators import curate, memo, stats
from docquarry.plans import ingest as ing
from docquarry.slots import count_tokens, embed, hashed_embedding
from docquarry.sources import documents, index
from docquarry.streaming import jobs


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_index_upsert_delete_replace(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "namespace string, chunk_id string, text string, version int")
    index.upsert(make([("a", "1", "old", 1), ("a", "2", "x", 1), ("test-b", "3", "y", 1)]), path)
    index.upsert(make([("a", "1", "new", 2), ("c", "4", "z", 1)]), path)
    read = lambda: sorted((r.namespace, r.chunk_id, r.text) for r in index.read_table(spark, path).collect())
    assert read() == [("a", "1", "new"), ("a", "2", "x"), ("c", "4", "z"), ("test-b", "3", "y")]
    index.delete_namespaces(spark, path, index.matches_pattern(F.col("namespace")))
    assert [r[0] for r in read()] == ["a", "a", "c"]
    index.replace_namespaces(make([("a", "9", "only", 1)]), path)
    assert read() == [("a", "9", "only"), ("c", "4", "z")]
    pruned = index.read_table(spark, path, ["a"])
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 1 and re.search(r"PartitionFilters: \[[^\]]*ns_bucket", plan), plan


def stored_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_an_upsert_of_one_row_writes_little_and_compaction_changes_nothing(spark, tmp_path):
    path = tmp_path / "chunks"
    rows = spark.range(30_000).select(F.concat(F.lit("n"), F.col("id") % 20).alias("namespace"), F.col("id").cast("string").alias("chunk_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(1).alias("version"))
    index.upsert(rows, str(path))
    whole = stored_bytes(path)
    index.upsert(rows.filter("id = 7").withColumn("text", F.lit("new")), str(path))
    assert stored_bytes(path) - whole < 10_000 < whole / 100
    index.upsert(spark.createDataFrame([("n8", "8", "older", 0), ("n7", "x", "added", 1)], "namespace string, chunk_id string, text string, version int"), str(path))
    index.delete_namespaces(spark, str(path), F.col("namespace") == "n3")
    index.upsert(spark.createDataFrame([("n3", "back", "again", 1)], "namespace string, chunk_id string, text string, version int"), str(path))
    read = lambda: {r.chunk_id: (r.namespace, r.text) for r in index.read_table(spark, str(path)).collect()}
    before = read()
    assert len(before) == 30_000 - 1500 + 2 and before["7"] == ("n7", "new") and before["8"][1] != "older" and before["back"] == ("n3", "again") and "3" not in before
    unused = index.compact(spark, str(path))
    assert read() == before and len(index.live_layers(spark, str(path))) == 1 and len(unused) == 5
    assert index.compact(spark, str(path)) == []
    plan = index.read_table(spark, str(path))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_reading_merges_layers_by_keys_and_versions_alone(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "namespace string, chunk_id string, text string, version int"
    layers = [
        [("a", "1", "a1 v5", 5), ("a", "2", "a2 v1", 1), ("a", "3", "a3", None), ("b", "4", "b4 v1", 1), ("b", None, "old null", 1), (None, "5", "old null", 1)],
        [("a", "1", "a1 v2", 2), ("a", "2", "a2 v3", 3), ("a", "3", "a3 later", None), ("b", None, "null", 2), (None, "5", "null", 4)],
        [("a", "2", "a2 v2", 2), ("b", "4", "b4 v1 later", 1), ("b", None, "null", 1), (None, "5", "null later", 4), ("c", "6", "c6", 1)]]
    for rows in layers:
        index.upsert(spark.createDataFrame(rows, schema), path)
    read = index.read_table(spark, path)
    assert sorted(r.text for r in read.collect()) == sorted(["a1 v5", "a2 v3", "a3 later", "b4 v1 later", "old null", "old null", "null", "null later", "c6"])
    plan = read.select("namespace")._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk_id" in plan and "text#" not in "".join(line for line in plan.splitlines() if "Relation" not in line)
    index.upsert(spark.createDataFrame([("a", "1", "no version"), ("a", "7", "no version")], "namespace string, chunk_id string, text string"), path)
    assert {r.chunk_id: r.text for r in index.read_table(spark, path, ["a"]).collect()} == {"1": "a1 v5", "2": "a2 v3", "3": "a3 later", "7": "no version"}


def test_a_commit_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "namespace string, chunk_id string, text string, version int")
    index.upsert(make([("a", "1", "x", 1), ("b", "2", "y", 1)]), path)
    read = lambda: sorted((r.namespace, r.chunk_id, r.text) for r in index.read_table(spark, path).collect())
    before, commit = read(), index._commit

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(index, "_commit", dies)
    for step in (lambda: index.upsert(make([("a", "1", "z", 2)]), path), lambda: index.replace_namespaces(make([("a", "9", "z", 2)]), path), lambda: index.delete_namespaces(spark, path, F.lit(True)), lambda: index.compact(spark, path) or dies()):
        with pytest.raises(RuntimeError):
            step()
        assert read() == before
    monkeypatch.setattr(index, "_commit", commit)
    index.upsert(make([("a", "1", "z", 2)]), path)
    assert read() == [("a", "1", "z"), ("b", "2", "y")]


def test_commits_beside_a_compaction_survive(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    make = lambda rows: spark.createDataFrame(rows, "namespace string, chunk_id string, text string, version int")
    for text in ("one", "two"):
        index.upsert(make([("a", "1", text, 1)]), path)
    write = index._write

    def slow(*args):
        monkeypatch.setattr(index, "_write", write)
        index.upsert(make([("a", "1", "meanwhile", 1)]), path)
        write(*args)

    monkeypatch.setattr(index, "_write", slow)
    index.compact(spark, path)
    assert [r.text for r in index.read_table(spark, path).collect()] == ["meanwhile"]


def test_vectors_skip_processed_namespaces(spark, tmp_path):
    path = str(tmp_path / "v")
    make = lambda rows: spark.createDataFrame(rows, "namespace string, chunk_id string, embedding array<float>")
    index.append_vectors(make([("a", "1", [1.0])]), path)
    index.append_vectors(make([("a", "2", [1.0]), ("b", "3", [1.0])]), path)
    assert sorted(r.chunk_id for r in index.read_table(spark, path).collect()) == ["1", "3"]
    with pytest.raises(ValueError):
        index.append_vectors(make([(" ", "4", [1.0])]), path)


def test_memo_uses_latest_fresh_entry(spark):
    now = dt.datetime(2024, 1, 1, 12)
    rows = [("k1", "old", now - dt.timedelta(seconds=50), 100), ("k1", "new", now - dt.timedelta(seconds=10), 100), ("k2", "stale", now - dt.timedelta(seconds=500), 100)]
    m = spark.createDataFrame(rows, "key string, payload string, created_at timestamp, ttl_seconds int")
    items = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k2", "b")], "key string, text string")
    out = memo.compute_with_memo(items, m, F.lit(now), lambda d: d.select("key", F.upper("text").alias("payload")))
    assert sorted((r.key, r.payload) for r in out.collect()) == [("k1", "new"), ("k2", "B"), ("k2", "B")]


def test_stream_ingest_equals_batch(spark, tmp_path):
    rows = [(i, f"src{i % 3}", f"1. HEADING\nbody number {i % 3} with enough words, truly.") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withColumn("namespace", F.col("source"))
    for _ in range(2):  # the second run finds every namespace processed
        jobs.ingest_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = ing.chunks(ing.prepare(df.dropDuplicates(["source"]), namespace=F.col("source")))
    key = lambda d: sorted((r.namespace, r.text) for r in d.collect())
    assert key(got) == key(batch) and len(key(got)) == 3


def test_request_metrics_drop_late_rows(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    schema = "ts timestamp, event_type string, value double"
    first = [(base + dt.timedelta(hours=5), "a", 1.0)]
    late = [(base, "a", 9.0), (base + dt.timedelta(hours=9), "a", 2.0), (base + dt.timedelta(hours=20), "b", 3.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(str(tmp_path / "e/1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e/*"))
    run = lambda: jobs.request_metrics(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "s")).format("parquet").option(
        "path", str(tmp_path / "o")).trigger(availableNow=True).start().awaitTermination()
    run()
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(str(tmp_path / "e/2"))
    run()
    got = {(r.window_start.hour, r.event_type): (r.requests, r.avg_value) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got[(5, "a")] == (1, 1.0) and (0, "a") not in got


def test_replies_and_flattening(spark):
    p = lambda s: one(spark, *[c.alias(n) for n, c in replies.parse_reply(F.lit(s)).items()])
    good = p('{"answer": "yes", "confidence": 0.7, "sources": ["a"]}')
    assert (good.answer, good.confidence, good.sources, good.error) == ("yes", 0.7, ["a"], False)
    bad = p("plain")
    assert (bad.answer, bad.confidence, bad.error) == ("plain", 0.0, True)
    flat = lambda s: one(spark, replies.flatten_answer(F.lit(s)))[0]
    assert flat('{"coverage": "c"}') == "c" and flat('{"NCD": {"description": "d"}}') == "d" and flat("raw") == "raw"
    assert flat('{"x": "1", "y": {"z": "2"}}') == "1 2"


def test_text_and_ids(spark):
    r = one(spark, tx.clean_text(F.lit("  a\n\nb....c ‘q’ ----- ")), tx.sentence_count(F.lit("One. Two! three")), ids.normalised_url(F.lit("HTTPS://u@h.com:80/a/b?x=1#f")),
            ids.sanitise_namespace(F.lit("--a__b  c!" + "z" * 60)), tx.optimise_query(F.lit("a!b  c?")), tx.emphasise(F.lit("Claim on premiums"), "policy_text"), tx.policy_id(F.lit("policy no. : AB12345678X")))
    assert r[0] == "a b...c 'q' ---" and r[1] == 3 and r[2] == "https://u@h.com:80/a/b" and len(r[3]) == 40 and r[3].startswith("a-b-c-z")
    assert r[4] == "a b c" and r[5] == "claim claim on premiums" and r[6] == "AB12345678X"


def test_pairs_round_trip_and_validation(spark, tmp_path):
    rows = [(f"q{i}", "p", ["n1", "n2"] if i else [], "c%d" % (i % 2), 0.9) for i in range(10)]
    pairs = curate.training_pairs(spark.createDataFrame(rows, "question string, positive string, negatives array<string>, category string, confidence double"))
    index.save_pairs(pairs, str(tmp_path / "p"))
    again = index.load_pairs(spark, str(tmp_path / "p"))
    assert again.exceptAll(pairs).count() == 0 and curate.contrastive_pairs(again).count() == 28
    total = curate.validate(again).filter("category is null").first()
    assert total.pairs == 10 and total.is_valid and total.share == 1.0


def test_slots_and_sources(spark, tmp_path):
    df = spark.createDataFrame([("two words",), (" ",), (None,)], "text string")
    assert [r.embedding for r in embed(df, lambda s: [[float(len(x))] for x in s]).collect()] == [[9.0], None, None]
    assert [r.tokens for r in count_tokens(df, lambda s: [len(x) for x in s]).collect()] == [9, 1, 0]
    v = hashed_embedding(df, dim=8).collect()
    assert abs(sum(x * x for x in v[0].embedding) - 1) < 1e-6 and v[1].embedding is None
    (tmp_path / "a.txt").write_text("line 1\nline 2")
    d = documents.read_documents(spark, str(tmp_path / "a.txt"), "text").first()
    assert d.text == "line 1\nline 2" and d.source.endswith("a.txt")


def test_table_statistics(spark):
    c = spark.createDataFrame([("n", "t1", "s1", True), ("n", "t2", "s1", False)], "namespace string, chunk_type string, section_type string, flag boolean")
    got = {(r.dimension, r.value): r.chunks for r in stats.chunk_counts(c).collect()}
    assert got == {("total", None): 2, ("chunk_type", "t1"): 1, ("chunk_type", "t2"): 1, ("section_type", "s1"): 2}
