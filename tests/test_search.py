import math
import random

from pyspark.sql import functions as F

from docquarry.operators import intent as it
from docquarry.operators import search as se
from docquarry.operators import vectors as vec
from docquarry.plans.answer import NOT_FOUND, answer
from docquarry.plans.hybrid import block_filter, hybrid_search
from docquarry.slots import hashed_embedding


def vectors_fixture(spark, n=600, dim=8, seed=1):
    """A hot namespace with most rows, duplicates for ties and a zero vector."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        v = [float(rng.randint(-3, 3)) for _ in range(dim)]
        out.append((f"c{i:04d}", "hot" if i % 10 else "cold", [0.0] * dim if i == 7 else v, ["x", "y", None][i % 3]))
    return out, spark.createDataFrame(out, "chunk_id string, namespace string, embedding array<float>, chunk_type string").repartition(7)


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0


def expected(queries, vectors, k, keep=lambda q, v: True):
    out = {}
    for q in queries:
        scored = [(-cosine(q[2], v[2]), v[0]) for v in vectors if v[1] == q[1] and keep(q, v)]
        out[q[0]] = [c for _, c in sorted(scored)[:k]]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank_position").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


def queries_fixture(spark, n=20, dim=8):
    rng = random.Random(2)
    rows = [(f"q{i}", ["hot", "cold"][i % 2], [float(rng.randint(-3, 3)) or 1.0 for _ in range(dim)], ["x", None][i % 2]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "query_id string, namespace string, vector array<double>, filter_chunk_type string")


def test_vector_top_k_equals_brute_force_broadcast_shuffled_and_salted(spark):
    v, vd = vectors_fixture(spark)
    q, qd = queries_fixture(spark)
    want = expected(q, v, 15)
    assert collect(vec.vector_top_k(qd, vd, 15)) == want
    assert collect(vec.vector_top_k(qd, vd, 15, broadcast_rows=0, salts=4)) == want


def test_filter_applies_before_ranking(spark):
    v, vd = vectors_fixture(spark)
    q, qd = queries_fixture(spark)
    got = collect(vec.vector_top_k(qd, vd, 5, query_scope=["namespace", "filter_chunk_type"], vector_scope=["namespace", "chunk_type"], match=block_filter(["chunk_type"])))
    assert got == expected(q, v, 5, lambda a, b: a[3] is None or b[3] == a[3])


def test_cells_are_exact_with_all_probes(spark):
    v, vd = vectors_fixture(spark)
    q, qd = queries_fixture(spark)
    cells = vec.fit_centroids(vd, 4, iterations=3)
    assert collect(vec.cell_top_k(qd, vd, cells, 6, probes=4)) == expected(q, v, 6)
    some = collect(vec.cell_top_k(qd, vd, cells, 6, probes=1))
    assert set(some) <= {r[0] for r in q}


def test_small_blocks_and_running_floor(spark):
    best = vec.BestOf()
    best.COMPACT_AT = 10
    import numpy as np

    rng = np.random.default_rng(0)
    codes = best.code([("a",), ("b",)], [3, 2])
    seen = {0: [], 1: []}
    for block in range(30):
        scores = np.round(rng.random((2, 5)), 1)
        ids = np.array([f"{block:02d}{i}" for i in range(5)])
        for c in (0, 1):
            seen[c] += [(-s, i) for s, i in zip(scores[c], ids)]
        best.add(codes, scores, ids, 3)
    best.compact()
    c, s, i = best.parts[0]
    for code, k in ((0, 3), (1, 2)):
        assert [(-x, y) for x, y in zip(s[c == code], i[c == code])] == sorted(seen[code])[:k]


def test_top_k_plan_prunes_before_the_shuffle(spark):
    _, vd = vectors_fixture(spark)
    _, qd = queries_fixture(spark)
    plan = vec.vector_top_k(qd, vd, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def chunk_rows(spark, n=300):
    rng = random.Random(4)
    words = ["policy", "claim", "15%", "zone a", "bed", "Hospital", "fee", "x_y"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(3))
        rows.append(("hot" if i % 5 else "cold", f"k{i:03d}", i % 7, text, rng.choice([0.0, 0.5, 1.0]), rng.choice(["a", "b", None]), "HDFC Ergo" if i % 2 else None))
    df = spark.createDataFrame(rows, "namespace string, chunk_id string, chunk_index int, text string, confidence_score double, section_type string, company_name string")
    for c in ("policy_uin", "policy_type", "chunk_type", "file_name", "section_header"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return rows, df.withColumn("keywords", F.array().cast("array<string>"))


def test_keyword_top_k_equals_brute_force(spark):
    rows, chunks = chunk_rows(spark)
    asked = [("q1", "hot", ["CLAIM", "bed"], "a", "ergo"), ("q2", "hot", ["15%"], None, None), ("q3", "cold", ["x_y", "zone"], "b", None), ("q4", "cold", ["absent"], None, None)]
    q = spark.createDataFrame(asked, "query_id string, namespace string, terms array<string>, filter_section_type string, filter_company_name string")
    want = {}
    for qid, ns, terms, section, company in asked:
        hit = [r for r in rows if r[0] == ns and any(t.lower() in r[3].lower() for t in terms) and (section is None or r[5] == section) and (company is None or (r[6] and company in r[6].lower()))]
        if hit:
            want[qid] = [r[1] for r in sorted(hit, key=lambda r: (-r[4], r[2], r[1]))[:12]]
    assert collect(se.keyword_top_k(q, chunks, 12)) == want
    assert collect(se.keyword_top_k(q, chunks, 12, salts=3)) == want
    first = se.keyword_top_k(q, chunks, 12).filter("query_id = 'q2' and rank_position = 2").first()
    assert abs(first.score - 0.99) < 1e-12


def test_filters_fall_open_within_the_namespace(spark):
    _, chunks = chunk_rows(spark)
    q = spark.createDataFrame([("q1", "hot", "a"), ("q2", "hot", "zzz"), ("q3", "none", "a")], "query_id string, namespace string, user_section_type string")
    out = {r.query_id: r.filter_section_type for r in se.effective_filters(it.merge_filters(q), chunks).collect()}
    assert out == {"q1": "a", "q2": None, "q3": None}


def test_fusion_is_symmetric_and_scored(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id string, chunk_id string, score double, rank_position int")
    s = hits([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)])
    k = hits([("q", "b", 0.7, 1), ("q", "c", 0.6, 2)])
    out = {r.chunk_id: r for r in se.reciprocal_rank_fusion(s, k, 10).collect()}
    assert abs(out["b"].combined_score - (0.7 / 62 + 0.3 / 61)) < 1e-11 and out["b"].metadata_score == 0.0
    assert out["c"].metadata_score == 0.6 and out["c"].semantic_score == 0.0
    assert [out[x].rank_position for x in "bac"] == [1, 2, 3]


def test_intent_rules(spark):
    rows = [
        ("What is not covered in health plans", "exclusions", None, "Health Insurance", None, 0.6),
        ("Show table of benefits schedule sub-limit", "schedule", "table_markdown", None, None, 0.7),
        ("hdfc", None, None, None, "HDFC Ergo", 0.0),
    ]
    df = it.with_intent(spark.createDataFrame([(r[0],) for r in rows], "question string"))
    got = {r.question: (r.intent_section_type, r.intent_chunk_type, r.intent_policy_type, r.intent_company_name, r.intent_confidence) for r in df.collect()}
    for q, *want in rows:
        assert got[q] == tuple(want), q


def corpus(spark):
    rows, chunks = chunk_rows(spark, 60)
    return chunks, hashed_embedding(chunks, dim=16)


def test_hybrid_search_fallback_and_answers(spark):
    chunks, vectors = corpus(spark)
    embed = lambda df, text, out: hashed_embedding(df, text, out, 16)
    q = spark.createDataFrame([("1", "hot", "how to claim hospital bed"), ("2", "hot", "policy claim"), ("3", "nowhere", "policy claim")], "query_id string, namespace string, question string")
    out = hybrid_search(q, chunks, vectors, k=5, embedder=embed)
    ranks = {}
    for r in out.orderBy("query_id", "rank_position").collect():
        assert r.namespace == "hot"
        ranks.setdefault(r.query_id, []).append(r.rank_position)
    assert ranks == {"1": [1, 2, 3, 4, 5], "2": [1, 2, 3, 4, 5]}
    replies = {r.query_id: r for r in answer(q, chunks, vectors, embedder=embed).collect()}
    assert replies["3"].answer == NOT_FOUND and replies["3"].confidence == 0.0 and replies["3"].total_results == 0
    assert replies["1"].answer and replies["1"].confidence == min(1.0, replies["1"].best_match_score) and replies["1"].sources and not replies["1"].error


def test_user_callables(spark):
    chunks, vectors = corpus(spark)
    embed = lambda df, text, out: hashed_embedding(df, text, out, 16)
    q = spark.createDataFrame([("1", "hot", "policy claim")], "query_id string, namespace string, question string")
    out = hybrid_search(q, chunks, vectors, k=3, embedder=embed, scorer=lambda a, b: b.str.len().astype(float)).collect()
    assert all(r.model_score == len(r.text) for r in out)
    got = answer(q, chunks, vectors, embedder=embed, answerer=lambda prompts: ["not json" for _ in prompts]).first()
    assert got.answer == "not json" and got.error and got.confidence == 0.0
