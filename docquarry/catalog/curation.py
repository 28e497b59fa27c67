"""Training pairs and embedding evaluation over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.catalog.views import table, tidy
from docquarry.operators import curate

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, folder: tidy(fn(spark, folder))
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def pairs(spark, folder):
    """Every document as an example: its first sentence asks, its longer lines are
    positives and negatives, the source is the category."""
    docs = table(spark, folder, "documents")
    lines = F.split("text", "\n")
    examples = docs.select(
        F.concat_ws(":", F.lit("What says"), F.col("doc_id").cast("string")).alias("question"), F.element_at(lines, 1).alias("positive"),
        F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("negatives"), F.col("source").alias("category"),
        F.when(F.col("lang") == "en", 0.95).otherwise(0.7).alias("confidence"))
    return curate.training_pairs(examples)


_PAIRS = """pairs AS (SELECT 'What says:' || doc_id AS question, string_split(text, chr(10))[1] AS positive, string_split(text, chr(10))[2:] AS negatives,
  source AS category, CASE WHEN lang = 'en' THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM documents)"""


@query(f"""WITH {_PAIRS} SELECT question, positive AS context, 1.0::DOUBLE AS similarity FROM pairs UNION ALL SELECT question, unnest(negatives), 0.0::DOUBLE FROM pairs""")
def contrastive_pairs(spark, folder):
    return curate.contrastive_pairs(pairs(spark, folder))


@query(f"""WITH {_PAIRS}, g AS (SELECT category, count(*) AS pairs, avg(confidence) AS a FROM pairs GROUP BY ROLLUP (category))
SELECT category, pairs, round(pairs / (SELECT count(*) FROM documents)::DOUBLE, 6) AS share, round(a, 6) AS avg_confidence,
  CASE WHEN category IS NULL THEN pairs >= 10 AND round(a, 9) >= 0.8 END AS is_valid FROM g""")
def pairs_validation(spark, folder):
    out = curate.validate(pairs(spark, folder))
    return out.withColumns({"share": F.round("share", 6), "avg_confidence": F.round("avg_confidence", 6)})


_HALF = """
e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
m AS (SELECT label, vec_id, v, list_transform(v, lambda x, i: CASE WHEN i % 2 = 0 THEN 0.0::DOUBLE ELSE x END) AS half FROM e),
c AS (SELECT label, list(x ORDER BY p) AS c FROM (SELECT label, p, avg(x) AS x FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM e) GROUP BY label, p) GROUP BY label)"""
_SIM = "coalesce(list_inner_product({a}, {b}) / nullif(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), 0), 0.0)"


def model_pairs(spark, folder):
    """Each vector with the centroid of its label, for the full vectors (base) and for
    their odd half (tuned)."""
    from docquarry.catalog.retrieval import centroids

    e = table(spark, folder, "embeddings").select(F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    half = F.transform("v", lambda x, i: F.when(i % 2 == 1, F.lit(0.0)).otherwise(x))
    models = F.explode(F.array(F.struct(F.lit("base").alias("model"), F.col("v").alias("question_vector")), F.struct(F.lit("tuned").alias("model"), half.alias("question_vector"))))
    return e.select("label", models.alias("m")).select("label", "m.*").join(centroids(spark, folder).withColumnRenamed("vector", "positive_vector"), "label")


@query(f"""WITH {_HALF}, s AS (SELECT m.label::VARCHAR AS label, {_SIM.format(a='m.v', b='c.c')} AS sim FROM m JOIN c USING (label))
SELECT label, count(*) AS total_pairs, count(*) FILTER (sim > 0.5) AS correct_predictions, round(avg((sim > 0.5)::INT), 6) AS accuracy, round(avg(sim), 6) AS avg_similarity FROM s GROUP BY label""")
def embedding_eval(spark, folder):
    out = curate.evaluate(model_pairs(spark, folder).filter("model = 'base'"), ["label"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "avg_similarity")})


@query(f"""WITH {_HALF}, s AS (SELECT m.label::VARCHAR AS label, {_SIM.format(a='m.v', b='c.c')} AS b, {_SIM.format(a='m.half', b='c.c')} AS t FROM m JOIN c USING (label))
SELECT label, round(avg((b > 0.5)::INT), 6) AS base_accuracy, round(avg((t > 0.5)::INT), 6) AS tuned_accuracy, round(avg(b), 6) AS base_similarity, round(avg(t), 6) AS tuned_similarity,
  round(avg((t > 0.5)::INT) - avg((b > 0.5)::INT), 6) AS accuracy_improvement, round(avg(t) - avg(b), 6) AS similarity_improvement FROM s GROUP BY label""")
def model_compare(spark, folder):
    out = curate.compare(model_pairs(spark, folder), keys=["label"])
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns if c != "label"])
