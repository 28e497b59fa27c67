"""Training pairs: sources, contrastive pairs, validation, embedding evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions.vectors import cosine

PAIRS = ("question STRING, positive STRING, negatives ARRAY<STRING>, category STRING, source STRING, "
         "confidence DOUBLE")


def training_pairs(examples: DataFrame, source: str = "predefined") -> DataFrame:
    """Labelled examples (question, positive, negatives, category, confidence) as pairs."""
    return examples.select("question", "positive", "negatives", "category", F.lit(source).alias("source"),
                           F.col("confidence").cast("double").alias("confidence"))


def contrastive_pairs(pairs: DataFrame) -> DataFrame:
    """question with its positive at 1.0 and with each negative at 0.0."""
    positive = pairs.select("question", F.col("positive").alias("context"), F.lit(1.0).alias("similarity"))
    negative = pairs.select("question", F.explode("negatives").alias("context"), F.lit(0.0).alias("similarity"))
    return positive.unionByName(negative)


def validate(pairs: DataFrame, min_pairs: int = 10, min_confidence: float = 0.8) -> DataFrame:
    """Per category and, with a NULL category, overall: pairs, share, mean confidence, validity."""
    grouped = pairs.rollup("category").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("confidence").alias("avg_confidence"), F.grouping("category").alias("_all"))
    total = F.max(F.when(F.col("_all") == 1, F.col("pairs"))).over(Window.partitionBy())
    overall = (F.col("_all") == 1) & (F.col("pairs") >= min_pairs) & (F.round("avg_confidence", 9) >= min_confidence)
    return grouped.withColumn("share", F.col("pairs") / total).select(
        "category", "pairs", "share", "avg_confidence", F.when(F.col("_all") == 1, overall).alias("is_valid"))


def evaluate(pairs: DataFrame, keys=(), question: str = "question_vector", positive: str = "positive_vector", threshold: float = 0.5) -> DataFrame:
    """Mean cosine of question and positive, and the share above the threshold."""
    scored = pairs.withColumn("_sim", cosine(F.col(question), F.col(positive)))
    hit = F.col("_sim") > threshold
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_pairs"), F.count_if(hit).alias("correct_predictions"),
        F.avg(hit.cast("int")).alias("accuracy"), F.avg("_sim").alias("avg_similarity"))


def compare(pairs: DataFrame, model: str = "model", base: str = "base", tuned: str = "tuned", keys=()) -> DataFrame:
    """Evaluation of two models side by side and the improvement; one pass over both."""
    scores = evaluate(pairs.filter(F.col(model).isin(base, tuned)), [*keys, model])
    pick = lambda name, c: F.max(F.when(F.col(model) == name, F.col(c)))
    return scores.groupBy(*keys).agg(
        pick(base, "accuracy").alias("base_accuracy"), pick(tuned, "accuracy").alias("tuned_accuracy"),
        pick(base, "avg_similarity").alias("base_similarity"), pick(tuned, "avg_similarity").alias("tuned_similarity"),
    ).withColumn("accuracy_improvement", F.col("tuned_accuracy") - F.col("base_accuracy")).withColumn(
        "similarity_improvement", F.col("tuned_similarity") - F.col("base_similarity"))
