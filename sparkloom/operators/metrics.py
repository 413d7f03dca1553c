"""Retrieval metrics over rankings (question, id, rank) and gold (question, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRUCTURAL = ("STRUCT", "EXACT", "CROSS")


def per_question(questions: DataFrame, rankings: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """question, recall_at_k and precision_at_k for each k, reciprocal_rank; questions without a ranking get 0.

    Recall is whether any gold node is among the first k; precision divides by k whatever the ranking's length.
    """
    hits = rankings.join(gold.select("question", "id").distinct(), ["question", "id"], "left_semi")
    aggs = [F.min("rank").alias("first")] + [F.sum((F.col("rank") <= k).cast("bigint")).alias(f"h{k}") for k in ks]
    h = hits.groupBy("question").agg(*aggs)
    q = questions.select("question").distinct().join(h, "question", "left")
    cols = [F.when(F.coalesce(F.col(f"h{k}"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias(f"recall_at_{k}") for k in ks]
    cols += [(F.coalesce(F.col(f"h{k}"), F.lit(0)) / k).alias(f"precision_at_{k}") for k in ks]
    return q.select("question", *cols, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def means(scores: DataFrame, questions: DataFrame, places: int = 3) -> DataFrame:
    """One row: macro means; precision over the questions all of whose modes (joined by +) are structural."""
    pure = F.forall(F.split("mode", r"\+"), lambda m: m.isin(list(STRUCTURAL)))
    both = scores.join(questions.select("question", "mode"), "question")
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), places)
    return both.agg(
        r(F.avg("recall_at_5")).alias("recall_at_5"),
        r(F.avg("recall_at_10")).alias("recall_at_10"),
        r(F.avg(F.when(pure, F.col("precision_at_5")))).alias("precision_at_5"),
        r(F.avg("reciprocal_rank")).alias("mrr"),
    )


def per_mode(scores: DataFrame, questions: DataFrame, places: int = 3) -> DataFrame:
    """(mode, n, recall_at_10): a question counts in every mode that it lists."""
    modes = questions.select("question", F.explode(F.split("mode", r"\+")).alias("mode"))
    return modes.join(scores, "question").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall_at_10"), places).alias("recall_at_10"))


def edge_precision(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, precision, recall) of edges (src, dst) for each source of gold (src, dst)."""
    e, g = edges.select("src", "dst").distinct(), gold.select("src", "dst").distinct()
    found = e.join(g.select("src").distinct(), "src", "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("found"))
    right = e.join(g, ["src", "dst"], "left_semi").groupBy("src").agg(F.count(F.lit(1)).alias("right"))
    want = g.groupBy("src").agg(F.count(F.lit(1)).alias("want"))
    both = want.join(found, "src", "left").join(right, "src", "left")
    hit = F.coalesce("right", F.lit(0))
    return both.select("src", F.when(F.col("found") > 0, hit / F.col("found")).otherwise(0.0).alias("precision"), (hit / F.col("want")).alias("recall"))


def answered(answers: DataFrame) -> DataFrame:
    """(task, success): whether any gold name stands in the answer (task, answer, gold array) between what is no
    letter, digit, dot or underscore."""
    whole = F.exists("gold", lambda g: F.regexp_like(F.col("answer"), F.concat(F.lit(r"(?<![\w.])\Q"), g, F.lit(r"\E(?![\w])"))))
    return answers.select("task", F.coalesce(whole, F.lit(False)).alias("success"))
