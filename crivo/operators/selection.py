"""Choosing a configuration on dev results, and comparing models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from crivo.operators.metrics import binary_metrics, ranking_metrics


def grid_winner(grid: DataFrame) -> DataFrame:
    """Best feature count per ratio (highest dev F1, fewer features on a tie), then the best ratio of those.

    The grid has one row per setting; ties between ratios go to the first name.
    """
    per_ratio = Window.partitionBy("ratio").orderBy(F.desc("dev_f1"), "max_features")
    best = grid.withColumn("_r", F.row_number().over(per_ratio)).where("_r = 1").drop("_r")
    overall = Window.partitionBy(F.lit(0)).orderBy(F.desc("dev_f1"), "ratio")  # one row per ratio
    return best.withColumn("winner", (F.row_number().over(overall) == 1).cast("int"))


def best_config(preds: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Dev average precision per configuration and the winner; the first in `order` (or by name) wins a tie."""
    m = ranking_metrics(preds, ["config"])
    rank = F.lit(len(order))
    for i, name in enumerate(order):
        rank = F.when(F.col("config") == name, i).otherwise(rank)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("ap"), rank, "config")  # one row per configuration
    return m.withColumn("winner", (F.row_number().over(w) == 1).cast("int"))


def learning_curve(log: DataFrame) -> DataFrame:
    """Evaluation entries of a training log by epoch, the best one marked; the earlier epoch wins a tie."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("eval_f1"), "epoch")  # one row per epoch
    evals = log.where(F.col("eval_f1").isNotNull()).select("epoch", "eval_loss", "eval_f1")
    return evals.withColumn("best", (F.row_number().over(w) == 1).cast("int"))


def loss_history(log: DataFrame) -> DataFrame:
    return log.where(F.col("loss").isNotNull()).select("position", "epoch", "loss")


def prediction_join(preds: DataFrame, corpus: DataFrame, key: str = "url", check: bool = False) -> DataFrame:
    """Predictions with the corpus attributes, aligned by key. `check` raises when a prediction finds no row."""
    attrs = corpus.select(key, F.col("source").alias("source"), F.col("split").alias("split"))
    out = preds.join(attrs, key)
    if check:
        lost = preds.join(attrs, key, "left_anti").count()
        if lost:
            raise ValueError(f"{lost} predictions have no row in the corpus")
    return out


def prediction_coverage(preds: DataFrame, corpus: DataFrame, key: str = "url") -> DataFrame:
    """One row: predictions, corpus rows, matched rows."""
    a = preds.select(key, F.lit(1).alias("_a"))
    b = corpus.select(key, F.lit(1).alias("_b"))
    return a.join(b, key, "full").agg(
        F.count("_a").alias("predictions"), F.count("_b").alias("rows"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("matched")
    )


def model_comparison(preds: DataFrame, threshold: float = 0.0, base: str = "dev") -> DataFrame:
    """Model x evaluation set: AP, F1, precision, recall, and the difference to the base set of the same model."""
    keys = ["model", "eval_set"]
    m = binary_metrics(preds, threshold, keys).join(ranking_metrics(preds, keys), keys)
    w = Window.partitionBy("model")  # one row per evaluation set

    def against(c: str):
        return F.bround(F.col(c) - F.max(F.when(F.col("eval_set") == base, F.col(c))).over(w), 6).alias(f"delta_{c}")

    return m.select(*keys, "ap", "f1", "precision", "recall", against("ap"), against("f1"))
