"""Hybrid scores, thresholds and the search for the mixing weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import BETA, BETAS, PREDICT_ABOVE, THRESHOLD


def hybrid(cls_prob: Column, neighbour_score: Column, beta: float | Column = BETA) -> Column:
    """``beta * p + (1 - beta) * s``; without a neighbour score (no index) the classifier alone."""
    b = F.lit(beta) if not isinstance(beta, Column) else beta
    return F.when(neighbour_score.isNull(), cls_prob).otherwise(b * cls_prob + (1 - b) * neighbour_score)


def predicted(score: Column, above: float = PREDICT_ABOVE) -> Column:
    """1 strictly above; a score equal to the bound is 0, unlike ``below_threshold``, where it passes."""
    return F.when(score > above, 1).otherwise(0)


def below_threshold(score: Column, threshold: float = THRESHOLD) -> Column:
    return score < threshold


def beta_grid(scored: DataFrame, betas: Sequence[float] = BETAS) -> DataFrame:
    """beta, accuracy: every weight tried over one pass of (cls_prob, faiss_score, label)."""
    hits = [
        F.avg((predicted(hybrid(F.col("cls_prob"), F.col("faiss_score"), b)) == F.col("label")).cast("int")).alias(f"a{i}")
        for i, b in enumerate(betas)
    ]
    row = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.col(f"a{i}").alias("accuracy")) for i, b in enumerate(betas)])).alias("g")
    return scored.agg(*hits).select(row).select("g.*")


def best_beta(grid: DataFrame) -> DataFrame:
    """The weight of highest accuracy, the smallest of equals."""
    return grid.agg(F.max_by("beta", F.struct("accuracy", -F.col("beta"))).alias("beta"), F.max("accuracy").alias("accuracy"))


def accuracy_summary(scored: DataFrame) -> DataFrame:
    """Accuracy of the classifier alone and of the hybrid score."""
    def share(score: Column) -> Column:
        return F.avg((predicted(score) == F.col("label")).cast("int"))

    return scored.agg(share(F.col("cls_prob")).alias("cls_accuracy"), share(F.col("hybrid_score")).alias("hybrid_accuracy"))
