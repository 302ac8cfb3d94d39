"""Fusion of detection score, evidence and review into one verdict with a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import THRESHOLD

ALONE_SUGGESTIVE = 0.7
#: Of a confirmed run that states no confidence.
UNSTATED = 0.9


def fused_verdict(hybrid: Column, total: Column, confirmed: Column, suggestive: Column, review: Column) -> Column:
    """``review`` is the triage verdict, empty or null without one."""
    return (
        F.when(confirmed > 0, "CONFIRMED")
        .when(suggestive > 0, F.when(review == "false_positive", "NEUTRAL").otherwise("SUGGESTIVE"))
        .when(review == "true_positive", "SUGGESTIVE")
        .when(review == "false_positive", "SAFE")
        .when((total == 0) & (hybrid > ALONE_SUGGESTIVE), "SUGGESTIVE")
        .otherwise("NEUTRAL")
    )


def fused_confidence(hybrid: Column, total: Column, confirmed: Column, suggestive: Column, max_confidence: Column, review: Column, review_confidence: Column) -> Column:
    direct = F.least(F.lit(0.99), 0.5 * hybrid + 0.5 * F.coalesce(max_confidence, F.lit(UNSTATED)))
    hinted = 0.9 * hybrid
    yes, no = review == "true_positive", review == "false_positive"
    return (
        F.when((confirmed > 0) & yes, F.least(F.lit(0.99), 0.5 * direct + 0.5 * review_confidence))
        .when(confirmed > 0, direct)
        .when((total == 0) & (F.coalesce(review, F.lit("")) == ""), hybrid)
        .when((suggestive > 0) & yes, F.least(F.lit(0.99), 0.6 * hinted + 0.4 * review_confidence))
        .when((suggestive > 0) & no, 0.6 * hinted)
        .when(suggestive > 0, hinted)
        .when(yes, 0.5 * hybrid + 0.5 * review_confidence)
        .when(no, F.greatest(F.lit(0.5), 1 - review_confidence))
        .otherwise(0.7 * hybrid)
    )


def fuse(predictions: DataFrame, evidence_rollup: DataFrame, triage: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """sample_id, verdict, confidence and what they rest on; below the threshold a sample is SAFE, whatever else is known.

    ``predictions``: sample_id, hybrid_score. Samples without evidence or review keep their row.
    """
    r = triage.select("sample_id", F.col("verdict").alias("triage_verdict"), F.col("confidence").alias("triage_confidence"))
    # evidence and review are looked at only where the score asks for it
    asked = predictions.filter(F.col("hybrid_score") >= threshold)
    met = asked.join(evidence_rollup, "sample_id", "left").join(r, "sample_id", "left")
    met = met.fillna(0, ["confirmed", "suggestive", "total"])
    args = [F.col(c) for c in ("hybrid_score", "total", "confirmed", "suggestive")]
    high = met.select(
        "sample_id", "hybrid_score", fused_verdict(*args, F.col("triage_verdict")).alias("verdict"),
        fused_confidence(*args, F.col("max_confidence"), F.col("triage_verdict"), F.col("triage_confidence")).alias("confidence"),
        F.col("total").alias("exploits_tried"), F.col("confirmed").alias("exploits_confirmed"),
    )
    low = predictions.filter(~(F.col("hybrid_score") >= threshold)).select(
        "sample_id", "hybrid_score", F.lit("SAFE").alias("verdict"), (1 - F.col("hybrid_score")).alias("confidence"),
        F.lit(0).cast("long").alias("exploits_tried"), F.lit(0).cast("long").alias("exploits_confirmed"),
    )
    return high.unionByName(low)


def dry_run(harnesses: DataFrame) -> DataFrame:
    """Literal stand-ins for evidence and review where nothing is executed."""
    return harnesses.withColumns({
        "evidence_level": F.lit("NEUTRAL"), "reason": F.lit("dry run"), "confidence": F.lit(0.0),
        "triage_verdict": F.lit("uncertain"), "triage_confidence": F.lit(0.5),
    })
