"""Evaluation: confusion counts, rates, ROC-AUC, losses, times and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import inner
from ..plans.lineage import cut

TINY = 1e-10


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def confusion(predictions: DataFrame, predicted: str = "prediction", actual: str = "label") -> DataFrame:
    p, a = F.col(predicted) == 1, F.col(actual) == 1
    return predictions.agg(
        F.count_if(p & a).alias("tp"), F.count_if(~p & ~a).alias("tn"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn")
    )


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall, f1 from tp, tn, fp, fn; every empty denominator gives 0."""
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    out = counts.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall")
    )
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def fp_reduction(predictions: DataFrame, before: str, after: str, actual: str = "label") -> DataFrame:
    """False positives of two verdict columns, the reduction, and the share of tries that were exploited."""
    wrong = F.col(actual) != 1
    out = predictions.agg(F.count_if((F.col(before) == 1) & wrong).alias("fp_before"), F.count_if((F.col(after) == 1) & wrong).alias("fp_after"))
    return out.withColumn("fp_reduction", ratio(F.col("fp_before") - F.col("fp_after"), F.col("fp_before")))


def exploitation_rate(tries: DataFrame, tried: str, confirmed: str) -> DataFrame:
    return tries.agg(ratio(F.sum(confirmed), F.sum(tried)).alias("exploitation_rate"))


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Area under the ROC curve by midranks of the distinct scores; 0 when one class is missing.

    Equal scores meet in one row first. The running count over distinct scores is split by score range, so no task
    holds more than its range: a range's offset comes from the totals of the ranges below it. The ranges are written
    down, because two samplings need not draw the same ones.
    """
    tied = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    parts = cut(tied.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "score-ranges")
    totals = parts.groupBy("part").agg(F.sum("neg").alias("below"))  # one row a range
    ranges_below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("part", F.coalesce(F.sum("below").over(ranges_below), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.join(F.broadcast(earlier), "part").withColumn("under", F.col("offset") + F.coalesce(F.sum("neg").over(within), F.lit(0)))
    wins = placed.agg(
        F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2.0)).alias("wins"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    return wins.select(ratio(F.col("wins"), F.col("p").cast("double") * F.col("n")).alias("auc"))


def log_loss(predictions: DataFrame, prob: str = "prob", label: str = "label", batch: Column | None = None) -> DataFrame:
    """Mean logarithmic loss; with ``batch``, the mean of the batches' means."""
    y, p = F.col(label), F.col(prob)
    loss = -(y * F.log(p + TINY) + (1 - y) * F.log(1 - p + TINY))
    if batch is None:
        return predictions.agg(F.avg(loss).alias("log_loss"))
    return predictions.groupBy(batch.alias("b")).agg(F.avg(loss).alias("m")).agg(F.avg("m").alias("log_loss"))


def median(rows: DataFrame, value: str, name: str = "median") -> DataFrame:
    """One row: the exact median, the mean of the middle two where their number is even; null without values.

    Equal values meet in one row, ranges of values are counted, and only the one or two ranges that hold the middle ranks
    are looked into: no task sees more than a range.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = cut(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "value-ranges")
    held = ranges.groupBy("part").agg(F.sum("n").alias("held"))  # one row a range
    by_part = Window.orderBy("part")
    offset = F.coalesce(F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("held").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    middle = held.select("part", "held", offset.alias("offset"), F.floor((total - 1) / 2).alias("low"), F.floor(total / 2).alias("high"))
    middle = middle.filter((F.col("offset") <= F.col("high")) & (F.col("offset") + F.col("held") > F.col("low")))
    within = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    near = ranges.join(F.broadcast(middle), "part")  # two rows at most
    near = near.withColumn("under", F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0)))
    return near.filter((F.col("under") <= F.col("high")) & (F.col("under") + F.col("n") > F.col("low"))).agg(F.avg("v").alias(name))


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    out = one_row[0].withColumn("__one", F.lit(1))
    for more in one_row[1:]:
        out = out.join(more.withColumn("__one", F.lit(1)), "__one")
    return out.drop("__one")


def time_stats(times: DataFrame, seconds: str) -> DataFrame:
    c = F.col(seconds)
    rest = times.agg(F.avg(c).alias("avg_time"), F.min(c).alias("min_time"), F.max(c).alias("max_time"), F.sum(c).alias("total_time"))
    return side_by_side(rest, median(times, seconds, "median_time")).select("avg_time", "median_time", "min_time", "max_time", "total_time")


def summary(
    rows: DataFrame, mode: str = "full", predicted: str = "prediction", actual: str = "label", before: str | None = None,
    tried: str | None = None, confirmed: str | None = None, seconds: str | None = None,
) -> DataFrame:
    """The evaluation as one row: mode, total, accuracy, precision, recall, f1, the four confusion counts, fp_reduction
    (of verdicts ``before`` and after checking), exploitation_rate, avg_time, median_time. What has no column is 0."""
    rated = rates(confusion(rows, predicted, actual)).select(
        F.lit(mode).alias("mode"), (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("total"), "accuracy", "precision", "recall", "f1",
        F.col("tp").alias("true_positives"), F.col("tn").alias("true_negatives"), F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"),
    )
    none = lambda name: rows.sparkSession.createDataFrame([(0.0,)], f"{name} double")
    reduced = fp_reduction(rows, before, predicted, actual).select("fp_reduction") if before else none("fp_reduction")
    exploited = exploitation_rate(rows, tried, confirmed) if tried and confirmed else none("exploitation_rate")
    if seconds:
        times = time_stats(rows, seconds).select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_time", "median_time")])
    else:
        times = side_by_side(none("avg_time"), none("median_time"))
    return side_by_side(rated, reduced, exploited, times)


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


VERDICTS = ("CONFIRMED", "SUGGESTIVE", "NEUTRAL", "SAFE")


def verdict_rollup(results: DataFrame, verdict: str = "verdict", seconds: str = "total_time") -> DataFrame:
    """One row: counts and shares per verdict, and the average time."""
    total = F.count(F.lit(1))
    counts = [F.count_if(F.col(verdict) == v).alias(v.lower()) for v in VERDICTS]
    shares = [ratio(F.count_if(F.col(verdict) == v), total).alias(f"{v.lower()}_share") for v in VERDICTS]
    return results.agg(total.alias("total"), *counts, *shares, F.avg(seconds).alias("avg_time"))


# ---- contrastive losses over batches ------------------------------------------------------------------------


def batch_pairs(rows: DataFrame, batch: str, id_name: str, vector: str, label: str) -> DataFrame:
    """Ordered pairs of different rows of one (fixed-size) training batch, with similarity and whether labels agree."""
    a = rows.select(F.col(batch).alias("b"), F.col(id_name).alias("i"), F.col(vector).alias("vi"), F.col(label).alias("li"))
    c = rows.select(F.col(batch).alias("b"), F.col(id_name).alias("j"), F.col(vector).alias("vj"), F.col(label).alias("lj"))
    pairs = a.join(c, "b").filter("i <> j")
    return pairs.select("b", "i", "j", inner(F.col("vi"), F.col("vj")).alias("sim"), (F.col("li") == F.col("lj")).alias("same"))


def supervised_contrastive(pairs: DataFrame, temperature: float = 0.07) -> DataFrame:
    """b, loss: over anchors with a positive, minus the mean log-probability of positives; 0 without any."""
    z = F.col("sim") / temperature
    row = pairs.groupBy("b", "i").agg(
        F.log(F.sum(F.exp(z - 1 / temperature)) + 0.0).alias("lse"), F.avg(F.when(F.col("same"), z)).alias("positive")
    )
    loss = F.avg(F.col("lse") + F.lit(1 / temperature) - F.col("positive"))
    return row.groupBy("b").agg(F.coalesce(loss, F.lit(0.0)).alias("loss"))


def hard_triplet(pairs: DataFrame, margin: float = 0.3) -> DataFrame:
    """b, loss: furthest positive against nearest negative, over anchors that have both; 0 without any."""
    d = F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0)))
    row = pairs.groupBy("b", "i").agg(F.max(F.when(F.col("same"), d)).alias("p"), F.min(F.when(~F.col("same"), d)).alias("n"))
    return row.groupBy("b").agg(F.coalesce(F.avg(F.greatest(F.col("p") - F.col("n") + margin, F.lit(0.0)) + 0 * F.col("p") * F.col("n")), F.lit(0.0)).alias("loss"))
