"""Metrics of binary scores: ranking, probability, gains, thresholds, by fold or over all.

Every ranking metric works on counts of distinct scores, cumulated through bucketed windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..plans.ordered import running_sums

# Metric names, and the clip of probabilities in the log loss.
RISK_METRICS = ("roc_auc", "average_precision", "normalized_gini", "ks_statistic", "brier_score", "log_loss", "expected_calibration_error")
THRESHOLD_RATES = ("sensitivity", "specificity", "precision", "negative_predictive_value", "f1", "accuracy", "predicted_positive_rate")
CLIP = 1e-15


def scored(df: DataFrame, label: Column, score: Column, *, fold: Column | None = None, probability: Column | None = None) -> DataFrame:
    """(fold, y, score, probability): rows with a label and a score; y is 0 or 1."""
    rows = df.select((fold if fold is not None else F.lit("overall")).cast("string").alias("fold"), label.cast("int").alias("y"), score.cast("double").alias("score"), (probability if probability is not None else F.lit(None)).cast("double").alias("probability"))
    return rows.where("y is not null and score is not null")


def score_curve(rows: DataFrame) -> DataFrame:
    """(fold, score, pos, neg, tp, fp, total_pos, total_neg): cumulated from the highest score down, ties together."""
    counted = rows.groupBy("fold", "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    up = running_sums(counted, "score", ["pos", "neg"], descending=True, by=["fold"])
    totals = counted.groupBy("fold").agg(F.sum("pos").alias("total_pos"), F.sum("neg").alias("total_neg"))
    return up.join(F.broadcast(totals), "fold").withColumnRenamed("pos_upto", "tp").withColumnRenamed("neg_upto", "fp")


def ranking_metrics(rows: DataFrame) -> DataFrame:
    """(fold, n_pos, n_neg, roc_auc, normalized_gini, average_precision, ks_statistic, ks_threshold, status).

    One class only: metrics are null and the status is single_class.  KS keeps the highest of equal maxima's scores.
    """
    curve = score_curve(rows)
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    p, n = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    both = (F.col("total_pos") > 0) & (F.col("total_neg") > 0)
    # a tie block adds its negatives times the positives before it, and half of its own
    area = F.sum(neg * (tp - pos) + neg * pos / 2) / (F.max(p) * F.max(n))
    precision = F.sum(pos * tp / (tp + fp)) / F.max(p)
    gap = F.round(tp / p - fp / n, 12)
    out = curve.where(both).groupBy("fold").agg(area.alias("roc_auc"), precision.alias("average_precision"), F.max(gap).alias("ks_statistic"), F.max_by("score", F.struct(gap, F.col("score"))).alias("ks_threshold"))
    totals = curve.groupBy("fold").agg(F.max("total_pos").alias("n_pos"), F.max("total_neg").alias("n_neg"))
    return totals.join(out, "fold", "left").select(
        "fold", "n_pos", "n_neg", "roc_auc", (2 * F.col("roc_auc") - 1).alias("normalized_gini"), "average_precision", "ks_statistic", "ks_threshold",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), "available").otherwise("undefined").alias("status"),
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), "computed").otherwise("single_class").alias("reason"),
    )


def roc_curve(rows: DataFrame) -> DataFrame:
    """(fold, threshold, fpr, tpr), all points, with the point (0, 0) at an infinite threshold."""
    curve = score_curve(rows)
    points = curve.select("fold", F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("total_neg")).alias("fpr"), ratio(F.col("tp"), F.col("total_pos")).alias("tpr"))
    start = rows.select("fold").distinct().select("fold", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def probability_metrics(rows: DataFrame) -> DataFrame:
    """(fold, n, brier_score, log_loss): over rows with a probability."""
    p = F.least(F.greatest(F.col("probability"), F.lit(CLIP)), F.lit(1 - CLIP))
    y = F.col("y")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return rows.where("probability is not null").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("probability") - y) * (F.col("probability") - y)).alias("brier_score"), F.avg(loss).alias("log_loss"))


def calibration_bins(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(fold, bin, lower, upper, n, mean_probability, event_rate): equal-width bins, empty ones too."""
    numbered = rows.where("probability is not null").withColumn("bin", F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int"))
    found = numbered.groupBy("fold", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("mean_probability"), F.avg("y").alias("event_rate"))
    every = rows.select("fold").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, ["fold", "bin"], "left").select("fold", "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"), "mean_probability", "event_rate")


def calibration_error(rows: DataFrame, bins: int = 10) -> DataFrame:
    table = calibration_bins(rows, bins)
    return table.groupBy("fold").agg((F.sum(F.col("n") * F.abs(F.col("event_rate") - F.col("mean_probability"))) / F.sum("n")).alias("expected_calibration_error"))


def gains(rows: DataFrame, fractions: Sequence[float] = (0.1, 0.2, 0.5)) -> DataFrame:
    """(fold, fraction, k, boundary, selected, selected_pos, capture, lift): the top fraction by score, all ties taken."""
    curve = score_curve(rows).withColumn("upto", F.col("tp") + F.col("fp")).withColumn("total", F.col("total_pos") + F.col("total_neg"))
    wanted = curve.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
    k = F.greatest(F.lit(1), F.ceil(F.round(F.col("fraction") * F.col("total"), 9))).cast("long")
    # the first distinct score at which k rows are reached; its ties are in "upto"
    picked = wanted.withColumn("k", k).where(F.col("upto") >= F.col("k")).groupBy("fold", "fraction", "k").agg(F.max_by(F.struct("score", "upto", "tp", "total", "total_pos"), "score").alias("b"))
    capture = ratio(F.col("b.tp"), F.col("b.total_pos"))
    return picked.select("fold", "fraction", "k", F.col("b.score").alias("boundary"), F.col("b.upto").alias("selected"), F.col("b.tp").alias("selected_pos"), capture.alias("capture"), (capture / ratio(F.col("b.upto"), F.col("b.total"))).alias("lift"))


def threshold_table(rows: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(fold, threshold, tp, fp, tn, fn, seven rates): null rates have a zero denominator."""
    cells = []
    for t in thresholds:
        hit = F.col("score") >= F.lit(float(t))
        cells.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 0)).alias("tn"), F.count_if(~hit & (F.col("y") == 1)).alias("fn")))
    wide = rows.groupBy("fold").agg(*[c.alias(f"t{i}") for i, c in enumerate(cells)])
    flat = wide.select("fold", F.inline(F.array(*[F.col(f"t{i}") for i in range(len(cells))])))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    rates = (ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp), ratio(tn, tn + fn), ratio(2 * tp, 2 * tp + fp + fn), ratio(tp + tn, n), ratio(tp + fp, n))
    return flat.select("*", *[r.alias(name) for name, r in zip(THRESHOLD_RATES, rates, strict=True)])


def operating_point(table: DataFrame, metric: str = "f1") -> DataFrame:
    """(fold, metric, threshold, value): the best threshold; of equal ones the largest."""
    return table.where(F.col(metric).isNotNull()).groupBy("fold").agg(F.lit(metric).alias("metric"), F.max_by("threshold", F.struct(F.col(metric), F.col("threshold"))).alias("threshold"), F.max(metric).alias("value"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n, accuracy, balanced_accuracy, f1_macro): over the classes that occur."""
    table = confusion(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0)
    a = table.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("support"), F.sum(hit).alias("tp"))
    p = table.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("chosen"))
    both = a.join(p, "class", "full_outer").fillna(0, ["support", "tp", "chosen"])
    f1 = F.coalesce(ratio(2 * F.col("tp"), F.col("support") + F.col("chosen")), F.lit(0.0))
    return both.agg(F.sum("support").alias("n"), ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, ratio(F.col("tp"), F.col("support")))).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(n, mae, rmse, r2): a constant target gives r2 one when every prediction is right, else zero."""
    e = F.col(actual) - F.col(predicted)
    total = F.var_pop(actual) * F.count(actual)
    r2 = F.when(total > 0, 1 - F.sum(e * e) / total).otherwise(F.when(F.sum(e * e) == 0, 1.0).otherwise(0.0))
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"))


def business_metrics(df: DataFrame, label: Column, score: Column, *, probability: Column, exposure: Column, loss_fraction: Column, observed_loss: Column, threshold: float, fraction: float) -> DataFrame:
    """(segment, metrics): all rows, the top fraction by score with its ties, and rows at or above the threshold."""
    rows = df.select(label.cast("int").alias("y"), score.cast("double").alias("score"), probability.cast("double").alias("p"), exposure.cast("double").alias("exposure"), loss_fraction.cast("double").alias("lgd"), observed_loss.cast("double").alias("loss")).where("y is not null and score is not null")
    counted = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    up = running_sums(counted, "score", ["n"], descending=True)
    k = F.greatest(F.lit(1.0), F.ceil(F.round(F.lit(fraction) * F.sum("n"), 9).cast("double")))
    total = counted.agg(k.alias("k"))
    edge = up.crossJoin(F.broadcast(total)).where("n_upto >= k").agg(F.max("score").alias("boundary"))  # one row each
    joined = rows.crossJoin(F.broadcast(edge))
    segments = {"all": F.lit(True), "top_fraction": F.col("score") >= F.col("boundary"), "threshold_selected": F.col("score") >= F.lit(threshold)}
    exploded = joined.select("*", F.explode(F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in segments.items()]), lambda x: x.isNotNull())).alias("segment"))
    return exploded.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("event_rate"), F.avg((F.col("score") >= threshold).cast("int")).alias("predicted_positive_rate"),
        F.sum("exposure").alias("exposure_sum"), F.sum("loss").alias("observed_loss_sum"), F.sum(F.col("p") * F.col("exposure") * F.col("lgd")).alias("expected_loss_sum"),
    )


def fold_summary(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(metric, folds, mean, sample_std) over the folds of a wide metric table."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return metrics.select(F.inline(cells)).groupBy("metric").agg(F.count("value").alias("folds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sample_std"))


