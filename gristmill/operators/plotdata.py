"""Data of plots: what a figure shows, as small tables with metadata; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import finite, is_numeric, ratio
from ..plans.quantiles import quantiles
from ..plans.shapes import tall
from .analysis import CorrelationAnalysis, GroupComparison, OutlierAnalysis, TargetAnalysis, frequencies
from .audit import missing_counts
from .governance import GovernanceResult
from .modeling import ModelEvaluation
from .risk import BinaryRiskValidation

MAX_BINS, TOP = 50, 20


@dataclass(frozen=True)
class PlotData:
    chart_type: str
    title: str
    source: str
    item: str | None
    data: DataFrame
    metadata: dict[str, object] = field(default_factory=dict)


def histogram(df: DataFrame, columns: Sequence[str], max_bins: int = MAX_BINS) -> DataFrame:
    """(column, bin, lower, upper, n): Freedman-Diaconis bins over all finite rows, else the square root rule."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), finite(c, kinds[c]).alias("v")) for c in columns])
    values = df.select(F.inline(cells)).where("v is not null")
    edges = tall(df, {c: {"rows": F.count(finite(c, kinds[c])), "a": F.min(finite(c, kinds[c])), "b": F.max(finite(c, kinds[c]))} for c in columns}).drop("position").where("rows > 0")
    stats = edges.join(F.broadcast(quantiles(df, {c: finite(c, kinds[c]) for c in columns}, (0.25, 0.75))), "column")  # a row a column
    width = 2 * (F.col("q1") - F.col("q0")) * F.pow(F.col("rows").cast("double"), F.lit(-1.0 / 3))
    bins = F.when((width > 0) & (F.col("b") > F.col("a")), F.ceil(F.round((F.col("b") - F.col("a")) / width, 9))).otherwise(F.ceil(F.sqrt("rows")))
    stats = stats.withColumn("bins", F.when(F.col("b") > F.col("a"), F.least(F.greatest(bins, F.lit(1)), F.lit(max_bins))).otherwise(1).cast("int")).drop("q0", "q1")
    placed = values.join(F.broadcast(stats), "column")  # a row a column
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("v") - F.col("a")) * F.col("bins") / (F.col("b") - F.col("a"))), F.col("bins") - 1)).otherwise(0)
    counted = placed.groupBy("column", at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    step = (F.col("b") - F.col("a")) / F.col("bins")
    return every.join(counted, ["column", "bin"], "left").select("column", "bin", (F.col("a") + F.col("bin") * step).alias("lower"), (F.col("a") + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def plot_distributions(df: DataFrame, *, max_plots: int = 20) -> list[PlotData]:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns[:max_plots]:
        if is_numeric(kinds[c]):
            out.append(PlotData("histogram", f"Distribution of {c}", "distributions", c, histogram(df, [c])))
        else:
            top = frequencies(df, [c], None).where("value is not null").orderBy(F.desc("n"), "value").limit(TOP).select("value", "n")
            out.append(PlotData("bar", f"Most frequent values of {c}", "distributions", c, top))
    return out


def missing_rates(df: DataFrame) -> DataFrame:
    return missing_counts(df).select("column", "missing", ratio(F.col("missing"), F.col("rows")).alias("rate"))


def plot_missingness(df: DataFrame, *, max_columns: int = 50) -> PlotData:
    return PlotData("bar", "Missing values", "missingness", None, missing_rates(df.select(*df.columns[:max_columns])))


def plot_correlations(result: CorrelationAnalysis) -> PlotData:
    return PlotData("heatmap", f"{result.method} correlations", "correlations", None, result.correlations, {"columns": result.analyzed_columns})


def plot_outliers(result: OutlierAnalysis) -> PlotData:
    return PlotData("box", "Outliers", "outliers", None, result.summary)


def plot_group_comparison(result: GroupComparison) -> PlotData:
    return PlotData("bar", f"Groups of {result.group_by}", "groups", result.group_by, result.summary)


def plot_target_relationships(result: TargetAnalysis) -> list[PlotData]:
    return [PlotData("bar", f"Tests against {result.target}", "target", result.target, result.statistical_tests), PlotData("line", "Numeric features by class", "target", None, result.numeric_details), PlotData("bar", "Categories by class", "target", None, result.category_details)]


def plot_classification_evaluation(result: ModelEvaluation) -> list[PlotData]:
    out = [PlotData("heatmap", "Confusion matrix", "evaluation", None, result.confusion_matrix)]
    if result.roc_curve is not None:
        out.append(PlotData("line", "ROC curve", "evaluation", None, result.roc_curve))
    return out


def plot_regression_evaluation(result: ModelEvaluation) -> list[PlotData]:
    return [PlotData("bar", "Regression metrics", "evaluation", None, result.metrics)]


def plot_binary_risk_validation(result: BinaryRiskValidation) -> list[PlotData]:
    return [PlotData("bar", "Metrics by fold", "risk", None, result.metrics), PlotData("line", "Calibration", "risk", None, result.calibration), PlotData("line", "Gains", "risk", None, result.gains), PlotData("line", "Threshold rates", "risk", None, result.thresholds)]


def plot_model_governance(result: GovernanceResult) -> list[PlotData]:
    return [PlotData("bar", "Champion and challenger", "governance", None, result.comparison), PlotData("table", "Recommendation", "governance", None, result.recommendation)]
