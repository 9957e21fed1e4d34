"""Baseline models with ``pyspark.ml``: split first, fit the preparation on training rows only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_categorical, is_datetime, is_numeric, present
from . import metrics
from .profile import infer_schema
from .risk import FoldPlan, holdout


@dataclass(frozen=True)
class TrainingResult:
    task: str
    target: str
    feature_columns: tuple[str, ...]
    excluded_columns: dict[str, str]
    model: PipelineModel
    classes: tuple[object, ...]
    train: DataFrame
    test: DataFrame
    warnings: tuple[str, ...]
    limitations: tuple[str, ...]


def _fill(train: DataFrame, numeric: list[str], levels: list[str]) -> dict[str, object]:
    """Medians, and the most frequent level (of equal ones the smallest); a row a column comes back."""
    kinds = {f.name: f.dataType for f in train.schema.fields}
    fills: dict[str, object] = {}
    if numeric:
        row = train.agg(*[F.percentile(present(n, kinds[n]).cast("double"), F.lit(0.5)).alias(f"m{i}") for i, n in enumerate(numeric)]).first()
        fills |= {n: row[f"m{i}"] if row[f"m{i}"] is not None else 0.0 for i, n in enumerate(numeric)}
    for n in levels:
        top = train.where(F.col(n).isNotNull()).groupBy(F.col(n).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").first()
        fills[n] = top["v"] if top else "missing"
    return fills


def prepared(df: DataFrame, fills: dict[str, object], keep: Sequence[str]) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for n, v in fills.items():
        c = present(n, kinds[n])
        columns.append(F.coalesce(c.cast("double" if isinstance(v, float) else "string"), F.lit(v)).alias(n))
    return df.select(*keep, *columns)


def _stages(numeric: list[str], levels: list[str]) -> list:
    stages = []
    if levels:
        stages += [StringIndexer(inputCols=levels, outputCols=[f"{n}__i" for n in levels], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{n}__i" for n in levels], outputCols=[f"{n}__v" for n in levels], dropLast=True)]
    stages.append(VectorAssembler(inputCols=numeric or [], outputCol="_numeric"))
    stages.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["_scaled", *[f"{n}__v" for n in levels]], outputCol="features"))
    return stages if numeric else [*stages[: 2 * bool(levels)], VectorAssembler(inputCols=[f"{n}__v" for n in levels], outputCol="features")]


def _features(train: DataFrame, target: str, features: Sequence[str] | None, exclude: Sequence[str]) -> tuple[list[str], list[str], dict[str, str]]:
    kinds = {f.name: f.dataType for f in train.schema.fields}
    names = [n for n in (features or train.columns) if n not in (target, "role", "fold")]
    dropped = {n: "explicitly_excluded" for n in names if n in exclude}
    report = infer_schema(train.select(*[n for n in names if n not in dropped]))
    for c in report.columns:
        if is_datetime(kinds[c.name]):
            dropped[c.name] = "datetime_column"
        elif c.missing_count == report.n_rows:
            dropped[c.name] = "all_missing"
        elif c.is_id_like:
            dropped[c.name] = "identifier_like"
        elif c.is_constant:
            dropped[c.name] = "constant"
        elif not (is_numeric(kinds[c.name]) or is_categorical(kinds[c.name])):
            dropped[c.name] = "unsupported_dtype"
    kept = [n for n in names if n not in dropped]
    if not kept:
        raise ValueError("no usable feature is left")
    return [n for n in kept if is_numeric(kinds[n])], [n for n in kept if not is_numeric(kinds[n])], dropped


def train_classifier(df: DataFrame, target: str, *, features: Sequence[str] | None = None, exclude_columns: Sequence[str] = (), keys: Sequence[str] = (), estimator: object = None, test_size: float = 0.2, random_state: int = 42) -> TrainingResult:
    """Logistic regression with an L2 penalty (C = 1) unless another ``pyspark.ml`` estimator is given."""
    rows = df.where(F.col(target).isNotNull())
    counts = rows.groupBy(target).count().limit(1001).collect()
    if len(counts) < 2 or min(r["count"] for r in counts) < 2:
        raise ValueError("a classifier needs two classes of two rows at least")
    classes = tuple(sorted((r[target] for r in counts), key=str))
    split = holdout(rows, target, keys or [c for c in rows.columns if c != target], test_size, random_state)
    train, test = split.where("role = 'train'"), split.where("role = 'test'")
    numeric, levels, dropped = _features(train.drop("role"), target, features, [*exclude_columns, *keys])
    fills = _fill(train, numeric, levels)
    fitted = prepared(train, fills, [target])
    label = StringIndexer(inputCol="_y", outputCol="label", stringOrderType="alphabetAsc")
    n = fitted.count()
    model = estimator or LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=1000)
    pipeline = Pipeline(stages=[label, *_stages(numeric, levels), model]).fit(fitted.withColumn("_y", F.col(target).cast("string")))
    kept = [c for c in test.columns if c not in fills and c != target]
    ready = prepared(test, fills, [*kept, target]).withColumn("_y", F.col(target).cast("string"))
    return TrainingResult("classification", target, tuple(fills), dropped, pipeline, classes, train, ready, (), ("single_holdout", "no_tuning"))


def predictions(result: TrainingResult) -> DataFrame:
    """The test rows with actual, predicted and, for two classes, the probability of the second."""
    out = result.model.transform(result.test)
    if result.task == "regression":
        return out.withColumn("actual", F.col(result.target).cast("double")).withColumnRenamed("prediction", "predicted")
    names = F.array(*[F.lit(str(c)) for c in result.classes])
    out = out.withColumn("actual", F.col("_y")).withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1))
    return out.withColumn("event_probability", vector_to_array("probability")[1]) if "probability" in out.columns else out


@dataclass(frozen=True)
class ModelEvaluation:
    task: str
    target: str
    metrics: DataFrame
    confusion_matrix: DataFrame | None
    roc_curve: DataFrame | None
    roc_auc: DataFrame | None
    limitations: tuple[str, ...]


def evaluate_classifier(result: TrainingResult) -> ModelEvaluation:
    out = predictions(result)
    curve = auc = None
    if len(result.classes) == 2:
        rows = metrics.scored(out, (F.col("actual") == str(result.classes[1])).cast("int"), F.col("event_probability"))
        curve, auc = metrics.roc_curve(rows), metrics.ranking_metrics(rows)
    return ModelEvaluation("classification", result.target, metrics.class_metrics(out, "actual", "predicted"), metrics.confusion(out, "actual", "predicted"), curve, auc, result.limitations)


def train_regressor(df: DataFrame, target: str, *, features: Sequence[str] | None = None, exclude_columns: Sequence[str] = (), keys: Sequence[str] = (), estimator: object = None, test_size: float = 0.2, random_state: int = 42) -> TrainingResult:
    """Ridge regression (penalty 1) unless another estimator is given; the target must be finite and vary."""
    rows = df.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    seen = rows.agg(F.min(target).alias("a"), F.max(target).alias("b"), F.count(target).alias("n")).first()
    if not seen["n"] or seen["a"] == seen["b"] or abs(seen["b"]) == float("inf") or abs(seen["a"]) == float("inf"):
        raise ValueError("a regression target must be finite and vary")
    split = holdout(rows.withColumn("_all", F.lit(0)), "_all", keys or [c for c in rows.columns if c != target], test_size, random_state).drop("_all")
    train, test = split.where("role = 'train'"), split.where("role = 'test'")
    numeric, levels, dropped = _features(train.drop("role"), target, features, [*exclude_columns, *keys])
    fills = _fill(train, numeric, levels)
    fitted = prepared(train, fills, [F.col(target).cast("double").alias("label")])
    model = estimator or LinearRegression(regParam=1 / fitted.count(), elasticNetParam=0.0, standardization=False)
    pipeline = Pipeline(stages=[*_stages(numeric, levels), model]).fit(fitted)
    kept = [c for c in test.columns if c not in fills and c != target]
    ready = prepared(test, fills, [*kept, target])
    return TrainingResult("regression", target, tuple(fills), dropped, pipeline, (), train, ready, (), ("single_holdout", "no_tuning"))


def evaluate_regressor(result: TrainingResult) -> ModelEvaluation:
    out = predictions(result)
    return ModelEvaluation("regression", result.target, metrics.regression_metrics(out, "actual", "predicted"), None, None, None, result.limitations)


def evaluate_model(result: TrainingResult) -> ModelEvaluation:
    return evaluate_classifier(result) if result.task == "classification" else evaluate_regressor(result)


def predict_folds(plan: FoldPlan, features: list[str], estimator: object, keep: Sequence[str] = ()) -> DataFrame:
    """Probabilities of the positive class for every validation row: one fit a fold, on that fold's training rows."""
    out = None
    rows = plan.rows
    kept = list(dict.fromkeys([*keep, plan.target, "fold", "is_evaluable"]))
    for k in range(plan.count):
        train, test = rows.where(plan.train(k)), rows.where(plan.validation(k))
        hidden = [c for c in ("fold", "is_evaluable", "_observed", "_available") if c in rows.columns]
        numeric, levels, _ = _features(train.drop(*hidden), plan.target, features or None, list(keep))
        fills = _fill(train, numeric, levels)
        ready = prepared(train, fills, [(F.col(plan.target) == F.lit(plan.positive)).cast("double").alias("label")])
        model = estimator or LogisticRegression(regParam=1 / max(1, ready.count()), elasticNetParam=0.0, standardization=False, maxIter=1000)
        fitted = Pipeline(stages=[*_stages(numeric, levels), model]).fit(ready)
        part = fitted.transform(prepared(test, fills, [F.col(c).alias(f"_keep{i}") for i, c in enumerate(kept)]))
        part = part.select(*[F.col(f"_keep{i}").alias(c) for i, c in enumerate(kept)], vector_to_array("probability")[1].alias("event_probability"))
        part = part.withColumn("ranking_score", F.col("event_probability"))
        out = part if out is None else out.unionByName(part)
    return out
