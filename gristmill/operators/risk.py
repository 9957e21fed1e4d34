"""Binary risk validation: fold plans, label maturity, and metrics of given predictions."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import metrics

# Validation modes, sources of label maturity, and reasons of excluded rows.
MODES = ("stratified_holdout", "stratified_kfold", "group_holdout", "group_kfold", "time_holdout", "time_forward")
MATURITY_SOURCES = ("label_available_time", "observation_horizon", "outcome_end")
EXCLUDED_REASONS = ("missing_target", "training_only", "before_first_validation_window", "outside_validation_window")
_SHARE_BITS = 20


@dataclass(frozen=True)
class TimePlan:
    """When labels are known, and the windows that validate.

    ``observation`` names a timestamp column.  The outcome ends at ``outcome_end`` (a column) or
    ``horizon`` after the observation; the label is available ``reporting_delay`` after that, or at
    ``label_available``, as ``maturity_source`` says.  Whatever is given besides must agree.
    """

    observation: str
    maturity_source: str
    cutoffs: tuple[dt.datetime, ...]
    validation_end: dt.datetime
    analysis_as_of: dt.datetime
    horizon: dt.timedelta | None = None
    reporting_delay: dt.timedelta = dt.timedelta(0)
    outcome_end: str | None = None
    label_available: str | None = None
    event_time: str | None = None

    def __post_init__(self) -> None:
        if self.maturity_source not in MATURITY_SOURCES:
            raise ValueError(f"maturity_source must be one of {MATURITY_SOURCES}")
        if self.maturity_source == "label_available_time" and self.label_available is None:
            raise ValueError("label maturity metadata is missing or inconsistent")
        if self.maturity_source == "observation_horizon" and self.horizon is None:
            raise ValueError("label maturity metadata is missing or inconsistent")
        if self.maturity_source == "outcome_end" and self.outcome_end is None:
            raise ValueError("label maturity metadata is missing or inconsistent")
        if self.horizon is None and self.outcome_end is None:
            raise ValueError("label maturity metadata is missing or inconsistent")
        if self.horizon is not None and self.horizon <= dt.timedelta(0) or self.reporting_delay < dt.timedelta(0):
            raise ValueError("time validation metadata is invalid")
        if not self.cutoffs or list(self.cutoffs) != sorted(set(self.cutoffs)) or self.validation_end <= self.cutoffs[-1] or self.analysis_as_of < self.validation_end:
            raise ValueError("time validation metadata is invalid")

    @property
    def windows(self) -> list[tuple[dt.datetime, dt.datetime]]:
        return list(zip(self.cutoffs, (*self.cutoffs[1:], self.validation_end), strict=True))


@dataclass(frozen=True)
class RiskValidationConfig:
    mode: str = "stratified_kfold"
    folds: int = 5
    test_share: float = 0.2
    seed: int = 42
    group: str | None = None
    time: TimePlan | None = None
    calibration_bins: int = 10
    fractions: tuple[float, ...] = (0.1, 0.2, 0.5)
    thresholds: tuple[float, ...] = (0.25, 0.5, 0.75)
    operating_metric: str = "f1"
    higher_is_riskier: bool = True

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if self.folds < 2:
            raise ValueError("at least two folds")
        if not 0 < self.test_share < 1:
            raise ValueError("test_share lies between 0 and 1")
        if self.mode.startswith("time") != (self.time is not None):
            raise ValueError("time modes, and no others, need a time plan")
        if self.mode == "time_holdout" and len(self.time.cutoffs) != 1:
            raise ValueError("time_holdout has one cutoff")
        if self.mode == "time_forward" and not 2 <= len(self.time.cutoffs) <= 20:
            raise ValueError("time_forward has 2 to 20 cutoffs")


def _place(keys: Sequence[Column], seed: int) -> Column:
    """60 bits of an MD5 digest of seed and keys; null and the empty text differ."""
    told = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("-")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *told)), 1, 15), 16, 10).cast("long")


def _shared(place: Column, share: float) -> Column:
    return F.pmod(place, F.lit(1 << _SHARE_BITS)) < int(share * (1 << _SHARE_BITS))


def label_available(observed: Column, horizon: dt.timedelta, delay: dt.timedelta = dt.timedelta(0)) -> Column:
    return observed + F.lit(horizon + delay)


def holdout(df: DataFrame, label: str, keys: Sequence[str], share: float, seed: int = 42) -> DataFrame:
    """``df`` with role: test for about ``share`` of each class, by a hash of class and key."""
    return df.withColumn("role", F.when(_shared(_place([F.col(c) for c in (label, *keys)], seed), share), "test").otherwise("train"))


@dataclass(frozen=True)
class FoldPlan:
    """``rows`` has all columns of the input, fold (which the row validates, or null), is_evaluable, and
    in time modes _observed and _available.  Only rows with a target are in it."""

    config: RiskValidationConfig
    rows: DataFrame
    target: str
    positive: object

    @property
    def count(self) -> int:
        return len(self.config.time.cutoffs) if self.config.time else 1 if self.config.mode.endswith("holdout") else self.config.folds

    def before(self, fold: int) -> Column:
        """Rows that could train the fold if their labels were known."""
        if self.config.time:
            return F.col("_observed") < F.lit(self.config.time.cutoffs[fold]).cast("timestamp_ntz")
        return ~F.col("fold").eqNullSafe(F.lit(fold))

    def train(self, fold: int) -> Column:
        """Of those, rows whose label is available by the cutoff; the others are purged."""
        if self.config.time:
            return self.before(fold) & (F.col("_available") <= F.lit(self.config.time.cutoffs[fold]).cast("timestamp_ntz"))
        return self.before(fold)

    def validation(self, fold: int) -> Column:
        return F.col("fold").eqNullSafe(F.lit(fold))


def _maturity(df: DataFrame, plan: TimePlan, hit: Column) -> DataFrame:
    """``df`` with _observed and _available; one aggregate proves that what is given agrees."""
    ntz = lambda name: F.col(f"`{name}`").cast("timestamp_ntz")
    observed = ntz(plan.observation)
    derived = observed + F.lit(plan.horizon) if plan.horizon is not None else None
    outcome = ntz(plan.outcome_end) if plan.outcome_end else derived
    due = outcome + F.lit(plan.reporting_delay)
    explicit = ntz(plan.label_available) if plan.label_available else None
    available = explicit if plan.maturity_source == "label_available_time" else due
    missing = [observed.isNull(), outcome.isNull(), available.isNull()]
    checks = {"time validation metadata is invalid": [*missing, ~(outcome > observed)], "label maturity metadata is missing or inconsistent": []}
    if plan.outcome_end and derived is not None:
        checks["label maturity metadata is missing or inconsistent"].append(outcome != derived)
    if explicit is not None:
        wrong = explicit < due if plan.maturity_source == "label_available_time" else explicit.isNull() | (explicit != due)
        checks["label maturity metadata is missing or inconsistent"].append(wrong)
    if plan.event_time:
        event = ntz(plan.event_time)
        checks["time validation metadata is invalid"].append(event.isNotNull() & (~hit | ~((observed < event) & (event <= outcome)) | (available < event)))
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))) for conditions in checks.values() for c in conditions]).first()
    names = [name for name, conditions in checks.items() for _ in conditions]
    for name, n in zip(names, counted, strict=True):
        if n:
            raise ValueError(name)
    return df.withColumn("_observed", observed).withColumn("_available", available)


def fold_plan(df: DataFrame, target: str, config: RiskValidationConfig, keys: Sequence[str], positive: object = 1) -> FoldPlan:
    """The plan of any mode, without a shuffle.

    Stratified modes deal the rows of each class by a hash of their ``keys``, group modes whole
    groups by a hash of the group: folds are disjoint, stable and balanced up to chance, and no
    global order is needed.  Time modes validate in [cutoff, next cutoff) and train on rows observed
    before the cutoff whose label was available by then.  Rows without a target are left out.
    """
    rows = df.where(F.col(target).isNotNull())
    hit = F.col(target) == F.lit(positive)
    seen = F.lit(True)
    if config.time:
        rows = _maturity(rows, config.time, hit)
        o = F.col("_observed")
        windows = [F.when((o >= F.lit(a).cast("timestamp_ntz")) & (o < F.lit(b).cast("timestamp_ntz")), F.lit(i)) for i, (a, b) in enumerate(config.time.windows)]
        fold = F.coalesce(*windows)
        seen = F.col("_available") <= F.lit(config.time.analysis_as_of).cast("timestamp_ntz")
    else:
        if config.mode.startswith("group") and config.group is None:
            raise ValueError("group modes need a group column")
        place = _place([F.col(f"`{config.group}`")] if config.mode.startswith("group") else [F.col(f"`{c}`") for c in (target, *keys)], config.seed)
        fold = F.when(_shared(place, config.test_share), 0) if config.mode.endswith("holdout") else F.pmod(place, F.lit(config.folds))
    return FoldPlan(config, rows.withColumn("fold", fold.cast("int")).withColumn("is_evaluable", F.col("fold").isNotNull() & seen), target, positive)


def fold_table(plan: FoldPlan) -> DataFrame:
    """One row a fold: its window and the counts of every role, all in one aggregate."""
    hit = F.col(plan.target) == F.lit(plan.positive)
    time = plan.config.time
    cells = []
    for i in range(plan.count):
        before, train, validation = plan.before(i), plan.train(i), plan.validation(i)
        mature = validation & F.col("is_evaluable")
        window = time.windows[i] if time else (None, None)
        counts = {
            "train_candidate_n": before, "train_n": train, "train_positive_n": train & hit, "validation_n": validation, "evaluable_validation_n": mature, "evaluable_positive_n": mature & hit,
            "purged_train_n": before & ~train, "immature_validation_n": validation & ~F.col("is_evaluable"),
        }
        stamps = [F.lit(x).cast("timestamp_ntz").alias(n) for n, x in (("cutoff", window[0]), ("validation_start", window[0]), ("validation_end", window[1]), ("analysis_as_of", time.analysis_as_of if time else None))]
        cells.append(F.struct(F.lit(i).alias("fold_id"), *stamps, *[F.count_if(c).alias(n) for n, c in counts.items()]))
    one = plan.rows.agg(*[c.alias(f"f{i}") for i, c in enumerate(cells)])
    flat = one.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(plan.count)])))
    counted = F.lit(1 if time else 0)
    return flat.select(
        "fold_id", "cutoff", "validation_start", "validation_end", "analysis_as_of", "train_candidate_n", "train_n", "train_positive_n", ratio(F.col("train_positive_n"), F.col("train_n")).alias("train_positive_rate"),
        "validation_n", (F.col("evaluable_validation_n") * counted).alias("validation_mature_n"), F.col("immature_validation_n").alias("validation_excluded_n"), "evaluable_validation_n", "evaluable_positive_n",
        ratio(F.col("evaluable_positive_n"), F.col("evaluable_validation_n")).alias("evaluable_positive_rate"), F.col("purged_train_n").alias("immature_train_n"), "purged_train_n", "immature_validation_n",
        F.lit(time.maturity_source if time else "not_applicable").alias("maturity_source"),
    )


def check_plan(plan: FoldPlan) -> DataFrame:
    """The fold table, or an error where a fold cannot train or validate."""
    table = fold_table(plan)
    for r in table.collect():  # at most 20 rows
        if not r["validation_n"]:
            raise ValueError(f"validation fold {r['fold_id']} has no validation rows")
        if not 0 < r["train_positive_n"] < r["train_n"]:
            raise ValueError("binary risk validation split is infeasible")
    return table


def excluded_rows(df: DataFrame, plan: FoldPlan, keys: Sequence[str]) -> DataFrame:
    """(keys, reason) of rows that no fold validates."""
    missing = df.where(F.col(plan.target).isNull()).select(*keys, F.lit("missing_target").alias("reason"))
    reason = F.lit("training_only")
    if plan.config.time:
        reason = F.when(F.col("_observed") < F.lit(plan.config.time.cutoffs[0]).cast("timestamp_ntz"), "before_first_validation_window").otherwise("outside_validation_window")
    return missing.unionByName(plan.rows.where(F.col("fold").isNull()).select(*keys, reason.alias("reason")))


def prediction_table(scored: DataFrame, target: str, keys: Sequence[str]) -> DataFrame:
    """(keys, fold_id, target_value, is_evaluable, unevaluable_reason, ranking_score, event_probability)."""
    seen = F.col("is_evaluable")
    return scored.select(*keys, F.col("fold").alias("fold_id"), F.when(seen, F.col(target)).alias("target_value"), "is_evaluable", F.when(~seen, "immature_validation_outcome").alias("unevaluable_reason"), "ranking_score", "event_probability")


def external_predictions(plan: FoldPlan, predictions: DataFrame, keys: Sequence[str], direction: str = "higher_risk") -> DataFrame:
    """The plan's validation rows with given scores, which must match the plan exactly.

    ``predictions`` has the keys, fold, and ranking_score or event_probability or both; probabilities
    alone become the ranking.  A row that is missing, twice there, in another fold or not of the plan,
    a score that is not finite, and a probability outside [0, 1] are errors.
    """
    if direction not in ("higher_risk", "lower_risk"):
        raise ValueError("ranking scores must be finite real values with explicit direction")
    given = [c for c in ("ranking_score", "event_probability") if c in predictions.columns]
    if not given:
        raise ValueError("external risk predictions have invalid schema")
    theirs = predictions.select(*keys, F.col("fold").alias("_fold"), *[F.col(c).cast("double").alias(f"_{c}") for c in given], F.lit(1).alias("_there"))
    own = plan.rows.where(F.col("fold").isNotNull()).withColumn("_own", F.lit(1))
    rank = F.col("_ranking_score") if "ranking_score" in given else F.col("_event_probability")
    probability = F.col("_event_probability") if "event_probability" in given else F.lit(None).cast("double")
    both = own.join(theirs, list(keys), "full_outer")
    odd = [F.col("_own").isNull() | F.col("_there").isNull() | (F.col("fold") != F.col("_fold")), rank.isNull() | F.isnan(rank) | (F.abs(rank) == float("inf"))]
    if "event_probability" in given:
        odd.append(probability.isNull() | ~probability.between(0, 1))
    twice = theirs.groupBy(*keys).count().where("count > 1").limit(1).count()
    found = both.agg(*[F.count_if(F.coalesce(c, F.lit(True))) for c in odd]).first()
    if twice or found[0]:
        raise ValueError("external prediction provenance does not match validation plan")
    if any(found[1:]):
        raise ValueError("ranking scores must be finite real values with explicit direction")
    ranked = -rank if direction == "lower_risk" and "ranking_score" in given else rank
    return both.withColumn("ranking_score", ranked).withColumn("event_probability", probability).drop("_own", "_there", "_fold", *[f"_{c}" for c in given])


@dataclass(frozen=True)
class BinaryRiskValidation:
    config: RiskValidationConfig
    metrics: DataFrame
    fold_summary: DataFrame
    calibration: DataFrame
    gains: DataFrame
    thresholds: DataFrame
    operating_point: DataFrame
    limitations: tuple[str, ...]
    folds: DataFrame | None = None
    predictions: DataFrame | None = None
    excluded: DataFrame | None = None


def validate_predictions(df: DataFrame, label: str, score: str, *, config: RiskValidationConfig, fold: str | None = None, probability: str | None = None, positive: object = 1) -> BinaryRiskValidation:
    """All metric tables for given predictions, overall and by fold.

    Rows without label or score are not evaluable.  A score where lower means riskier is negated.
    Without a probability the probability metrics are absent.
    """
    y = F.when(F.col(label).isNotNull(), (F.col(label) == F.lit(positive)).cast("int"))
    s = F.col(score) if config.higher_is_riskier else -F.col(score)
    p = F.col(probability) if probability else None
    overall = metrics.scored(df, y, s, probability=p)
    rows = overall if fold is None else overall.unionByName(metrics.scored(df, y, s, fold=F.col(fold), probability=p))
    table = metrics.ranking_metrics(rows)
    if probability:
        table = table.join(metrics.probability_metrics(rows).drop("n"), "fold", "left").join(metrics.calibration_error(rows, config.calibration_bins), "fold", "left")
    names = [n for n in metrics.RISK_METRICS if n in table.columns]
    thresholds = metrics.threshold_table(rows, config.thresholds)
    limits = () if probability else ("probability_absent",)
    return BinaryRiskValidation(
        config, table, metrics.fold_summary(table.where("fold <> 'overall'"), names), metrics.calibration_bins(rows, config.calibration_bins), metrics.gains(rows, config.fractions), thresholds, metrics.operating_point(thresholds, config.operating_metric), limits
    )


def validate_binary_risk(df: DataFrame, target: str, *, positive_label: object = 1, config: RiskValidationConfig | None = None, estimator: object = None, features: Sequence[str] = (), keys: Sequence[str] = (), predictions: DataFrame | None = None, direction: str = "higher_risk") -> BinaryRiskValidation:
    """Validate a ``pyspark.ml`` estimator on the plan of ``config.mode``, or take ``predictions`` that match it.

    Each fold's model sees the fold's training rows alone; metrics count evaluable rows alone.
    """
    config = config or RiskValidationConfig()
    plan = fold_plan(df, target, config, keys, positive_label)
    table = check_plan(plan)
    if predictions is not None:
        out = external_predictions(plan, predictions, keys, direction)
    else:
        from .modeling import predict_folds

        out = predict_folds(plan, list(features), estimator, keep=list(keys))
    probability = None if predictions is not None and "event_probability" not in predictions.columns else "event_probability"
    ranked = dataclasses.replace(config, higher_is_riskier=True)  # a lower-risk score has been turned already
    found = validate_predictions(out.where("is_evaluable"), target, "ranking_score", config=ranked, fold="fold", probability=probability, positive=positive_label)
    return dataclasses.replace(found, config=config, folds=table, predictions=prediction_table(out, target, keys), excluded=excluded_rows(df, plan, keys))
