"""Model governance: drift and stability of predictions, champion against challenger, a recommendation."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shapes import small, tall
from . import metrics

# Directions of metrics, recommendations and the bootstrap's budget.
HIGHER, LOWER = ("roc_auc", "average_precision", "normalized_gini", "ks_statistic", "accuracy", "f1"), ("brier_score", "log_loss", "expected_calibration_error", "total_variation")
RECOMMENDATIONS = ("promote_challenger", "retain_champion", "continue_evaluation", "insufficient_evidence", "reject_challenger")
BOOTSTRAP_DRAWS = 2_000_000


@dataclass(frozen=True)
class Criterion:
    criterion_key: str
    metric: str
    direction: str | None = None  # higher, lower or target_range
    low: float | None = None
    high: float | None = None
    tolerance: float = 0.0
    veto: bool = False

    @property
    def way(self) -> str:
        return self.direction or ("higher" if self.metric in HIGHER else "lower")


@dataclass(frozen=True)
class GovernancePolicy:
    champion: str
    challenger: str
    criteria: tuple[Criterion, ...]
    #: evidence of a later time proves nothing; without a time nothing is asked
    evaluation_time: dt.datetime | None = None
    #: both sides must come from one snapshot, or speak of the same entities
    require_snapshot: bool = False
    require_alignment: bool = False

    def __post_init__(self) -> None:
        if not 1 <= len(self.criteria) <= 64 or self.champion == self.challenger:
            raise ValueError("invalid_policy")
        if len({c.criterion_key for c in self.criteria}) != len(self.criteria):
            raise ValueError("duplicate_criterion")


def prediction_bins(df: DataFrame, probability: Column, bins: int = 10) -> DataFrame:
    """(bin, n): rows by equal-width bin, empty ones too."""
    p = probability.cast("double")
    found = df.where(p.isNotNull()).groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = small(df.sparkSession, [(i,) for i in range(bins)], "bin int")
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def total_variation(reference: DataFrame, current: DataFrame, probability: str, bins: int = 10) -> DataFrame:
    """(reference_rows, current_rows, total_variation): half the summed differences of the bins' shares."""
    a = prediction_bins(reference, F.col(probability), bins).withColumnRenamed("n", "a")
    b = prediction_bins(current, F.col(probability), bins).withColumnRenamed("n", "b")
    both = a.join(b, "bin")
    totals = both.agg(F.sum("a").alias("reference_rows"), F.sum("b").alias("current_rows"))
    gap = F.abs(F.col("a") / F.col("reference_rows") - F.col("b") / F.col("current_rows"))
    return both.crossJoin(F.broadcast(totals)).groupBy("reference_rows", "current_rows").agg((F.sum(gap) / 2).alias("total_variation"))


def drift_deviation(counts: Sequence[int], size: int, draws: int = 1000, seed: int = 42) -> float:
    """Standard deviation of the total variation when ``size`` rows are drawn from the reference's bins."""
    if draws * len(counts) > BOOTSTRAP_DRAWS:
        raise ValueError("bootstrap_budget")
    p = np.asarray(counts, float) / sum(counts)
    drawn = np.random.default_rng(seed).multinomial(size, p, size=draws) / size
    return float((np.abs(drawn - p).sum(axis=1) / 2).std(ddof=1))


def auc_stability(reference: DataFrame, current: DataFrame, label: Column, score: Column) -> DataFrame:
    """(period, n_pos, n_neg, roc_auc, change from the reference)"""
    rows = metrics.scored(reference, label, score, fold=F.lit("reference")).unionByName(metrics.scored(current, label, score, fold=F.lit("current")))
    table = metrics.ranking_metrics(rows).select(F.col("fold").alias("period"), "n_pos", "n_neg", "roc_auc")
    base = table.where("period = 'reference'").select(F.col("roc_auc").alias("_base"))
    return table.crossJoin(F.broadcast(base)).select("period", "n_pos", "n_neg", "roc_auc", (F.col("roc_auc") - F.col("_base")).alias("change"))


def auc_deviation(scores: Sequence[float], labels: Sequence[int], draws: int = 200, seed: int = 42) -> float:
    """Bootstrap deviation of the AUC for a bounded vector of declared evidence."""
    s, y = np.asarray(scores, float), np.asarray(labels, int)
    if len(s) > 200_000 or len(s) * draws > BOOTSTRAP_DRAWS * 10:
        raise ValueError("bootstrap_budget")
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(draws):
        at = rng.integers(0, len(s), len(s))
        pos, neg = s[at][y[at] == 1], s[at][y[at] == 0]
        if len(pos) and len(neg):
            order = np.sort(neg)
            found.append((np.searchsorted(order, pos, "left") + np.searchsorted(order, pos, "right")).sum() / (2 * len(pos) * len(neg)))
    return float(np.std(found, ddof=1)) if len(found) > 1 else 0.0


def stability(reference: DataFrame, current: DataFrame, label: Column, probability: Column) -> DataFrame:
    """(period, n, brier_score, change from the reference)"""
    rows = metrics.scored(reference, label, probability, fold=F.lit("reference"), probability=probability).unionByName(metrics.scored(current, label, probability, fold=F.lit("current"), probability=probability))
    table = metrics.probability_metrics(rows).select(F.col("fold").alias("period"), "n", "brier_score")
    base = table.where("period = 'reference'").select(F.col("brier_score").alias("_base"))  # one row
    return table.crossJoin(F.broadcast(base)).select("period", "n", "brier_score", (F.col("brier_score") - F.col("_base")).alias("change"))


def brier_deviation(reference: DataFrame, label: Column, probability: Column) -> DataFrame:
    """(n, brier_score, deviation): the deviation that resampling rows gives the score, a mean, in closed form at any size."""
    e = (probability.cast("double") - label) * (probability.cast("double") - label)
    return reference.where(label.isNotNull() & probability.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("brier_score"), (F.stddev_pop(e) / F.sqrt(F.count(F.lit(1)))).alias("deviation"))


@dataclass(frozen=True)
class EvidenceRef:
    """Where a model's value of a criterion is: exactly one row of ``table`` has the values of ``where``."""

    model: str
    metric: str
    table: str
    where: tuple[tuple[str, object], ...]
    value_column: str = "value"
    status_column: str | None = None
    support_column: str | None = None
    as_of: dt.datetime | None = None
    snapshot: str | None = None
    entities: str | None = None


def resolve(refs: Sequence[EvidenceRef], tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row a reference: its value, or why there is none.  Each table is read once for all of its references.

    No row is ``source_not_found``, more than one ``source_not_unique``, a value that is no finite number
    ``invalid_owner_value``; a row that says itself that its value is not available hands on its status.
    """
    spark = next(iter(tables.values())).sparkSession
    out = None
    for name in dict.fromkeys(r.table for r in refs):
        if name not in tables:
            raise ValueError("unknown_source_table")
        table = tables[name]
        cells = {}
        for i, r in enumerate(refs):
            if r.table != name:
                continue
            named = [c for c, _ in r.where] + [c for c in (r.value_column, r.status_column, r.support_column) if c]
            if not r.where or any(c not in table.columns for c in named):
                raise ValueError("invalid_source_locator")
            here = F.lit(True)
            for c, v in r.where:
                here = here & F.col(f"`{c}`").eqNullSafe(F.lit(v))
            pick = lambda c, kind, here=here: F.max(F.when(here, F.col(f"`{c}`"))).cast(kind) if c else F.lit(None).cast(kind)
            cells[str(i)] = {"matches": F.count_if(here), "value": pick(r.value_column, "double"), "support": pick(r.support_column, "long"), "said": pick(r.status_column, "string")}
        part = tall(table, cells, "ref").drop("position")
        out = part if out is None else out.unionByName(part)
    said = F.coalesce("said", F.lit("available"))
    missing = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    reason = F.when(F.col("matches") == 0, "source_not_found").when(F.col("matches") > 1, "source_not_unique").when(said != "available", said).when(missing, "invalid_owner_value").otherwise("computed")
    about = small(spark, [(str(i), i, r.model, r.metric, r.table, r.as_of, r.snapshot, r.entities) for i, r in enumerate(refs)], "ref string, ordinal int, model string, metric string, source string, as_of timestamp_ntz, snapshot string, entities string")
    fine = reason == "computed"
    joined = out.join(F.broadcast(about), "ref")  # a row a reference
    return joined.select("ordinal", "model", "metric", "source", "matches", F.when(fine, F.col("value")).alias("value"), "support", F.when(fine, "available").otherwise("not_verifiable").alias("status"), reason.alias("reason"), "as_of", "snapshot", "entities")


def compare(evidence: DataFrame, policy: GovernancePolicy) -> DataFrame:
    """(criterion_key, metric, champion_value, challenger_value, winner, status, reason): ``evidence`` is (model, metric, value),
    with as_of, snapshot and entities where ``resolve`` made it.

    Exactly one row a model and metric counts as evidence.  A target range compares distances to it;
    differences within the tolerance tie.  Values whose time, snapshot or entities the policy asks for and
    the evidence does not prove are shown and not compared.
    """
    rows = [(i, c.criterion_key, c.metric, c.way, c.low, c.high, c.tolerance, c.veto) for i, c in enumerate(policy.criteria)]
    wanted = small(evidence.sparkSession, rows, "position int, criterion_key string, metric string, way string, low double, high double, tolerance double, veto boolean")
    proof = {"as_of": "timestamp_ntz", "snapshot": "string", "entities": "string"}
    for name, kind in proof.items():
        if name not in evidence.columns:
            evidence = evidence.withColumn(name, F.lit(None).cast(kind))
    one = evidence.groupBy("model", "metric").agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in proof])
    sides = [one.where(F.col("model") == m).select("metric", F.when(F.col("n") == 1, F.col("value")).alias(f"{name}_value"), *[F.col(c).alias(f"{name}_{c}") for c in proof]) for m, name in ((policy.champion, "champion"), (policy.challenger, "challenger"))]
    joined = F.broadcast(wanted).join(sides[0], "metric", "left").join(sides[1], "metric", "left")
    unproved = F.lit(None).cast("string")
    if policy.require_alignment:
        unproved = F.when(~F.coalesce(F.col("champion_entities") == F.col("challenger_entities"), F.lit(False)), "alignment_unverified").otherwise(unproved)
    if policy.require_snapshot:
        unproved = F.when(~F.coalesce(F.col("champion_snapshot") == F.col("challenger_snapshot"), F.lit(False)), "snapshot_unverified").otherwise(unproved)
    if policy.evaluation_time is not None:
        at = F.lit(policy.evaluation_time).cast("timestamp_ntz")
        late = [~F.coalesce(F.col(f"{m}_as_of") <= at, F.lit(False)) for m in ("champion", "challenger")]
        unproved = F.when(late[0] | late[1], "time_unverified").otherwise(unproved)

    def worth(v: Column) -> Column:
        distance = F.greatest(F.lit(0.0), F.col("low") - v, v - F.col("high"))
        return F.when(F.col("way") == "higher", v).when(F.col("way") == "lower", -v).otherwise(-distance)

    gain = F.when(unproved.isNull(), worth(F.col("challenger_value")) - worth(F.col("champion_value")))
    winner = F.when(gain.isNull(), F.lit(None)).when(F.abs(gain) <= F.col("tolerance"), "tie").when(gain > 0, "challenger").otherwise("champion")
    return joined.select("position", "criterion_key", "metric", "champion_value", "challenger_value", gain.alias("gain"), winner.alias("winner"), "veto", F.when(gain.isNull(), "not_verifiable").otherwise("available").alias("status"), F.when(unproved.isNotNull(), unproved).when(gain.isNull(), "missing_evidence").otherwise("computed").alias("reason"))


def recommend(comparison: DataFrame) -> DataFrame:
    """(recommendation, counts): a veto first, then missing evidence, mixed results, ties, and the winner."""
    counts = comparison.agg(F.count(F.lit(1)).alias("criteria"), F.count_if(F.col("winner") == "challenger").alias("challenger_wins"), F.count_if(F.col("winner") == "champion").alias("champion_wins"), F.count_if(F.col("winner") == "tie").alias("ties"), F.count_if(F.col("winner").isNull()).alias("unverified"), F.count_if(F.col("veto") & (F.col("winner") == "champion")).alias("vetoes"))
    choice = (
        F.when(F.col("vetoes") > 0, "reject_challenger").when(F.col("unverified") > 0, "insufficient_evidence").when((F.col("challenger_wins") > 0) & (F.col("champion_wins") > 0), "continue_evaluation")
        .when(F.col("ties") == F.col("criteria"), "retain_champion").when(F.col("challenger_wins") > 0, "promote_challenger").otherwise("retain_champion")
    )
    return counts.select(choice.alias("recommendation"), "criteria", "challenger_wins", "champion_wins", "ties", "unverified", "vetoes")


def evidence_of(model: str, table: DataFrame, names: Sequence[str]) -> DataFrame:
    """(model, metric, value) from a wide table of one row."""
    return table.select(F.lit(model).alias("model"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


@dataclass(frozen=True)
class Declared:
    """What a model's owner says of it: an explanation or an attribution of a feature, or a fact."""

    model: str
    kind: str  # explanation, attribution or metadata
    key: str
    value: float | None = None
    text: str | None = None
    as_of: dt.datetime | None = None


@dataclass(frozen=True)
class GovernanceResult:
    policy: GovernancePolicy
    candidates: DataFrame
    evidence: DataFrame
    comparison: DataFrame
    recommendation: DataFrame
    drift: DataFrame | None
    stability: DataFrame | None
    explanations: DataFrame
    attributions: DataFrame
    metadata: DataFrame
    provenance: DataFrame


_DECLARED = "model string, key string, value double, text string, as_of timestamp_ntz"


def declared(spark: SparkSession, facts: Sequence[Declared], kind: str, policy: GovernancePolicy) -> DataFrame:
    """The facts of one kind: of the two models only, each key once a model, numbers finite, none from later than the evaluation."""
    own = [f for f in facts if f.kind == kind]
    for f in own:
        if f.model not in (policy.champion, policy.challenger):
            raise ValueError("unknown_candidate")
        if f.value is not None and not math.isfinite(f.value) or kind == "attribution" and f.value is None or f.value is None and f.text is None:
            raise ValueError("invalid_declared_value")
        if policy.evaluation_time is not None and f.as_of is not None and f.as_of > policy.evaluation_time:
            raise ValueError("declared_after_evaluation")
    if len({(f.model, f.key) for f in own}) != len(own):
        raise ValueError("duplicate_declared_key")
    return small(spark, [(f.model, f.key, f.value, f.text, f.as_of) for f in own], _DECLARED)


def drift_table(reference: DataFrame, current: DataFrame, probability: str, bins: int = 10, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(reference_rows, current_rows, total_variation, deviation, standardised): the deviation is that of samples
    of the current size from the reference's bins."""
    table = total_variation(reference, current, probability, bins)
    counts = [r["n"] for r in prediction_bins(reference, F.col(probability), bins).orderBy("bin").collect()]  # ten rows
    one = table.first()
    there = one is not None and one["reference_rows"] and one["current_rows"]
    deviation = drift_deviation(counts, one["current_rows"], draws, seed) if there else None
    d = F.lit(deviation).cast("double")
    return table.select("*", d.alias("deviation"), F.when(d > 0, F.col("total_variation") / d).alias("standardised"))


def evaluate_governance(
    policy: GovernancePolicy,
    evidence: DataFrame | None = None,
    *,
    refs: Sequence[EvidenceRef] = (),
    tables: Mapping[str, DataFrame] | None = None,
    periods: tuple[DataFrame, DataFrame] | None = None,
    label: Column | None = None,
    probability: str | None = None,
    facts: Sequence[Declared] = (),
) -> GovernanceResult:
    """Ten tables.  Evidence is given as (model, metric, value), or found by ``refs`` in ``tables``; ``periods`` are the
    reference and current rows with label and probability, for drift and stability."""
    if (evidence is None) == (not refs):
        raise ValueError("either evidence or references to it")
    if evidence is None:
        evidence = resolve(refs, tables or {})
    spark = evidence.sparkSession
    comparison = compare(evidence, policy)
    drift = steady = None
    if periods is not None and probability is not None:
        drift = drift_table(*periods, probability)
        if label is not None:
            steady = stability(*periods, label, F.col(probability)).crossJoin(F.broadcast(brier_deviation(periods[0], label, F.col(probability)).select(F.col("deviation"))))  # one row
    body = json.dumps(asdict(policy), sort_keys=True, separators=(",", ":"), default=str)
    origins = [("policy", None, hashlib.sha256(body.encode()).hexdigest())] + [(r.table, f"{r.model}.{r.metric}", hashlib.sha256(json.dumps(asdict(r), sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()) for r in refs]
    return GovernanceResult(
        policy, small(spark, [(policy.champion, "champion"), (policy.challenger, "challenger")], "model string, role string"), evidence, comparison, recommend(comparison), drift, steady, declared(spark, facts, "explanation", policy), declared(spark, facts, "attribution", policy),
        declared(spark, facts, "metadata", policy), small(spark, origins, "source string, about string, fingerprint string"),
    )
