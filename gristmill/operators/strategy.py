"""Decision strategies: rules over rows by one fold expression, then summaries by grouping sets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..plans.conditions import Condition, compile_condition
from .strategy_tables import CONSTRAINT_METRICS, action_summary, business_summary, constraints, rule_summary

# Phases, roles of actions, and constraint operators.
PHASES = ("eligibility", "decision")
ROLES = ("selected", "limited", "rejected", "review", "request_information", "other")


@dataclass(frozen=True)
class DecisionRule:
    rule_key: str
    phase: str
    priority: int
    condition: Condition
    action_name: str
    stop_on_hit: bool = True
    enabled: bool = True
    effective_from: dt.datetime | None = None
    expires_at: dt.datetime | None = None


@dataclass(frozen=True)
class DecisionConstraint:
    constraint_key: str
    metric: str
    operator: str
    threshold: float
    action_name: str | None = None
    minimum_support: int = 1


@dataclass(frozen=True)
class DecisionStrategyConfig:
    strategy_key: str
    strategy_version: str
    effective_from: dt.datetime
    evaluation_time: dt.datetime
    rules: tuple[DecisionRule, ...]
    default_action_name: str
    unknown_action_name: str
    action_roles: tuple[tuple[str, str], ...]
    expires_at: dt.datetime | None = None
    constraints: tuple[DecisionConstraint, ...] = ()
    historical_action_column: str | None = None
    historical_action_mapping: tuple[tuple[object, str], ...] = ()
    outcome_column: str | None = None
    probability_column: str | None = None
    exposure_column: str | None = None
    #: a number for all rows, or a column
    loss_fraction: float | str | None = None
    #: (action, value, cost) of a row with that action
    action_assumptions: tuple[tuple[str, float, float], ...] = ()
    score_column: str | None = None
    observed_loss_column: str | None = None
    segment_columns: tuple[str, ...] = ()
    time_slice_column: str | None = None
    #: what a document says besides, carried along
    metadata: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        actions = {a for a, _ in self.action_roles}
        if any(r not in ROLES for _, r in self.action_roles):
            raise ValueError("invalid_action_role")
        if len({r.rule_key for r in self.rules}) != len(self.rules):
            raise ValueError("duplicate_rule_key")
        for r in self.rules:
            if r.phase not in PHASES:
                raise ValueError("invalid_phase")
            if r.action_name not in actions:
                raise ValueError("unknown_action")
        if not {self.default_action_name, self.unknown_action_name} <= actions:
            raise ValueError("unknown_action")
        if self.action_assumptions and {a for a, _, _ in self.action_assumptions} != actions:
            raise ValueError("action_assumptions must cover every action once")
        if isinstance(self.loss_fraction, float) and not 0 <= self.loss_fraction <= 1:
            raise ValueError("loss_fraction lies between 0 and 1")
        for c in self.constraints:
            if c.metric not in CONSTRAINT_METRICS or c.operator not in ("le", "ge"):
                raise ValueError("invalid_constraint")
            if (c.action_name is not None) != c.metric.startswith("action_") or c.action_name is not None and c.action_name not in actions:
                raise ValueError("invalid_constraint")

    @property
    def active(self) -> bool:
        return self.effective_from <= self.evaluation_time and (self.expires_at is None or self.evaluation_time < self.expires_at)

    def active_rules(self) -> list[DecisionRule]:
        """Enabled rules in their window, eligibility first, then by priority and key; known without data."""
        at = self.evaluation_time
        held = [r for r in self.rules if r.enabled and (r.effective_from or self.effective_from) <= at and (r.expires_at is None or at < r.expires_at)]
        return sorted(held, key=lambda r: (PHASES.index(r.phase), r.priority, r.rule_key))


_STATE = "struct<open:boolean,terminal:boolean,base:string,final:string,applied:string,matched:int,unknown:int,overlap:int,conflict:int,path:array<struct<rule_key:string,path_status:string,is_applied:boolean,is_overlap:boolean,is_conflict:boolean>>>"


def _fold(config: DecisionStrategyConfig, rules: Column) -> Column:
    """The state after all rules; see DecisionRule for an element of ``rules`` (with its truth)."""
    start = F.from_json(F.lit('{"open":true,"terminal":false,"matched":0,"unknown":0,"overlap":0,"conflict":0,"path":[]}'), _STATE)
    other = F.lit(config.unknown_action_name)

    def step(s: Column, r: Column) -> Column:
        skipped = ~r["eligibility"] & s["terminal"]
        true, unknown = r["truth"].eqNullSafe(True), r["truth"].isNull()
        reached = ~skipped & s["open"]
        first = reached & true & s["base"].isNull()
        again = reached & true & s["base"].isNotNull()
        conflict = again & (r["action"] != s["base"])
        lost = reached & unknown
        overlap = (~skipped & ~s["open"] & true) | again
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(
            (s["open"] & ~(lost | conflict | ((first | again) & r["stop"]))).alias("open"),
            (s["terminal"] | (r["eligibility"] & (lost | first))).alias("terminal"),
            F.when(first, r["action"]).otherwise(s["base"]).alias("base"),
            F.when(lost | conflict, other).when(first, r["action"]).otherwise(s["final"]).alias("final"),
            F.when(first, r["key"]).otherwise(s["applied"]).alias("applied"),
            (s["matched"] + one(~skipped & true)).alias("matched"),
            (s["unknown"] + one(~skipped & unknown)).alias("unknown"),
            (s["overlap"] + one(overlap)).alias("overlap"),
            (s["conflict"] + one(conflict)).alias("conflict"),
            F.concat(
                s["path"],
                F.array(F.struct(r["key"].alias("rule_key"), F.when(reached, "evaluated").otherwise("not_evaluated").alias("path_status"), first.alias("is_applied"), overlap.alias("is_overlap"), conflict.alias("is_conflict"))),
            ).alias("path"),
        )

    return F.aggregate(rules, start, lambda s, r: step(s, r).cast(_STATE))


def _without(config: DecisionStrategyConfig, rules: Column, key: str) -> Column:
    """The final action when rule ``key`` is left out; the decision phase starts open here."""
    kind = "struct<open:boolean,phase:boolean,terminal:boolean,base:string,final:string>"
    start = F.from_json(F.lit('{"open":true,"phase":true,"terminal":false}'), kind)

    def step(s: Column, r: Column) -> Column:
        opened = F.when(s["phase"] != r["eligibility"], F.lit(True)).otherwise(s["open"])
        reached = (r["eligibility"] | ~s["terminal"]) & opened
        true = r["truth"].eqNullSafe(True)
        first, again = reached & true & s["base"].isNull(), reached & true & s["base"].isNotNull()
        lost, conflict = reached & r["truth"].isNull(), again & (r["action"] != s["base"])
        return F.struct(
            (opened & ~(lost | conflict | ((first | again) & r["stop"]))).alias("open"), r["eligibility"].alias("phase"), (s["terminal"] | (r["eligibility"] & (lost | first))).alias("terminal"),
            F.when(first, r["action"]).otherwise(s["base"]).alias("base"), F.when(lost | conflict, F.lit(config.unknown_action_name)).when(first, r["action"]).otherwise(s["final"]).alias("final"),
        ).cast(kind)

    return F.coalesce(F.aggregate(F.filter(rules, lambda r: r["key"] != key), start, step)["final"], F.lit(config.default_action_name))


def decide(df: DataFrame, config: DecisionStrategyConfig, *, leave_one_out: bool = False) -> DataFrame:
    """``df`` with the decision columns; one projection, no shuffle and no Python."""
    if not config.active:
        names = {"decision_status": "inactive", "decision_reason": "strategy_inactive"}
        out = df.withColumns({k: F.lit(v) for k, v in names.items()} | {k: F.lit(None).cast("string") for k in ("base_action_name", "final_action_name", "applied_rule_key")})
        return out.withColumns({k: F.lit(0) for k in ("matched_rule_count", "unknown_rule_count", "overlap_rule_count", "conflict_rule_count")})
    rules = config.active_rules()
    verdicts = [compile_condition(r.condition, df) for r in rules]
    elements = [F.struct(F.lit(r.rule_key).alias("key"), F.lit(r.phase == "eligibility").alias("eligibility"), F.lit(r.action_name).alias("action"), F.lit(r.stop_on_hit).alias("stop"), v.truth.alias("truth"), v.status.alias("status"), v.reason.alias("reason")) for r, v in zip(rules, verdicts, strict=True)]
    kind = "array<struct<key:string,eligibility:boolean,action:string,stop:boolean,truth:boolean,status:string,reason:string>>"
    out = df.withColumn("_rules", (F.array(*elements) if elements else F.array()).cast(kind))
    out = out.withColumn("_state", _fold(config, F.col("_rules")))
    s = F.col("_state")
    reason = F.when(s["final"].isNull(), "default_action_applied").when(s["conflict"] > 0, "rule_conflict").when(s["unknown"] > 0, "unknown_condition").otherwise("computed")
    out = out.withColumns(
        {
            "decision_status": F.lit("available"), "decision_reason": reason, "base_action_name": s["base"], "final_action_name": F.coalesce(s["final"], F.lit(config.default_action_name)),
            "applied_rule_key": s["applied"], "matched_rule_count": s["matched"], "unknown_rule_count": s["unknown"], "overlap_rule_count": s["overlap"], "conflict_rule_count": s["conflict"],
        }
    )
    if leave_one_out:
        cells = [F.struct(F.lit(r.rule_key).alias("rule_key"), _without(config, F.col("_rules"), r.rule_key).alias("action")) for r in rules]
        out = out.withColumn("_without", F.array(*cells))
    return out


def row_decisions(decided: DataFrame, keep: Sequence[str]) -> DataFrame:
    return decided.select(*keep, "decision_status", "decision_reason", "base_action_name", "final_action_name", "applied_rule_key", "matched_rule_count", "unknown_rule_count", "overlap_rule_count", "conflict_rule_count")


def rule_evaluations(decided: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A row for each row and active rule, in the rules' order."""
    zipped = decided.select(*keep, F.posexplode(F.arrays_zip(F.col("_state.path").alias("p"), F.col("_rules").alias("r"))).alias("rule_order", "_z"))
    return zipped.select(*keep, F.col("_z.p.rule_key").alias("rule_key"), "rule_order", F.col("_z.p.path_status").alias("path_status"), F.when(F.col("_z.r.truth").isNull(), "unknown").when(F.col("_z.r.truth"), "true").otherwise("false").alias("truth"), F.col("_z.r.status").alias("status"), F.col("_z.r.reason").alias("reason"), F.col("_z.p.is_applied").alias("is_applied"), F.col("_z.p.is_overlap").alias("is_overlap"), F.col("_z.p.is_conflict").alias("is_conflict"))


def leave_one_out(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """(rule_key, rows, changed_actions, changed_rate): rows whose action differs without the rule."""
    rows = decided.select("final_action_name", F.explode("_without").alias("_w")).groupBy(F.col("_w.rule_key").alias("rule_key"))
    out = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_w.action") != F.col("final_action_name")).alias("changed_actions"))
    return out.withColumn("changed_rate", ratio(F.col("changed_actions"), F.col("rows")))


def with_baseline(summary: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Scoped metrics with the overall value and the difference from it."""
    base = summary.where("scope = 'overall'").select(*[F.col(c).alias(f"_{c}") for c in labels], F.col("metric").alias("_metric"), F.col("value").alias("overall_baseline"))
    on = [F.col("metric") == F.col("_metric"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in labels]]
    return summary.where("scope <> 'overall'").join(F.broadcast(base), on, "left").drop("_metric", *[f"_{c}" for c in labels]).withColumn("absolute_delta", F.col("value") - F.col("overall_baseline"))


def transitions(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """(historical_action, final_action, rows, rate, status, reason); rows outside the mapping are one row without actions."""
    mapping = F.create_map(*[F.lit(x) for k, v in config.historical_action_mapping for x in (str(k), v)])
    old = mapping[F.col(config.historical_action_column).cast("string")]
    known = old.isNotNull() & F.col("final_action_name").isNotNull()
    counted = decided.groupBy(F.when(known, old).alias("historical_action"), F.when(known, F.col("final_action_name")).alias("final_action")).agg(F.count(F.lit(1)).alias("rows"))
    total = counted.agg(F.sum("rows").alias("total"))
    lost = F.col("historical_action").isNull()
    return counted.crossJoin(F.broadcast(total)).select(  # one row
        "historical_action", "final_action", "rows", ratio(F.col("rows"), F.col("total")).alias("rate"),
        F.when(lost, "not_verifiable").otherwise("available").alias("status"), F.when(lost, "historical_action_unmapped").otherwise("computed").alias("reason"),
    )


@dataclass(frozen=True)
class DecisionStrategyResult:
    config: DecisionStrategyConfig
    row_decisions: DataFrame
    rule_evaluations: DataFrame
    rule_summary: DataFrame
    leave_one_out: DataFrame
    action_summary: DataFrame
    business_summary: DataFrame
    constraints: DataFrame | None
    transitions: DataFrame | None


def simulate_decision_strategy(df: DataFrame, config: DecisionStrategyConfig, *, keep: Sequence[str] = ()) -> DecisionStrategyResult:
    decided = decide(df, config, leave_one_out=True)
    return DecisionStrategyResult(
        config, row_decisions(decided, keep), rule_evaluations(decided, keep), rule_summary(decided, config), leave_one_out(decided, config), action_summary(decided, config), business_summary(decided, config),
        constraints(decided, config) if config.constraints else None, transitions(decided, config) if config.historical_action_column else None,
    )
