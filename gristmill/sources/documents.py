"""Policies and warning scenarios from closed, versioned JSON documents."""

from __future__ import annotations

import datetime as dt
import json
from pathlib import Path

from ..operators.lifecycle import SIGNALS, LifecycleConfig, LifecycleState, WarningRule, WarningScenario, signal_name
from ..operators.strategy import DecisionConstraint, DecisionRule, DecisionStrategyConfig
from ..plans.conditions import OPERATORS, Condition

# Document versions, budgets and score directions.
DIRECTIONS = ("higher_risk", "lower_risk")
POLICY, WARNING = "task20.policy.v1", "task20.warning.v1"
MAX_BYTES, MAX_DEPTH = 5_000_000, 16


class DocumentError(ValueError):
    """A document that breaks its format; the message says where."""


def parse(source: str | bytes | Path) -> dict:
    """One JSON object: no duplicate keys, no special numbers, within the budgets."""
    raw = Path(source).read_bytes() if isinstance(source, Path) else source.encode() if isinstance(source, str) else source
    if len(raw) > MAX_BYTES:
        raise DocumentError("document_too_large")

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) != len(items):
            raise DocumentError("duplicate_key")
        return dict(items)

    def refuse(text: str) -> object:
        raise DocumentError(f"invalid_number: {text}")

    try:
        out = json.loads(raw.decode("utf-8"), object_pairs_hook=pairs, parse_constant=refuse)
    except (UnicodeDecodeError, json.JSONDecodeError) as error:
        raise DocumentError("invalid_json") from error
    if not isinstance(out, dict):
        raise DocumentError("not_an_object")
    _depth(out, 1)
    return out


def _depth(value: object, depth: int) -> None:
    if depth > MAX_DEPTH:
        raise DocumentError("document_too_deep")
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _depth(child, depth + 1)


def _only(data: dict, required: set[str], optional: set[str] = frozenset()) -> dict:
    if missing := required - data.keys():
        raise DocumentError(f"missing_field: {sorted(missing)[0]}")
    if extra := data.keys() - required - optional:
        raise DocumentError(f"unknown_field: {sorted(extra)[0]}")
    return data


def moment(text: object) -> dt.datetime:
    try:
        return dt.datetime.fromisoformat(text)
    except (TypeError, ValueError) as error:
        raise DocumentError("invalid_datetime") from error


def span(microseconds: object) -> dt.timedelta:
    if isinstance(microseconds, bool) or not isinstance(microseconds, int) or microseconds < 0:
        raise DocumentError("invalid_duration")
    return dt.timedelta(microseconds=microseconds)


def condition(data: dict, score: str | None = None, probability: str | None = None) -> Condition:
    """A condition node; a left side that is not a column names a score, or a signal derived from a column
    over a window (``history`` where none is given).  A signal without a column is the run's own feature's."""
    _only(data, {"kind"}, {"operator", "left_kind", "left", "right_kind", "right", "window", "children"})
    children = tuple(condition(c, score, probability) for c in data.get("children") or ())
    kind, window = data["kind"], data.get("window")
    if kind != "atomic":
        if any(data.get(f) is not None for f in ("operator", "left_kind", "left", "right_kind", "right", "window")):
            raise DocumentError("invalid_condition_shape")
        return Condition(kind, children=children)
    if children or data.get("operator") not in OPERATORS:
        raise DocumentError("unknown_operator")
    left_kind, column = data.get("left_kind"), data.get("left")
    if window not in (None, "history", "recent") or window is not None and (left_kind not in SIGNALS or left_kind == "peer_deviation"):
        raise DocumentError("invalid_window")
    if left_kind in SIGNALS:
        if column is None and (window == "recent" or left_kind == "peer_deviation"):
            raise DocumentError("invalid_left_operand")
        left = left_kind if column is None else signal_name(left_kind, column, window or "history")
    else:
        left = {"column": column, "ranking_score": score, "event_probability": probability}.get(left_kind)
    if left is None:
        raise DocumentError("invalid_left_operand")
    right = data.get("right")
    return Condition("atomic", data["operator"], left, tuple(right) if isinstance(right, list) else right, data.get("right_kind") or "literal")


def _unset(data: dict, *names: str) -> None:
    """Fields of the format that this engine doesn't carry out are refused, not passed over."""
    for name in names:
        if data.get(name) not in (None, [], False):
            raise DocumentError(f"unsupported_field: {name}")


def _direction(data: dict) -> None:
    if data.get("ranking_score_direction") not in (None, *DIRECTIONS):
        raise DocumentError("invalid_direction")
    if data.get("ranking_score_direction") == "lower_risk":
        raise DocumentError("unsupported_field: ranking_score_direction")  # a caller turns such scores first


def _optional_moment(data: dict, name: str) -> dt.datetime | None:
    return None if data.get(name) is None else moment(data[name])


# Required and optional fields of rules and policies.
_RULE = ({"rule_key", "phase", "priority", "condition", "action_name"}, {"stop_on_hit", "enabled", "effective_from", "expires_at", "description_key"})
_POLICY = (
    {"schema_version", "strategy_key", "strategy_version", "effective_from", "expires_at", "evaluation_time", "rules", "default_action_name", "unknown_action_name", "action_role_mapping"},
    {"constraints", "ranking_score_column", "ranking_score_direction", "historical_action_column", "historical_action_mapping", "historical_policy_version", "exposure_column", "loss_fraction", "action_assumptions", "exposure_unit", "segment_columns", "time_slice_column"},
)


def load_policy_json(source: str | bytes | Path, *, outcome_column: str | None = None, probability_column: str | None = None) -> DecisionStrategyConfig:
    """A strategy; the columns with outcomes and probabilities are not part of a document."""
    data = parse(source)
    if data.get("schema_version") != POLICY:
        raise DocumentError("unsupported_version")
    _only(data, *_POLICY)
    _direction(data)
    score = data.get("ranking_score_column")
    rules = []
    for r in data["rules"]:
        _only(r, *_RULE)
        rules.append(DecisionRule(r["rule_key"], r["phase"], r["priority"], condition(r["condition"], score, probability_column), r["action_name"], r.get("stop_on_hit", True), r.get("enabled", True), _optional_moment(r, "effective_from"), _optional_moment(r, "expires_at")))
    limits = []
    for c in data.get("constraints") or ():
        _only(c, {"constraint_key", "metric", "operator", "threshold"}, {"action_name", "action_role", "minimum_support"})
        _unset(c, "action_role")
        limits.append(DecisionConstraint(c["constraint_key"], c["metric"], c["operator"], float(c["threshold"]), c.get("action_name"), c.get("minimum_support", 1)))
    pairs = lambda name: tuple(map(tuple, data.get(name) or ()))
    return DecisionStrategyConfig(
        data["strategy_key"], data["strategy_version"], moment(data["effective_from"]), moment(data["evaluation_time"]), tuple(rules), data["default_action_name"], data["unknown_action_name"], pairs("action_role_mapping"), _optional_moment(data, "expires_at"),
        tuple(limits), data.get("historical_action_column"), pairs("historical_action_mapping"), outcome_column, probability_column, data.get("exposure_column"), data.get("loss_fraction"), tuple((a, float(v), float(c)) for a, v, c in data.get("action_assumptions") or ()), score,
        segment_columns=tuple(data.get("segment_columns") or ()), time_slice_column=data.get("time_slice_column"), metadata=tuple((k, str(data[k])) for k in ("historical_policy_version", "exposure_unit") if data.get(k) is not None),
    )


def scenarios(data: list, score: str | None = None, probability: str | None = None) -> tuple[WarningScenario, ...]:
    out = []
    for s in data:
        _only(s, {"scenario_key", "scenario_kind", "rules"})
        rules = []
        for r in s["rules"]:
            _only(r, {"rule_key", "priority", "alert_level", "condition"}, {"persistence_observations", "resolution_observations", "cooldown", "enabled", "effective_from", "expires_at", "description_key"})
            rules.append(WarningRule(r["rule_key"], r["priority"], r["alert_level"], condition(r["condition"], score, probability), r.get("persistence_observations", 1), r.get("resolution_observations", 1), span(r.get("cooldown", 0)), r.get("enabled", True), _optional_moment(r, "effective_from"), _optional_moment(r, "expires_at")))
        out.append(WarningScenario(s["scenario_key"], s["scenario_kind"], tuple(rules)))
    return tuple(out)


# Required and optional fields of warning documents.
_WARNING = (
    {"schema_version", "analysis_as_of", "entity_column", "observation_time_column", "condition_feature_columns", "scenarios", "reference_scenario_key", "alert_level_ranks", "states", "default_state_key", "unknown_state_key"},
    {"monitoring_key", "monitoring_version", "available_time_column", "event_time_column", "positive_event_key", "prediction_horizon", "horizon_end_inclusive", "recent_window", "history_window", "history_start_inclusive", "expected_observation_interval", "period_unit", "time_zone", "allowed_transitions", "adverse_state_keys", "cure_state_keys", "cohort_time_column", "cohort_column", "peer_group_columns", "peer_reference_start", "peer_reference_end", "ranking_score_column", "ranking_score_direction", "exposure_column", "loss_fraction", "observed_loss_column", "observed_loss_available_time_column", "observed_loss_is_mature_snapshot", "segment_columns", "time_frequency"},
)


def load_warning_json(source: str | bytes | Path, *, key: str, probability_column: str | None = None) -> LifecycleConfig:
    """A monitoring run.  ``key`` is the column that orders rows of one time, as Spark tables have no row order.

    Conditions may refer to the feature columns, to signals derived from any of them over either window,
    and to the score columns.
    """
    data = parse(source)
    if data.get("schema_version") != WARNING:
        raise DocumentError("unsupported_version")
    _only(data, *_WARNING)
    features = tuple(data["condition_feature_columns"])
    if not features or len(set(features)) != len(features):
        raise DocumentError("invalid_features")
    _direction(data)
    _unset(data, "cohort_time_column", "cohort_column", "observed_loss_available_time_column", "observed_loss_is_mature_snapshot", "positive_event_key")
    if data.get("time_zone") not in (None, "UTC") or data.get("time_frequency") not in (None, "month"):
        raise DocumentError("unsupported_field: time_zone or time_frequency")
    score = data.get("ranking_score_column")
    states = []
    for s in data["states"]:
        _only(s, {"state_key", "state_rank", "priority", "condition"}, {"terminal", "enabled", "description_key"})
        states.append(LifecycleState(s["state_key"], s["state_rank"], s["priority"], condition(s["condition"], score, probability_column), s.get("terminal", False), s.get("enabled", True)))
    names = lambda field: tuple(data.get(field) or ())
    interval, horizon = data.get("expected_observation_interval"), data.get("prediction_horizon")
    return LifecycleConfig(
        moment(data["analysis_as_of"]), data["entity_column"], data["observation_time_column"], key, features[0], scenarios(data["scenarios"], score, probability_column), data["reference_scenario_key"], tuple(map(tuple, data["alert_level_ranks"])), tuple(states), data["default_state_key"], data["unknown_state_key"],
        tuple(map(tuple, names("allowed_transitions"))), names("adverse_state_keys"), names("cure_state_keys"), span(horizon) if horizon is not None else dt.timedelta(days=7), data.get("horizon_end_inclusive", False), span(data.get("history_window", 604_800_000_000)), data.get("history_start_inclusive", True),
        None if interval is None else span(interval), data.get("event_time_column"), names("segment_columns"), data.get("period_unit", "month"), features[1:], None if data.get("recent_window") is None else span(data["recent_window"]), data.get("available_time_column"), names("peer_group_columns"),
        _optional_moment(data, "peer_reference_start"), _optional_moment(data, "peer_reference_end"), data.get("exposure_column"), probability_column, data.get("loss_fraction"), data.get("observed_loss_column"),
    )


def load_v02_json(policy: str | bytes | Path | None = None, warning: str | bytes | Path | None = None, *, key: str | None = None, **columns: str | None) -> tuple[DecisionStrategyConfig | None, LifecycleConfig | None]:
    """A policy, a warning document or both; the policy is read first.  A warning document needs ``key``."""
    if policy is None and warning is None:
        raise DocumentError("no_document")
    strategy = load_policy_json(policy, **columns) if policy is not None else None
    if warning is None:
        return strategy, None
    if key is None:
        raise DocumentError("no_key")
    return strategy, load_warning_json(warning, key=key, probability_column=columns.get("probability_column"))
