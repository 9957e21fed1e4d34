"""Summaries of decided rows: by rule, by action, by role of the action, and constraints.

Every table is one aggregate over the decided rows, by scope through grouping sets; groups are
conditions of that aggregate, so actions and roles that nothing falls to have their rows as well.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.measures import absent, amount, first_of, measured, rate
from ..plans.scopes import scoped

if TYPE_CHECKING:
    from .strategy import DecisionStrategyConfig

# Metrics of rules, actions, roles and constraints.
RULE_METRICS = (
    "evaluated_count", "hit_count", "hit_rate", "unknown_count", "unknown_rate", "not_evaluated_count", "applied_count", "sole_hit_count", "overlap_count", "overlap_rate", "conflict_count",
    "incremental_action_count", "leave_one_out_changed_action_count", "captured_event_count", "target_capture_rate",
)
ACTION_METRICS = (
    "action_count", "action_rate", "evaluable_event_count", "event_count", "event_rate", "exposure_sum", "expected_loss_sum", "assumption_based_observed_event_loss_sum", "assumed_action_value_sum",
    "assumed_action_cost_sum", "assumption_based_payoff_sum",
)
BUSINESS_METRICS = (
    "row_count", "decided_rate", "ranking_score_mean", "ranking_score_min", "ranking_score_max", "event_probability_mean", "event_probability_min", "event_probability_max", "observed_event_count",
    "observed_event_rate", "selected_rate", "rejected_rate", "review_capacity_rate", "unknown_action_rate", "exposure_sum", "expected_loss_sum", "expected_loss_rate",
    "assumption_based_observed_event_loss_sum", "actual_observed_loss_sum", "actual_observed_loss_rate", "assumed_action_value_sum", "assumed_action_cost_sum", "assumption_based_payoff_sum",
    "selected_event_rate", "historical_mapped_rate",
)
CONSTRAINT_METRICS = (
    "action_count", "action_rate", "selected_rate", "rejected_rate", "review_count", "review_rate", "request_information_rate", "selected_exposure_sum", "expected_loss_sum", "expected_loss_rate",
    "observed_loss_sum", "observed_loss_rate", "selected_event_rate",
)
#: Roles of the business summary with the actions' roles that they take in.
GROUPS = {"selected": ("selected", "limited"), "rejected": ("rejected",), "review": ("review", "request_information")}

NOT_ASKED = "source_not_requested"


def _number(name: str | None) -> Column:
    """A finite number, or null."""
    if name is None:
        return F.lit(None).cast("double")
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sets_of(config: DecisionStrategyConfig) -> tuple[list[str], list[list[str]]]:
    segments, time = list(config.segment_columns), config.time_slice_column
    keys = segments + ([time] if time else [])
    sets = [[], *[[s] for s in segments]]
    if time:
        sets += [[time], *[[s, time] for s in segments]]
    return keys, sets


def evidence(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """``decided`` with _score, _p, _y, _x (exposure), _el and _ol (expected and observed event loss), assumed
    _value, _cost and _payoff, _loss, _role and _mapped; what is unknown is null."""
    share = _number(config.loss_fraction) if isinstance(config.loss_fraction, str) else F.lit(config.loss_fraction).cast("double")
    final = F.col("final_action_name")
    pick = lambda pairs: F.create_map(*[F.lit(x) for pair in pairs for x in pair])[final] if pairs else F.lit(None)
    mapped = F.lit(False)
    if config.historical_action_column is not None and config.historical_action_mapping:
        mapped = F.col(f"`{config.historical_action_column}`").cast("string").isin(*[str(k) for k, _ in config.historical_action_mapping]) & final.isNotNull()
    out = decided.withColumns(
        {
            "_score": _number(config.score_column or config.probability_column), "_p": _number(config.probability_column), "_y": _number(config.outcome_column), "_x": _number(config.exposure_column), "_l": share,
            "_loss": _number(config.observed_loss_column), "_role": pick(config.action_roles).cast("string"), "_mapped": F.coalesce(mapped, F.lit(False)),
            "_value": pick([(a, float(v)) for a, v, _ in config.action_assumptions]).cast("double"), "_cost": pick([(a, float(c)) for a, _, c in config.action_assumptions]).cast("double"),
        }
    )
    return out.withColumns({"_el": F.col("_p") * F.col("_x") * F.col("_l"), "_ol": F.col("_y") * F.col("_x") * F.col("_l")}).withColumn("_payoff", F.col("_value") - F.col("_cost") - F.col("_el"))


def rule_summary(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """15 metrics by scope and rule.  Hits include rows where the rule was not reached; inactive rules have no values.

    ``decided`` comes from ``decide`` with ``leave_one_out``.
    """
    keys, sets = sets_of(config)
    roles = dict(config.action_roles)
    active = {r.rule_key for r in config.active_rules()} if config.active else set()
    rows = evidence(decided, config)
    if active:
        zipped = F.arrays_zip(F.col("_state.path").alias("p"), F.col("_rules").alias("r"), F.col("_without").alias("w"))
        rows = rows.select(*keys, "_y", "matched_rule_count", "final_action_name", F.explode(zipped).alias("z"))
        rows = rows.select(*keys, "_y", "matched_rule_count", "final_action_name", F.col("z.p.rule_key").alias("rule_key"), F.col("z.p").alias("p"), F.col("z.r.truth").alias("truth"), F.col("z.w.action").alias("other"))
        true, unknown = F.col("truth").eqNullSafe(True), F.col("truth").isNull()
        flag = lambda n: F.count_if(F.col(f"p.{n}"))
        reached = F.col("p.path_status") == "evaluated"
        cells = {
            "n": F.count(F.lit(1)), "evaluated": F.count_if(reached), "hit": F.count_if(true), "unknown": F.count_if(unknown), "skipped": F.count_if(~reached), "applied": flag("is_applied"),
            "sole": F.count_if(true & (F.col("matched_rule_count") == 1)), "overlap": flag("is_overlap"), "conflict": flag("is_conflict"), "changed": F.count_if(~F.col("other").eqNullSafe(F.col("final_action_name"))),
            "mature": F.count("_y"), "positive": F.count_if(F.col("_y") == 1), "captured": F.count_if((F.col("_y") == 1) & true),
        }
        wide = scoped(rows, [*keys, "rule_key"], [[*s, "rule_key"] for s in sets], cells)
        wide = wide.withColumn("scope", F.regexp_replace("scope", r"\*?rule_key$", "")).withColumn("scope", F.when(F.col("scope") == "", "overall").otherwise(F.col("scope")))
        c = {k: F.col(k) for k in cells}
        no_label = absent("not_applicable", NOT_ASKED) if config.outcome_column is None else absent("not_verifiable", "label_not_evaluable")
        blind = c["mature"] == 0
        metrics = {
            "evaluated_count": amount(c["evaluated"], c["n"]), "hit_count": amount(c["hit"], c["n"]), "hit_rate": rate(c["hit"], c["evaluated"], c["evaluated"]), "unknown_count": amount(c["unknown"], c["n"]),
            "unknown_rate": rate(c["unknown"], c["evaluated"], c["evaluated"]), "not_evaluated_count": amount(c["skipped"], c["n"]), "applied_count": amount(c["applied"], c["n"]), "sole_hit_count": amount(c["sole"], c["n"]),
            "overlap_count": amount(c["overlap"], c["n"]), "overlap_rate": rate(c["overlap"], c["evaluated"], c["evaluated"]), "conflict_count": amount(c["conflict"], c["n"]), "incremental_action_count": amount(c["applied"], c["n"]),
            "leave_one_out_changed_action_count": amount(c["changed"], c["n"]), "captured_event_count": first_of([(blind, no_label)], amount(c["captured"], c["mature"])),
            "target_capture_rate": first_of([(blind, no_label)], rate(c["captured"], c["positive"], c["positive"])),
        }
        table = measured(wide, ["scope", *keys, "rule_key"], metrics)
    else:
        table = None
    asleep = [r for r in config.rules if r.rule_key not in active]
    if asleep:
        scopes = scoped(decided, keys, sets, {"n": F.count(F.lit(1))})
        named = scopes.withColumn("rule_key", F.explode(F.array(*[F.lit(r.rule_key) for r in asleep])))
        part = measured(named, ["scope", *keys, "rule_key"], {m: absent("inactive", "rule_inactive") for m in RULE_METRICS})
        table = part if table is None else table.unionByName(part)
    about = decided.sparkSession.createDataFrame([(r.rule_key, r.phase, r.priority, r.action_name, roles[r.action_name]) for r in config.rules], "rule_key string, phase string, priority int, action_name string, action_role string")
    return table.join(F.broadcast(about), "rule_key")  # a row a rule


def _counts(group: Column) -> dict[str, Column]:
    """What the measures of a group of rows rest on."""
    y, seen = F.col("_y"), F.col("_y").isNotNull()
    total = lambda c, g=group: F.coalesce(F.sum(F.when(g, F.col(c))), F.lit(0.0))
    lacking = lambda c, g=group: F.count_if(g & F.col(c).isNull())
    out = {"n": F.count_if(group), "mature": F.count_if(group & seen), "events": F.count_if(group & (y == 1)), "no_p": lacking("_p"), "no_x": lacking("_x"), "no_l": lacking("_l"), "no_value": lacking("_value"), "no_loss": lacking("_loss")}
    out |= {"mature_no_x": lacking("_x", group & seen), "mature_no_l": lacking("_l", group & seen), "mapped": F.count_if(group & F.col("_mapped")), "decided": F.count_if(group & F.col("final_action_name").isNotNull())}
    out |= {f"sum{c}": total(c) for c in ("_x", "_el", "_value", "_cost", "_payoff", "_loss")} | {"sum_ol": total("_ol", group & seen)}
    for c in ("_score", "_p"):
        held = F.when(group, F.col(c))
        out |= {f"count{c}": F.count(held), f"mean{c}": F.avg(held), f"min{c}": F.min(held), f"max{c}": F.max(held)}
    for role, names in GROUPS.items():
        out[f"in_{role}"] = F.count_if(group & F.col("_role").isin(*names))
    chosen = group & F.col("_role").isin(*GROUPS["selected"]) & seen
    return out | {"chosen": F.count_if(chosen), "chosen_events": F.count_if(chosen & (y == 1))}


def _sums(c: dict[str, Column], config: DecisionStrategyConfig) -> dict[str, Column]:
    """The sums that action and business summaries share.  One missing part makes a sum not verifiable."""
    asked_x, asked_l = config.exposure_column is not None, config.loss_fraction is not None
    evidence_asked = config.outcome_column is not None or config.probability_column is not None
    nothing, unknown = absent("not_applicable", NOT_ASKED), lambda reason: absent("not_verifiable", reason)
    undeclared = absent("not_applicable", "action_assumption_not_declared")
    parts = [(c["no_p"] > 0, unknown("probability_unavailable")), (c["no_x"] > 0, unknown("exposure_unavailable")), (c["no_l"] > 0, unknown("loss_fraction_unavailable"))]
    late = [(c["mature"] == 0, unknown("label_not_evaluable")), (c["mature_no_x"] > 0, unknown("exposure_unavailable")), (c["mature_no_l"] > 0, unknown("loss_fraction_unavailable"))]
    lossy = evidence_asked and asked_x and asked_l
    assumed = bool(config.action_assumptions)
    value = lambda name: first_of([(c["no_value"] > 0, unknown("action_assumption_not_declared"))], amount(c[name], c["n"])) if assumed else undeclared
    return {
        "exposure_sum": first_of([(c["no_x"] > 0, unknown("exposure_unavailable"))], amount(c["sum_x"], c["n"])) if asked_x else nothing,
        "expected_loss_sum": first_of(parts, amount(c["sum_el"], c["n"])) if lossy else nothing,
        "expected_loss_rate": first_of(parts, rate(c["sum_el"], c["sum_x"], c["n"])) if lossy else nothing,
        "assumption_based_observed_event_loss_sum": first_of(late, amount(c["sum_ol"], c["mature"])) if lossy else nothing,
        "assumed_action_value_sum": value("sum_value"),
        "assumed_action_cost_sum": value("sum_cost"),
        "assumption_based_payoff_sum": undeclared if not assumed else first_of([*parts, (c["no_value"] > 0, unknown("action_assumption_not_declared"))], amount(c["sum_payoff"], c["n"])) if lossy else nothing,
    }


def _grouped(rows: DataFrame, config: DecisionStrategyConfig, groups: Sequence[tuple[str | None, str | None, Column]]) -> tuple[DataFrame, list[str]]:
    """A row a scope and group, from one aggregate: (scope, keys, action, role, decided_rows, c)."""
    keys, sets = sets_of(config)
    cells = {}
    for i, (_, _, group) in enumerate(groups):
        cells[f"g{i}"] = F.struct(*[v.alias(k) for k, v in _counts(group).items()])
    wide = scoped(rows, keys, sets, cells | {"decided_rows": F.count("final_action_name")})
    each = [F.struct(F.lit(a).cast("string").alias("action"), F.lit(r).cast("string").alias("role"), F.col(f"g{i}").alias("c")) for i, (a, r, _) in enumerate(groups)]
    return wide.select("scope", *keys, "decided_rows", F.inline(F.array(*each))), keys


def action_summary(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """11 metrics by scope and action; every declared action has its rows."""
    rows = evidence(decided, config)
    roles = dict(config.action_roles)
    groups = [(a, roles[a], F.col("final_action_name").eqNullSafe(a)) for a in roles]
    wide, keys = _grouped(rows, config, groups)
    c = {k: F.col(f"c.{k}") for k in _counts(F.lit(True))}
    no_label = absent("not_applicable", NOT_ASKED) if config.outcome_column is None else absent("not_verifiable", "label_not_evaluable")
    blind = [(c["mature"] == 0, no_label)]
    sums = _sums(c, config)
    metrics = {
        "action_count": amount(c["n"], F.col("decided_rows")), "action_rate": rate(c["n"], F.col("decided_rows"), F.col("decided_rows")), "evaluable_event_count": first_of(blind, amount(c["mature"], c["mature"])),
        "event_count": first_of(blind, amount(c["events"], c["mature"])), "event_rate": first_of(blind, rate(c["events"], c["mature"], c["mature"])),
    }
    metrics |= {m: sums[m] for m in ACTION_METRICS if m in sums}
    if not config.active:
        metrics = {m: absent("inactive", "strategy_inactive") for m in ACTION_METRICS}
    return measured(wide, ["scope", *keys, "action", "role"], metrics)


def business_summary(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """25 metrics by scope, over all rows and over those whose action is selected, rejected or in review."""
    rows = evidence(decided, config).withColumn("_unknown", F.col("final_action_name").eqNullSafe(config.unknown_action_name))
    groups = [(None, None, F.lit(True)), *[(None, role, F.coalesce(F.col("_role").isin(*names), F.lit(False))) for role, names in GROUPS.items()]]
    keys, sets = sets_of(config)
    cells = {f"g{i}": F.struct(*[v.alias(k) for k, v in (_counts(g) | {"unknown": F.count_if(g & F.col("_unknown"))}).items()]) for i, (_, _, g) in enumerate(groups)}
    each = [F.struct(F.lit(r).cast("string").alias("role"), F.col(f"g{i}").alias("c")) for i, (_, r, _) in enumerate(groups)]
    wide = scoped(rows, keys, sets, cells).select("scope", *keys, F.inline(F.array(*each)))
    c = {k: F.col(f"c.{k}") for k in [*_counts(F.lit(True)), "unknown"]}
    nothing, unknown = absent("not_applicable", NOT_ASKED), lambda reason: absent("not_verifiable", reason)
    blind = [(c["mature"] == 0, unknown("label_not_evaluable"))]
    labelled = config.outcome_column is not None
    spread = lambda name, column, reason: {f"{name}_{f}": first_of([(c[f"count{column}"] == 0, unknown(reason))], amount(c[f"{f}{column}"], c[f"count{column}"])) for f in ("mean", "min", "max")}
    scores = config.score_column or config.probability_column
    metrics = {"row_count": amount(c["n"], c["n"]), "decided_rate": rate(c["decided"], c["n"], c["n"])}
    metrics |= spread("ranking_score", "_score", "score_unavailable") if scores else {f"ranking_score_{f}": nothing for f in ("mean", "min", "max")}
    metrics |= spread("event_probability", "_p", "probability_unavailable") if config.probability_column else {f"event_probability_{f}": nothing for f in ("mean", "min", "max")}
    metrics |= {
        "observed_event_count": first_of(blind, amount(c["events"], c["mature"])) if labelled else nothing, "observed_event_rate": first_of(blind, rate(c["events"], c["mature"], c["mature"])) if labelled else nothing,
        "selected_rate": rate(c["in_selected"], c["decided"], c["decided"]), "rejected_rate": rate(c["in_rejected"], c["decided"], c["decided"]), "review_capacity_rate": rate(c["in_review"], c["decided"], c["decided"]),
        "unknown_action_rate": rate(c["unknown"], c["decided"], c["decided"]),
    }
    metrics |= _sums(c, config)
    whole = (F.col("scope") == "overall") & F.col("role").isNull()
    loss_asked = config.observed_loss_column is not None
    apart, unripe = unknown("observed_loss_not_resegmentable"), unknown("observed_loss_not_mature")
    actual = lambda m: first_of([(~whole, apart), (c["no_loss"] > 0, unripe)], m) if loss_asked else first_of([(~whole, apart)], nothing)
    metrics |= {
        "actual_observed_loss_sum": actual(amount(c["sum_loss"], c["n"])), "actual_observed_loss_rate": actual(first_of([(c["no_x"] > 0, unknown("exposure_unavailable"))], rate(c["sum_loss"], c["sum_x"], c["n"]))),
        "selected_event_rate": rate(c["chosen_events"], c["chosen"], c["chosen"]) if labelled else nothing, "historical_mapped_rate": rate(c["mapped"], c["n"], c["n"]) if config.historical_action_column else nothing,
    }
    ordered = {m: metrics[m] for m in BUSINESS_METRICS}
    if not config.active:
        ordered = {m: absent("inactive", "strategy_inactive") for m in BUSINESS_METRICS}
    return measured(wide, ["scope", *keys, "role"], ordered)


def constraints(decided: DataFrame, config: DecisionStrategyConfig) -> DataFrame:
    """(constraint_key, metric, operator, threshold, action_name, value, support, gap, violation, status, reason).

    One aggregate for all.  ge has gap value - threshold, le the reverse; a value with less support
    than asked for is undefined.
    """
    rows = evidence(decided, config)
    made = F.col("final_action_name").isNotNull()
    role = lambda *names: made & F.coalesce(F.col("_role").isin(*names), F.lit(False))
    counts = {f"d_{k}": v for k, v in _counts(made).items()} | {f"s_{k}": v for k, v in _counts(role(*GROUPS["selected"])).items()} | {"asked": F.count_if(role("request_information"))}
    named = sorted({x.action_name for x in config.constraints if x.action_name is not None})
    counts |= {f"a{i}": F.count_if(F.col("final_action_name") == a) for i, a in enumerate(named)}
    one = rows.agg(*[v.alias(k) for k, v in counts.items()])
    d = {k: F.col(f"d_{k}") for k in _counts(made)}
    n = F.col("d_n")
    nothing, unknown = absent("not_applicable", NOT_ASKED), lambda reason: absent("not_verifiable", reason)
    sums = _sums(d, config)
    labelled, loss_asked = config.outcome_column is not None, config.observed_loss_column is not None
    loss = lambda m: first_of([(F.col("d_no_loss") > 0, unknown("observed_loss_not_mature"))], m) if loss_asked else nothing
    cells = []
    for x in config.constraints:
        own = F.col(f"a{named.index(x.action_name)}") if x.action_name is not None else n
        measure = {
            "action_count": amount(own, n), "action_rate": rate(own, n, n), "selected_rate": rate(F.col("d_in_selected"), n, n), "rejected_rate": rate(F.col("d_in_rejected"), n, n), "review_count": amount(F.col("d_in_review"), n),
            "review_rate": rate(F.col("d_in_review"), n, n), "request_information_rate": rate(F.col("asked"), n, n),
            "selected_exposure_sum": first_of([(F.col("s_no_x") > 0, unknown("exposure_unavailable"))], amount(F.col("s_sum_x"), F.col("s_n"))) if config.exposure_column else nothing,
            "expected_loss_sum": sums["expected_loss_sum"], "expected_loss_rate": sums["expected_loss_rate"], "observed_loss_sum": loss(amount(F.col("d_sum_loss"), n)),
            "observed_loss_rate": loss(rate(F.col("d_sum_loss"), F.col("d_sum_x"), n)), "selected_event_rate": rate(F.col("s_chosen_events"), F.col("s_chosen"), F.col("s_chosen")) if labelled else nothing,
        }[x.metric] if config.active else absent("not_applicable", "strategy_inactive")
        cells.append(F.struct(F.lit(x.constraint_key).alias("constraint_key"), F.lit(x.metric).alias("metric"), F.lit(x.operator).alias("operator"), F.lit(float(x.threshold)).alias("threshold"), F.lit(x.action_name).cast("string").alias("action_name"), F.lit(x.minimum_support).alias("least"), measure.alias("m")))
    flat = one.select(F.inline(F.array(*cells)))
    there = F.col("m.status") == "available"
    thin = there & (F.col("m.support") < F.col("least"))
    value = F.when(there & ~thin, F.col("m.value"))
    gap = F.when(F.col("operator") == "ge", value - F.col("threshold")).otherwise(F.col("threshold") - value)
    return flat.select(
        "constraint_key", "metric", "operator", "threshold", "action_name", value.alias("value"), F.col("m.support").alias("support"), gap.alias("gap"), F.when(gap.isNotNull(), F.greatest(F.lit(0.0), -gap)).alias("violation"),
        F.when(thin, "undefined").otherwise(F.col("m.status")).alias("status"), F.when(thin, "insufficient_support").when(gap >= 0, "constraint_satisfied").when(gap < 0, "constraint_failed").otherwise(F.col("m.reason")).alias("reason"),
    )
