"""Hand-made values, brute force and invariances of the engine's operators."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

import gristmill as g
from gristmill.functions.special import chi2_sf, pearson_p
from gristmill.operators import analysis, audit, governance, lifecycle, metrics, modeling, plotdata, profile, quality, risk, strategy
from gristmill.plans.conditions import Condition, compile_condition, within_window
from gristmill.plans.ordered import average_ranks, running_sums
from gristmill.plans.quantiles import quantiles


def test_tail_probabilities():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(0, 3) == 1.0
    assert pearson_p(0.6319, 10) == pytest.approx(0.05, abs=2e-4)
    assert pearson_p(1.0, 10) == 0.0


def test_schema_rules(spark):
    rows = [(float(i % 7), "abc"[i % 3], dt.datetime(2024, 1, 1) + dt.timedelta(days=i), i % 2 == 0, f"note number {i}", 1000 + i, None) for i in range(61)]
    df = spark.createDataFrame(rows, "amount double, segment string, event_date timestamp_ntz, active boolean, notes string, customer_id long, unknown string")
    report = g.infer_schema(df, target="segment")
    assert [c.logical_type for c in report.columns] == ["numeric", "categorical", "datetime", "boolean", "identifier", "identifier", "unknown"]
    assert report.target_candidates[0].suggested_task_type == "classification"
    flags = spark.createDataFrame([("true",), ("False ",), (None,)], "flag string")
    assert g.infer_schema(flags).columns[0].logical_type == "boolean"
    assert g.infer_schema(spark.createDataFrame([("0",), ("1",)] * 3, "flag string")).columns[0].logical_type == "categorical"
    assert g.infer_schema(df.limit(0)).columns[0].reasons == ("empty_dataframe",)
    with pytest.raises(ValueError):
        g.infer_schema(df, target="none")
    assert profile.name_tokens("customerId") == ["customer", "id"]


def test_summary_and_missing(spark):
    df = spark.createDataFrame([(7.0, None), (7.0, None), (None, None)], "constant double, nothing string")
    summary = g.summarize_dataframe(df)
    assert summary.total_missing_cells == 4 and summary.schema.columns[0].missing_rate == pytest.approx(1 / 3)
    assert summary.schema.columns[0].is_constant
    assert {r["column"]: r["median"] for r in summary.column_summary.collect()} == {"constant": 7.0, "nothing": None}


def test_quality_issues(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", nan), ("a", nan), ("b", 1.0), ("b", 1.0), ("c", float("inf"))], "group string, value double")
    assert quality.duplicate_rows(df).first()[0] == 4
    report = g.check_data_quality(df)
    found = {(i.code, i.column): i for i in report.issues}
    assert found["duplicate_rows", None].count == 4 and ("infinite_values", "value") in found and ("high_missing_column", "value") in found
    empty = g.check_data_quality(df.limit(0))
    assert [i.code for i in empty.issues] == ["empty_dataframe"]
    dates = spark.createDataFrame([(f"2024-01-{i:02d}",) for i in range(1, 10)] + [("bad",)], "d string")
    assert [i.count for i in g.check_data_quality(dates).issues if i.code == "datetime_parse_failures"] == [1]


def test_numeric_profile_and_skips(spark):
    df = spark.createDataFrame([(1, 1.0, True, None), (2, float("inf"), False, None), (3, None, True, None), (10, 0.0, True, None)], "a long, b double, c boolean, d double")
    out = g.analyze_numeric_features(df)
    assert out.skipped_reasons == {"d": "all_missing"} and out.analyzed_columns == ("a", "b")
    row = {r["column"]: r for r in out.summary.collect()}
    assert row["a"]["skew"] == pytest.approx(1.763632614803888) and row["b"]["max"] == float("inf") and row["b"]["zero_rate"] == pytest.approx(1 / 3)
    assert g.analyze_numeric_features(df, columns=["c"]).skipped_reasons == {"c": "not_numeric"}
    with pytest.raises(ValueError):
        g.analyze_numeric_features(df, columns=["zzz"])


def test_first_seen_breaks_ties(spark):
    df = spark.createDataFrame([(3, "x"), (1, "y"), (2, "x"), (0, "y"), (5, None)], "k long, v string")
    out = g.analyze_categorical_features(df, columns=["v"], order_by="k")
    assert out.summary.first()["top"] == "y" and [r["value"] for r in out.top_categories.orderBy("rank").collect()] == ["y", "x"]


def test_ranks_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    values = [rng.randrange(50) for _ in range(700)]
    expected = {v: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for v in set(values)}
    for parts in (1, 7):
        df = spark.createDataFrame([(v,) for v in values], "v long").repartition(parts)
        assert {r["v"]: r["rank"] for r in average_ranks(df, "v").collect()} == expected
    counted = spark.createDataFrame([(v, values.count(v)) for v in set(values)], "v long, n long")
    for buckets in (1, 5, 40):
        up = running_sums(counted, "v", ["n"], descending=True, buckets=buckets)
        assert {r["v"]: r["n_upto"] for r in up.collect()} == {v: sum(x >= v for x in values) for v in set(values)}


def test_quantiles_agree_in_both_forms(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, 1.0, 2.0]), rng.gauss(0, 1), None) for _ in range(501)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(5)
    columns, wanted = {n: F.col(n) for n in "abc"}, (0.0, 0.1, 0.25, 0.5, 1.0)
    one, many = ({r["column"]: r for r in quantiles(df, columns, wanted, distributed=d).collect()} for d in (False, True))
    assert one["c"]["q0"] is None and many["c"]["q0"] is None
    for n in "ab":
        assert [many[n][f"q{i}"] for i in range(5)] == pytest.approx([one[n][f"q{i}"] for i in range(5)])


def test_spearman_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (3.0, 30.0), (4.0, 20.0), (None, 5.0), (5.0, 50.0)], "a double, b double")
    out = g.compute_correlations(df, method="spearman").correlations.first()
    assert (out["n"], out["correlation"]) == (4, pytest.approx(0.8))
    assert g.compute_correlations(df.withColumn("c", F.lit(1))).skipped_reasons == {"c": "constant"}


def test_target_tests(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i % 5), "uv"[i // 10 % 2]) for i in range(40)], "k long, y string, x double, z string")
    out = g.analyze_target_relationships(df, "y", task="classification", features=["x", "z"])
    tests = {r["feature"]: r for r in out.statistical_tests.collect()}
    assert tests["x"]["test"] == "kruskal_wallis" and tests["z"]["statistic"] == 0.0 and tests["z"]["p_value"] == 1.0
    regression = g.analyze_target_relationships(df, "x", task="regression", features=["k", "y"])
    assert {r["test"] for r in regression.statistical_tests.collect()} == {"pearson", "kruskal_wallis"}
    two = spark.createDataFrame([("a", "u")] * 12 + [("a", "v")] * 5 + [("b", "u")] * 7 + [("b", "v")] * 9, "a string, b string")
    assert analysis.chi_square(two, F.col("a"), F.col("b")).first()["statistic"] == pytest.approx(56.5**2 * 33 / (17 * 16 * 19 * 14))


def test_features(spark):
    rows = [(i % 2, 1, i, None, 7, i * 3, i * 3, dt.datetime(2024, 1, 1 + i), "ab"[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "target long, left_out long, customer_id long, nothing double, constant long, number long, again long, day timestamp_ntz, segment string")
    df = df.withColumn("number", F.when(F.col("customer_id") == 5, 0).otherwise(F.col("number"))).withColumn("again", F.col("number"))
    report = g.suggest_feature_derivations(df, target="target", exclude_columns=["left_out"], reference_date=dt.date(2024, 2, 1))
    assert report.skipped_reasons["again"] == "duplicate_content" and report.skipped_reasons["target"] == "target_column"
    assert report.skipped_reasons["nothing"] == "all_missing" and report.skipped_reasons["constant"] == "constant"
    out = g.derive_features(df, report)
    first = out.data.orderBy("customer_id").first()
    assert first["day__days_since__2024_02_01"] == 31.0 and first["day__dayofweek"] == 0.0
    assert all(s.requires_fit for s in out.skipped_suggestions)
    zero = g.derive_features(df, [analysis_suggestion("number", "customer_id")]).data
    assert zero.where("customer_id = 0").first()["number__div__customer_id"] is None


def analysis_suggestion(a, b):
    from gristmill.operators.features import FeatureSuggestion

    return FeatureSuggestion(f"{a}__div__{b}", "ratio", (a, b), "")


def test_condition_kernel(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, None), (float("nan"), "a"), (float("inf"), "a")], "x double, s string")

    def read(c):
        v = compile_condition(c, df)
        return [(r[0], r[1], r[2]) for r in df.select(v.truth, v.status, v.reason).collect()]

    assert [t for t, _, _ in read(Condition(operator="ge", left="x", right=2))] == [False, True, None, None, None]
    assert [r for _, _, r in read(Condition(operator="ge", left="x", right=2))] == ["computed", "computed", "missing_operand", "missing_operand", "nonfinite_operand"]
    assert {r for _, _, r in read(Condition(operator="eq", left="x", right="one"))} == {"type_mismatch", "missing_operand"}
    either = Condition("or", children=(Condition(operator="gt", left="x", right=1.5), Condition(operator="eq", left="s", right="a")))
    assert [t for t, _, _ in read(either)] == [True, True, None, True, True]
    assert [t for t, _, _ in read(Condition("not", children=(Condition(operator="in", left="s", right=("a", "c")),)))] == [False, True, None, False, False]
    v = within_window(compile_condition(Condition(operator="is_missing", left="s"), df), F.lit("2024-01-01").cast("timestamp_ntz"), dt.datetime(2024, 2, 1), None)
    assert {r[0] for r in df.select(v.status).collect()} == {"inactive"}
    for bad in (Condition(operator="like", left="x", right=1), Condition(operator="eq", left="none", right=1), Condition("and"), Condition(operator="between", left="x", right=(2, 1)), Condition(operator="in", left="x", right=())):
        with pytest.raises(ValueError):
            compile_condition(bad, df)
    deep = Condition(operator="eq", left="x", right=1)
    for _ in range(9):
        deep = Condition("not", children=(deep,))
    with pytest.raises(ValueError, match="deep"):
        compile_condition(deep, df)


def test_metric_hand_values(spark):
    df = spark.createDataFrame([(0, 0.1, 0.1, "0"), (1, 0.4, 0.7, "0"), (0, 0.4, 0.2, "1"), (1, 0.9, 0.8, "1")], "y int, s double, p double, f string")
    rows = metrics.scored(df, F.col("y"), F.col("s"), probability=F.col("p"))
    one = metrics.ranking_metrics(rows).first()
    assert one["roc_auc"] == pytest.approx(0.875) and one["average_precision"] == pytest.approx(5 / 6)
    assert one["normalized_gini"] == pytest.approx(0.75) and one["ks_statistic"] == pytest.approx(0.5) and one["ks_threshold"] == 0.9
    assert metrics.probability_metrics(rows).first()["brier_score"] == pytest.approx(0.045)
    assert metrics.calibration_error(rows, 2).first()[1] == pytest.approx(0.2)
    assert metrics.gains(rows, [0.5]).first()["selected"] == 3
    single = metrics.ranking_metrics(metrics.scored(df.where("y = 1"), F.col("y"), F.col("s"))).first()
    assert (single["roc_auc"], single["reason"]) == (None, "single_class")
    assert metrics.roc_curve(rows).count() == 4
    out = metrics.class_metrics(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "t string, p string"), "t", "p").first()
    assert out["accuracy"] == pytest.approx(2 / 3) and out["balanced_accuracy"] == pytest.approx(0.75)


def brute_decision(rules, truths, default, unknown):
    """The walk over the rules, row by row."""
    base = final = applied = None
    conflicts, unknowns, terminal, is_open = 0, 0, False, True
    for phase, key, action, stop in rules:
        if phase == "decision" and terminal:
            continue
        t = truths[key]
        unknowns += t is None
        if not is_open:
            continue
        if t is None:
            final, is_open = unknown, False
            terminal = terminal or phase == "eligibility"
        elif t:
            if base is None:
                base, final, applied = action, action, key
                terminal = terminal or phase == "eligibility"
                is_open = not stop
            elif action != base:
                conflicts, final, is_open = conflicts + 1, unknown, False
            elif stop:
                is_open = False
    reason = "default_action_applied" if final is None else "rule_conflict" if conflicts else "unknown_condition" if unknowns else "computed"
    return final or default, reason, applied


def test_decision_fold_equals_brute_force(spark):
    rng = random.Random(9)
    names = ["r0", "r1", "r2", "r3", "r4"]
    data = [(i, *(rng.choice([1, 0, 0, None]) for _ in names)) for i in range(300)]
    df = spark.createDataFrame(data, "k long, " + ", ".join(f"{n} int" for n in names))
    rules = [(("eligibility" if i < 2 else "decision"), n, rng.choice(["a", "b"]), rng.random() < 0.5) for i, n in enumerate(names)]
    config = strategy.DecisionStrategyConfig(
        "s", "1", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1),
        tuple(strategy.DecisionRule(n, p, i, Condition(operator="eq", left=n, right=1), a, s) for i, (p, n, a, s) in enumerate(rules)), "d", "u", (("a", "selected"), ("b", "rejected"), ("d", "review"), ("u", "review")),
    )
    out = {r["k"]: (r["final_action_name"], r["decision_reason"], r["applied_rule_key"]) for r in strategy.row_decisions(strategy.decide(df, config), ["k"]).collect()}
    for k, *values in data:
        assert out[k] == brute_decision(rules, {n: None if v is None else v == 1 for n, v in zip(names, values, strict=True)}, "d", "u")
    late = strategy.DecisionStrategyConfig("s", "1", dt.datetime(2024, 1, 1), dt.datetime(2023, 1, 1), (), "d", "u", (("d", "selected"), ("u", "review")))
    assert {r["decision_reason"] for r in strategy.decide(df, late).collect()} == {"strategy_inactive"}
    result = g.simulate_decision_strategy(df, config, keep=["k"])
    assert result.rule_evaluations.count() == 300 * 5 and result.leave_one_out.count() == 5
    with pytest.raises(ValueError):
        strategy.DecisionStrategyConfig("s", "1", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), (), "d", "u", (("d", "odd"), ("u", "review")))


DAY = dt.timedelta(days=1)


def panel(spark, values, gaps=None, entity="e"):
    at, rows = dt.datetime(2024, 1, 1), []
    for i, v in enumerate(values):
        rows.append((i, entity, at, v))
        at += (gaps[i] if gaps else 1) * DAY
    return spark.createDataFrame(rows, "k long, entity string, at timestamp_ntz, v double"), rows


def config_of(rules=(), **changes):
    base = {"analysis_as_of": dt.datetime(2024, 12, 31), "entity": "entity", "observed": "at", "key": "k", "feature": "v", "scenarios": (lifecycle.WarningScenario("s", "rule_set", tuple(rules)),), "reference_scenario": "s", "alert_ranks": (("low", 1),)}
    return lifecycle.LifecycleConfig(**(base | changes))


def brute_episodes(rows, truths, persistence, resolution, cooldown, interval):
    from gristmill.streaming.monitor import advance

    state, notes = None, []
    for (_, _, at, _), t in zip(rows, truths, strict=True):
        us = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
        state, note = advance(state, us, t, persistence, resolution, cooldown // dt.timedelta(microseconds=1), None if interval is None else interval // dt.timedelta(microseconds=1))
        if note:
            notes.append((at, *note))
    return notes


@pytest.mark.parametrize(("persistence", "resolution", "cooldown", "interval"), [(1, 1, 0, None), (2, 1, 3, None), (2, 2, 2, 2), (1, 3, 0, 1)])
def test_warning_machine_equals_brute_force(spark, persistence, resolution, cooldown, interval):
    rng = random.Random(persistence * 100 + resolution * 10 + cooldown)
    values = [rng.choice([0.0, 5.0, 5.0, None]) for _ in range(80)]
    gaps = [rng.choice([1, 1, 1, 3]) for _ in values]
    df, rows = panel(spark, values, gaps)
    rule = lifecycle.WarningRule("r", 1, "low", Condition(operator="gt", left="v", right=1.0), persistence, resolution, cooldown * DAY)
    config = config_of([rule], expected_interval=None if interval is None else interval * DAY)
    folded = lifecycle.machines(lifecycle.rule_matrix(df.repartition(3), config), config)
    found = sorted((r["notification_time"], r["notification_kind"], r["episode_ordinal"], r["notification_ordinal"]) for r in lifecycle.notifications(folded, config).collect())
    assert found == sorted(brute_episodes(rows, [None if v is None else v > 1 for v in values], persistence, resolution, cooldown * DAY, config.expected_interval))
    spans = lifecycle.episodes(folded, config).collect()
    assert len(spans) == len({n[2] for n in found}) and sum(r["notification_count"] for r in spans) == len(found)


def test_state_machine(spark):
    df, _ = panel(spark, [1.0, 5.0, 9.0, 1.0, 5.0, None, 1.0], [1, 1, 1, 1, 1, 5, 1])
    states = (lifecycle.LifecycleState("low", 0, 2, Condition(operator="lt", left="v", right=3.0)), lifecycle.LifecycleState("mid", 1, 1, Condition(operator="between", left="v", right=(3.0, 7.0))), lifecycle.LifecycleState("top", 2, 0, Condition(operator="gt", left="v", right=7.0), terminal=True), lifecycle.LifecycleState("other", 0, 9, Condition(operator="is_missing", left="v"), enabled=False))
    config = config_of(states=states, default_state="other", unknown_state="unknown", adverse_states=("top",), cure_states=("low",), expected_interval=2 * DAY)
    rows = lifecycle.states(df, config).orderBy("k").collect()
    assert [r["effective_state"] for r in rows] == ["low", "mid", "top", "top", "top", "top", "low"]
    assert [r["transition_kind"] for r in rows] == ["entry", "change", "change", "invalid", "invalid", "invalid", "reentry"]
    assert [r["transition_direction"] for r in rows][:3] == ["not_applicable", "roll_forward", "roll_forward"] and rows[-1]["is_cure"]


def test_signals_equal_brute_force_and_ignore_the_future(spark):
    rng = random.Random(3)
    values = [rng.choice([None, 1.0, 4.0, 9.5, 2.25]) for _ in range(40)]
    df, rows = panel(spark, values, [rng.choice([1, 2, 4]) for _ in values])
    config = config_of(history_window=7 * DAY, history_start_inclusive=False)
    out = {r["k"]: r for r in lifecycle.signals(df, config).collect()}
    for k, _, at, v in rows:
        window = [w for _, _, t, w in rows if at - 7 * DAY < t < at and w is not None]
        if v is None or not window:
            assert out[k]["history_mean"] is None and out[k]["prior_value"] is None
        else:
            assert out[k]["history_mean"] == pytest.approx(sum(window) / len(window)) and out[k]["change"] == pytest.approx(v - window[-1])
    early = {r["k"]: r for r in lifecycle.signals(df.where("k < 20"), config).collect()}
    assert all(early[k]["trend"] == out[k]["trend"] and early[k]["prior_value"] == out[k]["prior_value"] for k in early)


def test_events_and_maturity(spark):
    df, _ = panel(spark, [5.0, 1.0, 5.0, 1.0, 1.0])
    df = df.withColumn("ev", F.when(F.col("k") == 3, F.col("at")))
    config = config_of([lifecycle.WarningRule("r", 1, "low", Condition(operator="gt", left="v", right=1.0))], event_time="ev", horizon=3 * DAY, horizon_end_inclusive=True, analysis_as_of=dt.datetime(2024, 1, 6))
    result = g.monitor_lifecycle(df, config)
    match = result.event_matches.first()
    assert match["lead_seconds"] == 3 * 86400 and match["candidate_count"] == 2
    assert {r["k"]: (r["is_mature"], r["event_within_horizon"]) for r in result.maturity.collect()} == {0: (True, True), 1: (True, True), 2: (True, True), 3: (False, False), 4: (False, False)}
    assert result.monitoring_summary.where("scope = 'scenario_key'").first()["hits"] == 2


def test_period_index(spark):
    rows = [(dt.datetime(2024, 1, 31, 12), dt.datetime(2024, 2, 29, 12)), (dt.datetime(2024, 1, 15), dt.datetime(2024, 4, 14)), (dt.datetime(2024, 1, 15), dt.datetime(2024, 4, 15)), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 8))]
    df = spark.createDataFrame(rows, "o timestamp_ntz, t timestamp_ntz")
    read = lambda unit: [r[0] for r in df.select(lifecycle.period_index(F.col("o"), F.col("t"), unit)).collect()]
    assert read("month") == [0, 2, 3, 0] and read("quarter") == [0, 0, 1, 0] and read("week")[3] == 1 and read("day")[3] == 7


def test_governance(spark):
    rows = [("a", "roc_auc", 0.7), ("b", "roc_auc", 0.8), ("a", "brier_score", 0.2), ("b", "brier_score", 0.2), ("a", "log_loss", 0.5), ("a", "log_loss", 0.6), ("b", "log_loss", 0.4)]
    evidence = spark.createDataFrame(rows, "model string, metric string, value double")
    c = governance.Criterion
    policy = lambda *x: governance.GovernancePolicy("a", "b", x)
    pick = lambda *x: g.evaluate_governance(policy(*x), evidence).recommendation.first()["recommendation"]
    assert pick(c("one", "roc_auc"), c("two", "brier_score")) == "promote_challenger"
    assert pick(c("one", "roc_auc"), c("two", "log_loss")) == "insufficient_evidence"
    assert pick(c("two", "brier_score")) == "retain_champion"
    assert pick(c("one", "roc_auc", direction="lower", veto=True)) == "reject_challenger"
    assert governance.drift_deviation([50, 50], 100, seed=1) == governance.drift_deviation([50, 50], 100, seed=1) > 0
    assert governance.auc_deviation([0.1, 0.4, 0.8, 0.9], [0, 1, 0, 1]) > 0
    with pytest.raises(ValueError):
        governance.GovernancePolicy("a", "a", (c("one", "roc_auc"),))


def test_governance_compares_what_is_proved(spark):
    now, later = dt.datetime(2024, 5, 1), dt.datetime(2024, 7, 1)
    table = spark.createDataFrame([("a", "auc", 0.7, "available", 50), ("b", "auc", 0.8, "available", 50), ("a", "odd", float("nan"), "available", 5), ("b", "odd", None, "undefined", 0), ("a", "two", 1.0, "available", 1), ("a", "two", 2.0, "available", 1)], "model string, metric string, value double, status string, n int")

    def ref(model, metric="auc", **more):
        return governance.EvidenceRef(model, metric, "t", (("model", model), ("metric", metric)), status_column="status", support_column="n", **({"as_of": now, "snapshot": "s1", "entities": "e"} | more))

    got = {(r["model"], r["metric"]): (r["value"], r["support"], r["reason"]) for r in governance.resolve([ref("a"), ref("b"), ref("a", "odd"), ref("b", "odd"), ref("a", "two"), ref("b", "none")], {"t": table}).collect()}
    assert got == {("a", "auc"): (0.7, 50, "computed"), ("b", "auc"): (0.8, 50, "computed"), ("a", "odd"): (None, 5, "invalid_owner_value"), ("b", "odd"): (None, 0, "undefined"), ("a", "two"): (None, 1, "source_not_unique"), ("b", "none"): (None, None, "source_not_found")}
    policy = governance.GovernancePolicy("a", "b", (governance.Criterion("c", "auc", "higher"),), dt.datetime(2024, 6, 1), True, True)
    said = lambda *refs: governance.compare(governance.resolve(refs, {"t": table}), policy).first()
    assert said(ref("a"), ref("b"))["winner"] == "challenger"
    for refs, reason in (((ref("a"), ref("b", as_of=later)), "time_unverified"), ((ref("a"), ref("b", as_of=None)), "time_unverified"), ((ref("a"), ref("b", snapshot="s2")), "snapshot_unverified"), ((ref("a"), ref("b", entities=None)), "alignment_unverified")):
        row = said(*refs)
        assert row["reason"] == reason and row["winner"] is None and row["challenger_value"] == 0.8
    for bad in ([governance.EvidenceRef("a", "auc", "t", ())], [governance.EvidenceRef("a", "auc", "t", (("nope", 1),))], [governance.EvidenceRef("a", "auc", "other", (("model", "a"),))]):
        with pytest.raises(ValueError):
            governance.resolve(bad, {"t": table})
    rows = spark.createDataFrame([(i % 2, (i % 10) / 10 + 0.05, i < 60) for i in range(100)], "y int, p double, early boolean")
    fact = governance.Declared
    facts = [fact("a", "attribution", "income", 0.4), fact("b", "attribution", "income", 0.1), fact("a", "explanation", "income", text="more is safer"), fact("b", "metadata", "owner", text="team", as_of=now)]
    out = governance.evaluate_governance(policy, refs=[ref("a"), ref("b")], tables={"t": table}, periods=(rows.where("early"), rows.where("not early")), label=F.col("y"), probability="p", facts=facts)
    assert out.recommendation.first()["recommendation"] == "promote_challenger" and out.candidates.count() == 2 and out.provenance.count() == 3
    assert out.attributions.count() == 2 and out.explanations.count() == 1 and out.metadata.first()["text"] == "team"
    drift = out.drift.first()
    assert drift["total_variation"] == pytest.approx(0.0, abs=1e-9) and drift["deviation"] > 0 and out.stability.count() == 2
    errors = [(y - p) ** 2 for y, p, early in [(i % 2, (i % 10) / 10 + 0.05, i < 60) for i in range(100)] if early]
    mean = sum(errors) / 60
    assert out.stability.first()["deviation"] == pytest.approx((sum((e - mean) ** 2 for e in errors) / 60) ** 0.5 / 60**0.5)
    for wrong in ([fact("c", "metadata", "x", text="t")], [fact("a", "attribution", "x")], [fact("a", "metadata", "x", text="t"), fact("a", "metadata", "x", text="u")], [fact("a", "metadata", "x", text="t", as_of=later)], [fact("a", "metadata", "x", float("inf"))]):
        with pytest.raises(ValueError):
            governance.evaluate_governance(policy, refs=[ref("a")], tables={"t": table}, facts=wrong)
    with pytest.raises(ValueError):
        governance.evaluate_governance(policy)


def test_models_predict_held_out_rows(spark):
    rng = random.Random(8)
    rows = [(i, x, "uv"[i % 2], int(x + rng.gauss(0, 0.3) > 0), 3 * x + (i % 2)) for i in range(400) for x in [rng.uniform(-2, 2)]]
    df = spark.createDataFrame(rows, "row_id long, x double, z string, y int, target double").withColumn("x", F.when(F.col("row_id") % 17 == 0, None).otherwise(F.col("x")))
    trained = g.train_classifier(df.drop("target"), "y", keys=["row_id"])
    assert trained.train.count() + trained.test.count() == 400
    out = g.evaluate_classifier(trained)
    assert out.metrics.first()["accuracy"] > 0.8 and out.roc_auc.first()["roc_auc"] > 0.85
    fitted = g.train_regressor(df.where("x is not null").drop("y"), "target", keys=["row_id"])
    assert modeling.evaluate_regressor(fitted).metrics.first()["r2"] > 0.98
    folds = g.validate_binary_risk(df.drop("target"), "y", config=g.RiskValidationConfig(folds=2), features=["x", "z"], keys=["row_id"])
    assert folds.metrics.count() == 3 and folds.metrics.where("fold = 'overall'").first()["roc_auc"] > 0.85


def test_time_folds_never_train_on_what_was_not_known(spark):
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rng = random.Random(3)
    rows = [(i, day(i % 200), day(i % 200 + 10 + i % 3), rng.uniform(-1, 1), None if i % 41 == 0 else int(rng.random() < 0.4)) for i in range(800)]
    df = spark.createDataFrame(rows, "k long, seen timestamp_ntz, known timestamp_ntz, x double, y int")
    time = g.TimePlan("seen", "label_available_time", (day(60), day(120)), day(180), day(185), horizon=dt.timedelta(days=10), label_available="known")
    config = g.RiskValidationConfig(mode="time_forward", time=time)
    plan = risk.fold_plan(df, "y", config, ["k"])
    for i, (c, e) in enumerate(time.windows):
        train = {r["k"] for r in plan.rows.where(plan.train(i)).collect()}
        valid = {r["k"] for r in plan.rows.where(plan.validation(i)).collect()}
        assert train == {k for k, o, a, _, y in rows if y is not None and o < c and a <= c}
        assert valid == {k for k, o, _, _, y in rows if y is not None and c <= o < e}
    out = g.validate_binary_risk(df, "y", config=config, features=["x"], keys=["k"])
    folds = out.folds.orderBy("fold_id").collect()
    assert [r["purged_train_n"] > 0 for r in folds] == [True, True] and folds[1]["immature_validation_n"] > 0 == folds[0]["immature_validation_n"]
    assert {r["fold"] for r in out.metrics.collect()} == {"overall", "0", "1"}
    reasons = {r["reason"]: r["count"] for r in out.excluded.groupBy("reason").count().collect()}
    assert set(reasons) == {"missing_target", "before_first_validation_window", "outside_validation_window"}
    assert out.predictions.count() + sum(reasons.values()) == len(rows)
    # given predictions match the plan or are refused
    given = plan.rows.where("fold is not null").select("k", "fold", F.col("x").alias("ranking_score"))
    one = g.validate_binary_risk(df, "y", config=config, keys=["k"], predictions=given).metrics.where("fold = 'overall'").first()["roc_auc"]
    turned = g.validate_binary_risk(df, "y", config=config, keys=["k"], predictions=given, direction="lower_risk").metrics.where("fold = 'overall'").first()["roc_auc"]
    assert abs(one + turned - 1) < 1e-9
    first = given.first()["k"]
    for wrong in (given.where(F.col("k") != first), given.union(given.where(F.col("k") == first)), given.withColumn("fold", 1 - F.col("fold")), given.union(df.limit(1).select(F.lit(-1), F.lit(0), F.lit(0.5)))):
        with pytest.raises(ValueError, match="does not match validation plan"):
            risk.external_predictions(plan, wrong, ["k"])
    with pytest.raises(ValueError, match="finite"):
        risk.external_predictions(plan, given.withColumn("ranking_score", F.when(F.col("k") == first, float("nan")).otherwise(0.0)), ["k"])


@pytest.mark.parametrize(
    "change",
    [{"maturity_source": "outcome_end"}, {"horizon": None}, {"analysis_as_of": dt.datetime(2020, 2, 1)}, {"cutoffs": (dt.datetime(2020, 3, 1), dt.datetime(2020, 2, 1))}, {"horizon": dt.timedelta(0)}],
)
def test_time_plans_that_do_not_fit_are_refused(change):
    base = {"observation": "o", "maturity_source": "observation_horizon", "cutoffs": (dt.datetime(2020, 2, 1),), "validation_end": dt.datetime(2020, 3, 1), "analysis_as_of": dt.datetime(2020, 4, 1), "horizon": dt.timedelta(days=5)}
    assert g.TimePlan(**base).windows == [(dt.datetime(2020, 2, 1), dt.datetime(2020, 3, 1))]
    with pytest.raises(ValueError):
        g.TimePlan(**(base | change))
    for mode in ("time_forward", "group_kfold"):
        with pytest.raises(ValueError):
            g.RiskValidationConfig(mode=mode, time=g.TimePlan(**base))
    with pytest.raises(ValueError):
        g.RiskValidationConfig(mode="time_holdout")


def test_label_maturity_must_agree_with_the_data(spark):
    t = dt.datetime(2020, 1, 1)
    frame = spark.createDataFrame([(1, t, t + dt.timedelta(days=5), t + dt.timedelta(days=7), t + dt.timedelta(days=3), 1), (2, t, t + dt.timedelta(days=5), t + dt.timedelta(days=7), None, 0)], "k long, o timestamp_ntz, e timestamp_ntz, a timestamp_ntz, event timestamp_ntz, y int")
    base = {"observation": "o", "cutoffs": (dt.datetime(2020, 2, 1),), "validation_end": dt.datetime(2020, 3, 1), "analysis_as_of": dt.datetime(2020, 4, 1)}
    delay = dt.timedelta(days=2)
    fine = [
        {"maturity_source": "outcome_end", "outcome_end": "e", "reporting_delay": delay, "label_available": "a", "event_time": "event"},
        {"maturity_source": "label_available_time", "label_available": "a", "horizon": dt.timedelta(days=5)},
        {"maturity_source": "observation_horizon", "horizon": dt.timedelta(days=5), "outcome_end": "e"},
    ]
    for extra in fine:
        plan = risk.fold_plan(frame, "y", g.RiskValidationConfig(mode="time_holdout", time=g.TimePlan(**base, **extra)), ["k"])
        due = t + dt.timedelta(days=7 if extra["maturity_source"] != "observation_horizon" else 5)
        assert {r["_available"] for r in plan.rows.collect()} == {due}
    wrong = [
        {"maturity_source": "outcome_end", "outcome_end": "e", "label_available": "a"},
        {"maturity_source": "label_available_time", "label_available": "a", "horizon": dt.timedelta(days=5), "reporting_delay": dt.timedelta(days=3)},
        {"maturity_source": "observation_horizon", "horizon": dt.timedelta(days=4), "outcome_end": "e"},
        {"maturity_source": "observation_horizon", "horizon": dt.timedelta(days=2), "event_time": "event"},
        {"maturity_source": "outcome_end", "outcome_end": "event"},
    ]
    for extra in wrong:
        with pytest.raises(ValueError, match="invalid|inconsistent"):
            risk.fold_plan(frame, "y", g.RiskValidationConfig(mode="time_holdout", time=g.TimePlan(**base, **extra)), ["k"])


def test_histogram_covers_all_rows(spark):
    df = spark.createDataFrame([(float(i % 37), i) for i in range(500)] + [(None, -1), (float("inf"), -2)], "v double, k long")
    bins = plotdata.histogram(df, ["v"]).collect()
    assert sum(r["n"] for r in bins) == 500 and min(r["lower"] for r in bins) == 0 and max(r["upper"] for r in bins) == 36
    assert len(plotdata.plot_distributions(df)) == 2


def test_joins_that_grow_with_the_panel_are_never_broadcast(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(str(e), e * 10 + i, start + i * DAY, float(i), start + i * DAY if i % 3 == 0 else None) for e in range(3) for i in range(9)], "entity string, k long, at timestamp_ntz, v double, ev timestamp_ntz").write.parquet(f"{tmp_path}/panel")
    df = spark.read.parquet(f"{tmp_path}/panel")  # a small file, which Spark would broadcast
    config = config_of([lifecycle.WarningRule("r", 1, "low", Condition(operator="gt", left="v", right=1.0))], event_time="ev", horizon=3 * DAY)
    matrix, events = lifecycle.rule_matrix(df, config), lifecycle.declared_events(df, config)
    matches = lifecycle.event_matches(lifecycle.notifications(lifecycle.machines(matrix, config), config), events, config)
    maturity = lifecycle.observation_maturity(df, events, config)
    for out in (matches, maturity, lifecycle.held_events(df, events, config), lifecycle.event_summary(events, matches, maturity, matrix, config)):
        plan = out._jdf.queryExecution().sparkPlan().toString().splitlines()
        assert any("SortMergeJoin" in line for line in plan)
        assert not [line for line in plan if "BroadcastHashJoin" in line and ("entity#" in line or "[k#" in line)]  # joins by scenario have a row a scenario


def test_warning_metrics_count_distinct_values_without_multiplying_rows(spark):
    from gristmill.operators.monitoring_tables import persistent_hits, warning_metrics

    rng, rows = random.Random(11), []
    for i in range(160):  # keys that repeat over entities, missing keys and labels, equal times, times after the analysis
        rows.append((rng.choice([None, *range(60)]), rng.choice(["a", "b", None]), dt.datetime(2024, 1, 1) + rng.randrange(12) * DAY, rng.choice([0.0, 2.0, 5.0, None]), rng.choice(["x", "y", None])))
    df = spark.createDataFrame(rows, "k long, entity string, at timestamp_ntz, v double, seg string")
    over = lambda x: Condition(operator="gt", left="v", right=x)
    rules = [lifecycle.WarningRule("r", 1, "low", over(1.0), 2, 2), lifecycle.WarningRule("q", 2, "high", over(3.0), cooldown=2 * DAY)]
    config = config_of(rules, segment_columns=("seg",), alert_ranks=(("low", 1), ("high", 2)), analysis_as_of=dt.datetime(2024, 1, 9))
    matrix = lifecycle.rule_matrix(df, config, ("seg",)).localCheckpoint()
    spans = lifecycle.episodes(lifecycle.machines(matrix, config), config).localCheckpoint()
    flagged = lifecycle.persistent(matrix, config)
    shown = ["entity", "k", "at", "seg", "rule_key", "truth", "is_persistent"]
    text = lambda out: sorted(map(str, out.where("entity is not null").select(*shown).collect()))
    assert text(flagged) == text(persistent_hits(matrix, spans, config))
    held, out = flagged.collect(), warning_metrics(flagged, spans, config)
    assert "gid" not in out._jdf.queryExecution().optimizedPlan().toString()  # no copy of a row for each distinct count
    for r in out.where("metric in ('warning_observation_rate', 'warned_entity_rate', 'persistent_warning_rate', 'warning_hit_count')").collect():
        label = r["scope"].split("*")[-1]
        own = [m for m in held if (r["rule_key"] or m["rule_key"]) == m["rule_key"] and (label != "alert_rank" or str(m["alert_rank"]) == r["alert_rank"]) and (label != "seg" or m["seg"] == r["seg"]) and m["status"] != "inactive"]
        hits = [m for m in own if m["truth"]]
        distinct = lambda ms, c: len({m[c] for m in ms} - {None})
        want = {"warning_observation_rate": (distinct(hits, "k"), distinct(own, "k")), "warned_entity_rate": (distinct(hits, "entity"), distinct(own, "entity")), "persistent_warning_rate": (distinct([m for m in own if m["is_persistent"]], "k"), distinct(own, "k"))}
        if r["metric"] == "warning_hit_count":
            assert (r["value"], r["support"]) == (len(hits), len(own))
        else:
            assert (r["numerator"], r["denominator"]) == want[r["metric"]], r


def test_collinearity_and_column_counts_do_not_grow_their_aggregates(spark):
    rng = random.Random(5)
    rows = [(i, float(i % 7), 2.0 * (i % 7), rng.choice([None, math.nan, 1.0, -0.0, 0.0]), rng.choice(["", " ", "a", None]), dt.datetime(2024, 1, 1 + i % 5), 1) for i in range(90)]
    df = spark.createDataFrame(rows, "i long, a double, b double, c double, s string, at timestamp_ntz, one int")
    out = audit.collinearity(df)
    assert out.select("left", "right", "n").collect() == [("a", "b", 90)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("covar_pop(") == 1  # one small aggregate for all pairs: a large one is not compiled
    for r in audit.column_profile(df, "i").collect():
        values = [v[df.columns.index(r["column"])] for v in rows]
        seen = [repr(v) for v in values if v is not None and v == v]
        counts = [seen.count(v) for v in set(seen)]
        assert (r["rows"], r["missing"], r["unique"], r["top_count"], r["singletons"]) == (90, 90 - len(seen), len(counts), max(counts), counts.count(1))
        assert (r["empty_strings"], r["blank_strings"]) == (values.count(""), values.count(" "))
