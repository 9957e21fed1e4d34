"""Files, documents, reports, the command line and the streaming twin."""

import datetime as dt
import json
import os
import re
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import gristmill as g
from gristmill.cli import main
from gristmill.operators.workflow import RISK_SECTIONS
from gristmill.sources.documents import DocumentError, parse
from gristmill.sources.report import write_report
from gristmill.streaming import monitor


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("x;g;when;flag\n1;u;2024-01-01 00:00:00;true\nNA;null;;False\n3;w;2024-01-03 00:00:00;\n")
    df = g.load_csv(spark, str(path), sep=";")
    assert dict(df.dtypes) == {"x": "bigint", "g": "string", "when": "timestamp_ntz", "flag": "boolean"}
    assert [r["x"] for r in df.collect()] == [1, None, 3] and df.where("g is null").count() == 1
    assert dict(g.load_csv(spark, str(path), sep=";", dtype={"x": "double"}).dtypes)["x"] == "double"
    with pytest.raises(ValueError):
        g.load_csv(spark, str(path), quoting=1)


def workbook(path, sheets):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>x</t></si><si><t>name</t></si><si><t>day</t></si><si><t>n/a</t></si></sst>')
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def test_excel(spark, tmp_path):
    path = tmp_path / "b.xlsx"
    body = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row r="2"><c r="A2"><v>1.5</v></c><c r="B2" t="inlineStr"><is><t>u</t></is></c><c r="C2" s="1"><v>45292</v></c></row><row r="3"><c r="A3"><v>2</v></c><c r="B3" t="s"><v>3</v></c></row>'
    workbook(path, {"one": body, "two": '<row r="1"><c r="A1" t="s"><v>0</v></c></row>'})
    df = g.load_excel(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [(1.5, "u", dt.datetime(2024, 1, 1)), (2.0, None, None)]
    assert g.load_excel(spark, str(path), sheet_name="two").count() == 0
    assert g.load_excel(spark, str(path), usecols=["x"], nrows=1).columns == ["x"]
    for bad in ({"sheet_name": "three"}, {"sheet_name": None}, {"engine": "x"}):
        with pytest.raises(ValueError):
            g.load_excel(spark, str(path), **bad)


ATOM = {"kind": "atomic", "operator": "ge", "left_kind": "column", "left": "x", "right_kind": "literal", "right": 2, "children": []}
POLICY = {
    "schema_version": "task20.policy.v1", "strategy_key": "s", "strategy_version": "1", "effective_from": "2024-01-01T00:00:00", "expires_at": None, "evaluation_time": "2024-02-01T00:00:00", "default_action_name": "keep", "unknown_action_name": "look",
    "action_role_mapping": [["keep", "selected"], ["look", "review"], ["drop", "rejected"]], "rules": [{"rule_key": "big", "phase": "decision", "priority": 1, "action_name": "drop", "condition": ATOM, "stop_on_hit": True, "enabled": True, "effective_from": None, "expires_at": None, "description_key": None}],
}


def test_documents(spark):
    config = g.load_policy_json(json.dumps(POLICY))
    df = spark.createDataFrame([(1,), (3,), (None,)], "x long")
    assert [r["final_action_name"] for r in g.simulate_decision_strategy(df, config, keep=["x"]).row_decisions.collect()] == ["keep", "drop", "look"]
    for bad in ('{"a": 1, "a": 2}', "[1]", '{"a": NaN}', "{", json.dumps(POLICY | {"extra": 1}), json.dumps(POLICY | {"schema_version": "other"}), json.dumps({k: v for k, v in POLICY.items() if k != "rules"}), json.dumps(POLICY | {"rules": [POLICY["rules"][0] | {"condition": ATOM | {"operator": "like"}}]})):
        with pytest.raises(DocumentError):
            g.load_policy_json(bad)
    with pytest.raises(DocumentError):
        parse('{"a": ' + "[" * 40 + "]" * 40 + "}")
    rule = {"rule_key": "r", "priority": 1, "alert_level": "low", "cooldown": 5, "condition": {"kind": "not", "children": [{"kind": "atomic", "operator": "is_missing", "left_kind": "change"}]}}
    warning = {"schema_version": "task20.warning.v1", "analysis_as_of": "2024-02-01T00:00:00", "entity_column": "e", "observation_time_column": "t", "condition_feature_columns": ["x"], "scenarios": [{"scenario_key": "s", "scenario_kind": "rule_set", "rules": [rule]}], "reference_scenario_key": "s", "alert_level_ranks": [["low", 1]], "states": [], "default_state_key": "d", "unknown_state_key": "u", "expected_observation_interval": 86_400_000_000}
    run = g.load_warning_json(json.dumps(warning), key="k")
    assert run.scenarios[0].rules[0].cooldown == dt.timedelta(microseconds=5) and run.expected_interval == dt.timedelta(days=1)
    panel = spark.createDataFrame([(i, "a", dt.datetime(2024, 1, 1 + i), float(i)) for i in range(4)], "k long, e string, t timestamp_ntz, x double")
    assert g.monitor_lifecycle(panel, run).notifications.count() == 3


WARNING = {
    "schema_version": "task20.warning.v1", "analysis_as_of": "2024-02-01T00:00:00", "entity_column": "e", "observation_time_column": "t", "condition_feature_columns": ["x", "y"], "reference_scenario_key": "s", "alert_level_ranks": [["low", 1]], "states": [], "default_state_key": "d",
    "unknown_state_key": "u", "recent_window": 86_400_000_000, "history_window": 259_200_000_000, "available_time_column": "seen", "peer_group_columns": ["g"], "peer_reference_end": "2024-01-02T00:00:00", "exposure_column": "y", "loss_fraction": 0.5,
    "scenarios": [{"scenario_key": "s", "scenario_kind": "rule_set", "rules": []}],
}


def _rule(key, **atom):
    return {"rule_key": key, "priority": 1, "alert_level": "low", "condition": {"kind": "atomic", "operator": "gt", "right": 0.0} | atom}


def test_warning_documents_use_every_feature_window_and_peer(spark):
    rules = [_rule("rising", left_kind="change", left="y", window="recent"), _rule("high", left_kind="history_mean", left="x"), _rule("apart", left_kind="peer_deviation", left="y")]
    run = g.load_warning_json(json.dumps(WARNING | {"scenarios": [{"scenario_key": "s", "scenario_kind": "rule_set", "rules": rules}]}), key="k")
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    rows = [(1, "a", day(0), 1.0, 5.0, "p", day(0)), (2, "a", day(1), 2.0, 4.0, "p", day(1)), (3, "a", day(5), 3.0, 9.0, "p", day(5)), (4, "b", day(0), -1.0, 1.0, "p", day(9)), (5, "b", day(2), -2.0, 7.0, "p", day(2)), (6, "a", day(5), 4.0, 9.5, None, day(5))]
    df = spark.createDataFrame(rows, "k long, e string, t timestamp_ntz, x double, y double, g string, seen timestamp_ntz")
    result = g.monitor_lifecycle(df, run)
    truth = {(r["k"], r["rule_key"]): r["truth"] for r in result.rule_matrix.collect()}
    # recent: one day back; row 6 follows row 3 at the same time; row 3 has no row within a day
    assert {k: truth[k, "rising"] for k in range(1, 7)} == {1: None, 2: False, 3: None, 4: None, 5: None, 6: True}
    assert {k: truth[k, "high"] for k in range(1, 7)} == {1: None, 2: True, 3: None, 4: None, 5: False, 6: True}
    # the peer mean is 4.5: row 4 was not available by the end of the period; row 6 has no group
    assert {k: truth[k, "apart"] for k in range(1, 7)} == {1: None, 2: None, 3: True, 4: None, 5: True, 6: None}
    loss = {(r["metric"]): (r["value"], r["status"], r["reason"]) for r in result.loss_metrics.collect()}
    assert loss["expected_loss_sum"] == (None, "not_applicable", "source_not_requested") and loss["exposure_sum"][1] == "available"
    for bad in ({"cohort_column": "g"}, {"time_zone": "Asia/Tokyo"}, {"ranking_score_direction": "lower_risk"}, {"condition_feature_columns": []}, {"observed_loss_is_mature_snapshot": True}):
        with pytest.raises(DocumentError):
            g.load_warning_json(json.dumps(WARNING | bad), key="k")
    for atom in ({"left_kind": "column", "left": "x", "window": "recent"}, {"left_kind": "trend", "left": "x", "window": "long"}, {"left_kind": "peer_deviation"}):
        with pytest.raises(DocumentError):
            g.load_warning_json(json.dumps(WARNING | {"scenarios": [{"scenario_key": "s", "scenario_kind": "rule_set", "rules": [_rule("r", **atom)]}]}), key="k")


def test_policies_carry_assumptions_and_refuse_what_is_not_done():
    full = POLICY | {"action_assumptions": [["keep", 3, 1], ["look", 1, 1], ["drop", 0, 0]], "ranking_score_column": "s", "exposure_unit": "EUR", "ranking_score_direction": "higher_risk"}
    policy, none = g.load_v02_json(json.dumps(full))
    assert none is None and policy.action_assumptions[0] == ("keep", 3.0, 1.0) and policy.score_column == "s" and policy.metadata == (("exposure_unit", "EUR"),)
    limit = {"constraint_key": "c", "metric": "selected_rate", "operator": "le", "threshold": 1}
    for bad in (full | {"ranking_score_direction": "up"}, full | {"constraints": [limit | {"action_role": "selected"}]}, full | {"constraints": [limit | {"metric": "other"}]}, full | {"action_assumptions": [["keep", 1, 1]]}):
        with pytest.raises(ValueError):
            g.load_policy_json(json.dumps(bad))
    both = g.load_v02_json(json.dumps(POLICY), json.dumps(WARNING), key="k")
    assert both[0].strategy_key == "s" and both[1].features == ("y",)
    for arguments in ((), (None, json.dumps(WARNING))):
        with pytest.raises(DocumentError):
            g.load_v02_json(*arguments)


def test_reports_and_command_line(spark, tmp_path, capsys):
    rows = "\n".join(f"{i},{'ab'[i % 2]},{i * 0.37 % 5:.3f},{i % 2}" for i in range(60))
    (tmp_path / "c.csv").write_text(f"number,segment,value,label\n{rows}\n")
    assert main(["analyze", str(tmp_path / "c.csv"), "-o", str(tmp_path / "out/report.md"), "--target", "segment", "--task", "classification", "--group-by", "segment"], spark) == 0
    text = (tmp_path / "out/report.md").read_text()
    assert "## Correlations" in text and "## Target" in text
    (tmp_path / "p.json").write_text(json.dumps(POLICY | {"rules": [POLICY["rules"][0] | {"condition": ATOM | {"left": "value", "right": 2.0}}]}))
    assert main(["risk-run", str(tmp_path / "c.csv"), "-o", str(tmp_path / "risk.html"), "--format", "html", "--policy-json", str(tmp_path / "p.json"), "--audit", "--label", "label", "--score", "value"], spark) == 0
    headings = re.findall("<h2>(.*?)</h2>", (tmp_path / "risk.html").read_text())
    assert list(dict.fromkeys(h.split(":")[0] for h in headings))[:12] == list(RISK_SECTIONS) and "Decision strategy: Actions" in headings
    assert (tmp_path / "risk_assets/calibration.csv").read_text().startswith("fold,bin,") and any((tmp_path / "out/report_assets").iterdir())
    assert main(["analyze", str(tmp_path / "c.txt"), "-o", str(tmp_path / "x.md")], spark) == 1
    (tmp_path / "bad.json").write_text("{")
    risk = ["risk-run", str(tmp_path / "c.csv"), "-o", str(tmp_path / "risk2.html"), "--format", "html"]
    assert main([*risk, "--policy-json", str(tmp_path / "bad.json")], spark) == 2
    assert main([*risk, "--policy-json", str(tmp_path / "none.json")], spark) == 3
    (tmp_path / "w.csv").write_text("k,e,t,x\n" + "".join(f"{i},a,2024-01-{1 + i:02d} 00:00:00,{i}\n" for i in range(5)))
    rules = [_rule("r", left_kind="column", left="x")]
    (tmp_path / "w.json").write_text(json.dumps({k: v for k, v in WARNING.items() if k not in ("recent_window", "available_time_column", "peer_group_columns", "peer_reference_end", "exposure_column", "loss_fraction")} | {"condition_feature_columns": ["x"], "scenarios": [{"scenario_key": "s", "scenario_kind": "rule_set", "rules": rules}]}))
    monitored = ["risk-run", str(tmp_path / "w.csv"), "-o", str(tmp_path / "warn.md"), "--warning-json", str(tmp_path / "w.json")]
    assert main(monitored, spark) == 2 and main([*monitored, "--row-key", "k"], spark) == 0
    assert main([*monitored, "--row-key", "k", "--no-overwrite"], spark) == 3
    with pytest.raises(ValueError):
        write_report({}, tmp_path / "a.md", format="html")
    with pytest.raises(FileExistsError):
        write_report({}, tmp_path / "risk.html", format="html", overwrite=False)
    # what was there comes back when the second swap fails
    before, renamed = (tmp_path / "risk.html").read_text(), os.rename
    figure = spark.createDataFrame([(1, 'a "quoted", text')], "x int, t string")

    def fails(a, b):
        if Path(b).name == "risk_assets" and Path(a).name == "assets":
            raise OSError("no space")
        renamed(a, b)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(os, "rename", fails)
        with pytest.raises(OSError):
            write_report({"New": "x"}, tmp_path / "risk.html", format="html", assets={"f": figure})
    assert (tmp_path / "risk.html").read_text() == before and (tmp_path / "risk_assets/calibration.csv").exists() and not list(tmp_path.glob(".report-*"))
    write_report({"New": "x"}, tmp_path / "risk.html", format="html", assets={"f": figure})
    assert sorted(x.name for x in (tmp_path / "risk_assets").iterdir()) == ["f.csv"] and '"a ""quoted"", text"' in (tmp_path / "risk_assets/f.csv").read_text()


def test_audit(spark):
    df = spark.createDataFrame([(1, "a", "train", 5.0, 1, 1), (1, "b", "test", -2.0, 0, 0), (2, "c", "train", None, 1, 1)], "entity long, k string, part string, exposure double, y int, copy int")
    out = g.audit_data_quality(df, roles=g.AuditRoles(target="y", identifier="entity", partition="part", features=("copy", "exposure", "y"), slices=("part",)), config=g.AuditConfig(rules=(g.ColumnAuditRule("exposure", minimum=0),)))
    found = {(f.reason, f.column) for f in out.findings}
    assert {("exact_target_copy", "copy"), ("target_in_features", "y"), ("identifier_partition_overlap", "entity"), ("range_violation", "exposure")} <= found
    again = g.audit_data_quality(df, roles=g.AuditRoles(), reference=df.drop("copy"))
    assert again.schema_drift.first()["change"] == "current_column_added" and len(again.config_fingerprint) == 64


def test_audit_raises_every_finding(spark):
    """Rows made so that each reason has a cause."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    rows = []
    for i in range(80):
        rows.append((i, f"e{i // 2}", f"g{i // 3}" if i < 78 else f"only{i}", "test" if i % 4 == 0 else "train", i % 5, i % 2 if i % 9 and i % 8 else None, float(i), 2.0 * i, -1.0 if i == 3 else 0.5, 1.5 if i == 4 else 0.5, "  " if i == 5 else "k", None if i % 2 else "v", float("inf") if i == 6 else 1.0, day(i // 2), day(2 if i == 7 else i // 2 + 1), day(60), day(i // 2 + (2 if i == 8 else 0)), i % 2))
    names = "key long, entity string, grp string, part string, fold int, y int, a double, b double, exposure double, score double, text string, half string, odd double, seen timestamp_ntz, ended timestamp_ntz, as_of timestamp_ntz, known timestamp_ntz, same int"
    df = spark.createDataFrame(rows, names)
    roles = g.AuditRoles(
        target="y", identifier="entity", group="grp", partition="part", fold="fold", entity="entity", observation_time="seen", key="key", slices=("part", "half"), features=("a", "same", "y", "b", "grp"), post_outcome=("b",), exposure="exposure", scores=("score",),
        outcome_end_time="ended", horizon_end="ended", analysis_as_of="as_of", feature_available_times=(("a", "known"),),
    )
    config = g.AuditConfig(target_shift=0.05, rules=(g.ColumnAuditRule("a", maximum=70.0), g.ColumnAuditRule("text", allowed=("k",)), g.ColumnAuditRule("a", not_after=("b",)), g.ColumnAuditRule("b", nondecreasing=True)))
    reference = df.withColumn("half", F.lit("v")).withColumn("b", F.col("b").cast("string")).drop("odd").withColumn("gone", F.lit(1))
    out = g.audit_data_quality(df, roles=roles, config=config, reference=reference)
    found = {(f.reason, f.column): f for f in out.findings}
    expected = {
        "target_in_features": "y", "post_outcome_feature": "b", "exact_target_copy": "same", "range_violation": "a", "allowed_value_violation": "text", "observation_after_outcome_end": None, "feature_after_observation": "a", "negative_exposure": "exposure", "score_out_of_range": "score",
        "whitespace_only": "text", "high_missing_column": "half", "nonfinite_values": "odd", "target_missing": "y", "group_partition_overlap": "grp", "identifier_partition_overlap": "entity", "fold_partition_inconsistent": "fold", "singleton_group": "grp",
        "duplicate_entity_time": "entity", "collinear_columns": "a, b", "missingness_rate_changed": "half", "dtype_changed": "b", "current_column_added": "odd", "current_column_missing": "gone", "role_column_in_features": "grp", "partial_feature_availability_mapping": "b",
        "suspected_identifier": "key", "near_constant_column": "text", "constant_column": "as_of",
    }
    assert not [x for x in expected.items() if x not in found]
    assert any(f.reason == "target_distribution_shift" for f in out.findings) and any(f.reason == "selection_outcome_support_gap" for f in out.findings)
    assert found["range_violation", "a"].severity == "error" and found["whitespace_only", "text"].severity == "info" and found["nonfinite_values", "odd"].severity == "warning"
    assert found["feature_after_observation", "a"].samples == (8,) and found["whitespace_only", "text"].samples == (5,) and found["observation_after_outcome_end", None].samples == (7,)
    assert [f.severity for f in out.findings] == sorted((f.severity for f in out.findings), key=["error", "warning", "info"].index)
    assert out.links[found["range_violation", "a"].finding_key] == ("rules", "range_violation", "a") and len(out.links) == len(out.findings)
    assert out.findings_table(spark).count() == len(out.findings)
    assert {f.reason for f in g.audit_data_quality(df.limit(0)).findings} == {"empty_dataset"}
    # values of rules stay out of the fingerprint, their number and types do not
    same = g.audit_data_quality(df, config=g.AuditConfig(rules=(g.ColumnAuditRule("text", allowed=("z",)),))).config_fingerprint
    assert same == g.audit_data_quality(df, config=g.AuditConfig(rules=(g.ColumnAuditRule("text", allowed=("k",)),))).config_fingerprint


def test_streaming_machine_equals_batch(spark, tmp_path):
    schema = "entity string, at timestamp, rule_key string, truth boolean, persistence int, resolution int, cooldown long"
    start = dt.datetime(2024, 1, 1)
    truths = [True, True, False, True, None, True, True, False, False, True]
    rows = [("e", start + dt.timedelta(hours=i), "r", t, 2, 1, 0) for i, t in enumerate(truths)]
    source = tmp_path / "in"
    for i in range(0, 10, 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = monitor.notifications_stream(stream, entity="entity", time="at").writeStream.format("memory").queryName("notes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    state, expected = None, []
    for r in rows:
        us = int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1e6)
        state, note = monitor.advance(state, us, r[3], 2, 1, 0, None)
        if note:
            expected.append((r[1], *note))
    found = sorted((r["time"], r["kind"], r["episode_ordinal"], r["notification_ordinal"]) for r in spark.table("notes").collect())
    assert found == sorted(expected) and len(found) == 2
    rates = monitor.windowed_rates(spark.createDataFrame(rows, schema), time="at").first()
    assert (rates["evaluations"], rates["hits"]) == (10, 6)


def test_workflow_needs_a_path(spark):
    from gristmill.operators.workflow import RiskRequest

    with pytest.raises(ValueError):
        g.run_risk_workflow(RiskRequest(spark.range(1).withColumn("z", F.lit(1))))
