"""Composite runs: an analysis of one table, and the risk workflow in its fixed order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_numeric
from ..sources.report import ReportArtifact, write_report
from . import analysis, audit, features, governance, lifecycle, modeling, plotdata, profile, quality, risk, strategy


@dataclass(frozen=True)
class AnalysisRun:
    schema: profile.SchemaReport
    summary: profile.DataFrameSummary
    quality: quality.QualityReport
    numeric_analysis: analysis.NumericAnalysis
    categorical_analysis: analysis.CategoricalAnalysis
    correlation_analysis: analysis.CorrelationAnalysis
    outlier_analysis: analysis.OutlierAnalysis
    group_comparison: analysis.GroupComparison | None
    target_analysis: analysis.TargetAnalysis | None
    feature_suggestions: features.FeatureSuggestionReport
    training: modeling.TrainingResult | None
    evaluation: modeling.ModelEvaluation | None
    plots: tuple[plotdata.PlotData, ...]
    skipped: dict[str, str]
    data: DataFrame


def _step(name: str, run):
    try:
        return run()
    except ValueError as error:
        raise ValueError(f"{name}: {error}") from error


def run_analysis(df: DataFrame, *, target: str | None = None, task: str | None = None, include_model: bool = False, id_columns: Sequence[str] = (), exclude_columns: Sequence[str] = (), group_by: str | None = None, reference_date: dt.date | None = None, max_suggestions: int = 50) -> AnalysisRun:
    """Schema, summary, quality and analyses of the columns that are neither target nor excluded."""
    if target is not None and task not in ("classification", "regression"):
        raise ValueError("a target needs a task")
    if include_model and target is None:
        raise ValueError("a model needs a target")
    out = {target, *id_columns, *exclude_columns}
    scope = df.select(*[c for c in df.columns if c not in out])
    schema = _step("schema", lambda: profile.infer_schema(df, target=target))
    numeric = [c for c in scope.columns if is_numeric(scope.schema[c].dataType)]
    skipped = {}
    if group_by is None:
        skipped["group_comparison"] = "no_group"
    if target is None:
        skipped["target_analysis"] = "no_target"
    groups = _step("groups", lambda: analysis.compare_groups(df, group_by, values=[c for c in numeric if c != group_by])) if group_by else None
    related = _step("target", lambda: analysis.analyze_target_relationships(df, target, task=task, features=scope.columns)) if target else None
    correlations = _step("correlations", lambda: analysis.compute_correlations(scope, columns=numeric))
    outliers = _step("outliers", lambda: analysis.detect_outliers(scope, columns=numeric))
    training = evaluation = None
    if include_model:
        train = modeling.train_classifier if task == "classification" else modeling.train_regressor
        training = _step("training", lambda: train(df, target, exclude_columns=[*id_columns, *exclude_columns], keys=id_columns))
        evaluation = _step("evaluation", lambda: modeling.evaluate_model(training))
    plots = [*plotdata.plot_distributions(scope), plotdata.plot_missingness(scope), plotdata.plot_correlations(correlations), plotdata.plot_outliers(outliers)]
    if groups:
        plots.append(plotdata.plot_group_comparison(groups))
    if related:
        plots += plotdata.plot_target_relationships(related)
    return AnalysisRun(
        schema, profile.summarize_dataframe(df, schema=schema), _step("quality", lambda: quality.check_data_quality(df, schema=schema)), _step("numeric", lambda: analysis.analyze_numeric_features(scope)), _step("categorical", lambda: analysis.analyze_categorical_features(scope)), correlations, outliers, groups, related,
        _step("features", lambda: features.suggest_feature_derivations(df, schema=schema, target=target, exclude_columns=[*id_columns, *exclude_columns], reference_date=reference_date, max_suggestions=max_suggestions)), training, evaluation, tuple(plots), skipped, df,
    )


def generate_analysis_report(run: AnalysisRun, output_path: str, *, title: str = "Analysis report", format: str = "markdown", overwrite: bool = True) -> ReportArtifact:
    sections: dict[str, object] = {
        "Overview": f"{run.schema.n_rows} rows, {run.schema.n_columns} columns, {run.summary.total_missing_cells} missing cells",
        "Columns": run.summary.column_summary, "Quality": quality.issue_table(run.data, run.quality), "Numeric columns": run.numeric_analysis.summary, "Categorical columns": run.categorical_analysis.summary,
        "Top categories": run.categorical_analysis.top_categories, "Correlations": run.correlation_analysis.correlations, "Outliers": run.outlier_analysis.summary,
    }
    if run.group_comparison:
        sections["Groups"] = run.group_comparison.summary
    if run.target_analysis:
        sections["Target"] = run.target_analysis.statistical_tests
    sections["Feature suggestions"] = features.suggestion_table(run.data, run.feature_suggestions)
    if run.evaluation:
        sections["Model"] = run.evaluation.metrics
    figures = {f"{i:02d}-{p.chart_type}-{p.source}": p.data for i, p in enumerate(run.plots)}
    return write_report(sections, output_path, title=title, format=format, overwrite=overwrite, assets=figures)


@dataclass(frozen=True)
class RiskRequest:
    """What to run; at least one of score validation, strategy and monitoring."""

    data: DataFrame
    audit_roles: audit.AuditRoles | None = None
    audit_config: audit.AuditConfig | None = None
    score: tuple[str, str, str | None] | None = None  # label, score, probability
    risk_config: risk.RiskValidationConfig | None = None
    strategy: strategy.DecisionStrategyConfig | None = None
    lifecycle: lifecycle.LifecycleConfig | None = None
    governance: governance.GovernancePolicy | None = None
    evidence: DataFrame | None = None
    keep: tuple[str, ...] = ()


@dataclass(frozen=True)
class RiskWorkflowResult:
    audit: audit.DataAudit | None
    score_validation: risk.BinaryRiskValidation | None
    strategy: strategy.DecisionStrategyResult | None
    lifecycle: lifecycle.LifecycleResult | None
    governance: governance.GovernanceResult | None
    path_status: dict[str, str] = field(default_factory=dict)


def run_risk_workflow(request: RiskRequest) -> RiskWorkflowResult:
    """Audit, score validation, strategy, monitoring, governance: always in this order."""
    if request.score is None and request.strategy is None and request.lifecycle is None:
        raise ValueError("no_primary_path")
    df = request.data
    audited = audit.audit_data_quality(df, roles=request.audit_roles, config=request.audit_config) if request.audit_roles or request.audit_config else None
    scored = risk.validate_predictions(df, request.score[0], request.score[1], config=request.risk_config or risk.RiskValidationConfig(), probability=request.score[2]) if request.score else None
    decided = strategy.simulate_decision_strategy(df, request.strategy, keep=request.keep) if request.strategy else None
    monitored = lifecycle.monitor_lifecycle(df, request.lifecycle) if request.lifecycle else None
    governed = governance.evaluate_governance(request.governance, request.evidence) if request.governance and request.evidence is not None else None
    parts = {"audit": audited, "score_validation": scored, "strategy": decided, "lifecycle": monitored, "governance": governed}
    return RiskWorkflowResult(audited, scored, decided, monitored, governed, {k: "completed" if v is not None else "not_requested" for k, v in parts.items()})


#: Sections of the report, always all of them and in this order.
RISK_SECTIONS = ("Run", "Paths", "Score validation", "Data audit", "Decision strategy", "Lifecycle monitoring", "Governance", "Across paths", "Reasons", "Stability", "Warnings", "Provenance")


def _reasons(result: RiskWorkflowResult) -> DataFrame | None:
    """How many measures of each table have no value, and why."""
    tables = []
    if result.strategy:
        tables += [("rules", result.strategy.rule_summary), ("actions", result.strategy.action_summary), ("roles", result.strategy.business_summary)]
    if result.lifecycle:
        tables += [("warnings", result.lifecycle.warning_metrics), ("events", result.lifecycle.event_metrics), ("losses", result.lifecycle.loss_metrics)]
    out = None
    for name, table in tables:
        part = table.where("status <> 'available'").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("measures")).select(F.lit(name).alias("table"), "status", "reason", "measures")
        out = part if out is None else out.unionByName(part)
    return out


def generate_risk_report(result: RiskWorkflowResult, output_path: str, *, title: str = "Risk report", format: str = "markdown", overwrite: bool = True) -> ReportArtifact:
    """Twelve sections in a fixed order; a path that did not run says so.  Figures are their data, written beside the report."""
    score, audited, decided, watched, governed = result.score_validation, result.audit, result.strategy, result.lifecycle, result.governance
    absent = "not requested"
    small_note = lambda items: "\n".join(items) or "none"
    across = [f"{k}: {v}" for k, v in result.path_status.items() if v == "completed"]
    warnings = [f"{f.severity}: {f.reason} {f.column or ''} ({f.count})" for f in audited.findings if f.severity != "info"] if audited else []
    warnings += [f"score validation: {x}" for x in score.limitations] if score else []
    content: dict[str, dict[str, object]] = {
        "Run": {"": f"{len(across)} of {len(result.path_status)} paths completed"},
        "Paths": {"": ", ".join(f"{k}: {v}" for k, v in result.path_status.items())},
        "Score validation": {"Metrics": score.metrics, "Thresholds": score.thresholds, "Gains": score.gains, "Calibration": score.calibration} if score else {"": absent},
        "Data audit": {"Findings": small_note([f"{f.severity}: {f.reason} {f.column or ''} ({f.count})" for f in audited.findings]), "Columns": audited.columns} if audited else {"": absent},
        "Decision strategy": {"Actions": decided.action_summary, "Rules": decided.rule_summary, "Roles": decided.business_summary} | ({"Constraints": decided.constraints} if decided.constraints is not None else {}) if decided else {"": absent},
        "Lifecycle monitoring": {"Warnings": watched.warning_metrics, "Events": watched.event_metrics, "Losses": watched.loss_metrics, "Episodes": watched.episode_summary} if watched else {"": absent},
        "Governance": {"Comparison": governed.comparison, "Recommendation": governed.recommendation} if governed else {"": absent},
        "Across paths": {"": small_note(across)},
        "Reasons": {"": _reasons(result) if decided or watched else absent},
        "Stability": {"Folds": score.fold_summary} if score else {"Scenarios": watched.scenario_comparison} if watched else {"": absent},
        "Warnings": {"": small_note(warnings)},
        "Provenance": {"": small_note([f"audit {audited.config_fingerprint}"] if audited else [])},
    }
    figures = {}
    if score:
        figures = {"calibration": score.calibration, "gains": score.gains, "thresholds": score.thresholds}
    sections = {(f"{name}: {part}" if part else name): x for name in RISK_SECTIONS for part, x in content[name].items()}
    return write_report(sections, output_path, title=title, format=format, overwrite=overwrite, assets=figures)
