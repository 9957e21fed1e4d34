"""A PySpark-native engine for profiling, auditing and risk analytics of tables."""

from .operators.analysis import analyze_categorical_features, analyze_numeric_features, analyze_target_relationships, compare_groups, compute_correlations, detect_outliers
from .operators.audit import AuditConfig, AuditRoles, ColumnAuditRule, audit_data_quality
from .operators.features import derive_features, suggest_feature_derivations
from .operators.governance import Criterion, GovernancePolicy, evaluate_governance
from .operators.lifecycle import LifecycleConfig, LifecycleState, WarningRule, WarningScenario, monitor_lifecycle
from .operators.modeling import evaluate_classifier, evaluate_model, evaluate_regressor, train_classifier, train_regressor
from .operators.plotdata import (
    plot_binary_risk_validation,
    plot_classification_evaluation,
    plot_correlations,
    plot_distributions,
    plot_group_comparison,
    plot_missingness,
    plot_model_governance,
    plot_outliers,
    plot_regression_evaluation,
    plot_target_relationships,
)
from .operators.profile import infer_schema, summarize_dataframe
from .operators.quality import check_data_quality
from .operators.risk import RiskValidationConfig, TimePlan, validate_binary_risk, validate_predictions
from .operators.strategy import DecisionConstraint, DecisionRule, DecisionStrategyConfig, simulate_decision_strategy
from .operators.workflow import generate_analysis_report, generate_risk_report, run_analysis, run_risk_workflow
from .plans.conditions import Condition
from .sources import load_csv, load_excel, load_parquet, load_policy_json, load_v02_json, load_warning_json

#: One condition type serves strategies and monitoring; these are its names there.
StrategyCondition = MonitoringCondition = Condition
EarlyWarningRule, LifecycleMonitoringConfig = WarningRule, LifecycleConfig

__version__ = "0.1.0"

__all__ = [name for name in dir() if name[0] != "_"]
