"""Feature suggestions from a schema, and derivation as plain projections."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_datetime, is_numeric, present
from ..plans.shapes import check_columns, small
from .profile import SchemaReport, infer_schema

# Budgets by feature type, in the order in which suggestions are made.
BUDGETS = {"datetime": 20, "ratio": 10, "difference": 10, "product": 10, "binning": 5, "group_aggregate": 5, "target_encoding": 5}
NEEDS_FIT = ("binning", "group_aggregate", "target_encoding")
DATE_PARTS = ("year", "month", "quarter", "dayofweek", "is_weekend")


@dataclass(frozen=True)
class FeatureSuggestion:
    name: str
    feature_type: str
    source_columns: tuple[str, ...]
    formula: str
    parameters: dict[str, object] = field(default_factory=dict)
    reason: str = ""
    risk: str = ""
    requires_fit: bool = False
    priority: int = 0


@dataclass(frozen=True)
class FeatureSuggestionReport:
    n_rows: int
    requested_target: str | None
    requested_exclusions: tuple[str, ...]
    reference_date: dt.date | None
    eligible_columns: tuple[str, ...]
    excluded_columns: tuple[str, ...]
    skipped_reasons: dict[str, str]
    max_suggestions: int
    type_budgets: dict[str, int]
    available_counts: dict[str, int]
    available_suggestion_count: int
    truncated: bool
    suggestions: tuple[FeatureSuggestion, ...]


@dataclass(frozen=True)
class FeatureDerivationResult:
    data: DataFrame
    applied_suggestions: tuple[FeatureSuggestion, ...]
    skipped_suggestions: tuple[FeatureSuggestion, ...]
    skipped_reasons: dict[str, str]


def duplicate_columns(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Columns equal to an earlier one of the same type, in one aggregate over all pairs of a type."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    pairs = [(a, b) for a, b in combinations(names, 2) if kinds[a] == kinds[b]]
    if not pairs:
        return {}
    row = df.agg(*[F.every(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"e{i}") for i, (a, b) in enumerate(pairs)]).first()
    found: dict[str, str] = {}
    for i, (a, b) in enumerate(pairs):
        if row[f"e{i}"] and a not in found:
            found.setdefault(b, a)
    return found


def suggest_feature_derivations(df: DataFrame, *, schema: SchemaReport | None = None, target: str | None = None, exclude_columns: Sequence[str] = (), reference_date: dt.date | None = None, max_suggestions: int = 50) -> FeatureSuggestionReport:
    """Arithmetic pairs, date parts and ideas that need fitting, within a budget for each type."""
    names = check_columns(df)
    report = schema or infer_schema(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    reasons: dict[str, str] = {}
    for c in report.columns:
        if c.name == target:
            reasons[c.name] = "target_column"
        elif c.name in exclude_columns:
            reasons[c.name] = "explicitly_excluded"
        elif c.is_id_like:
            reasons[c.name] = "identifier_like"
        elif c.missing_count == report.n_rows:
            reasons[c.name] = "all_missing"
        elif c.is_constant:
            reasons[c.name] = "constant"
        elif c.logical_type not in ("numeric", "categorical", "datetime", "boolean", "text"):
            reasons[c.name] = "unsupported_dtype"
    left = [n for n in names if n not in reasons]
    reasons |= dict.fromkeys(duplicate_columns(df, left), "duplicate_content")
    left = [n for n in left if n not in reasons]
    numeric = [n for n in left if is_numeric(kinds[n])]
    dates = [n for n in left if is_datetime(kinds[n])]
    levels = [n for n in left if report.column(n).logical_type in ("categorical", "boolean")]
    made: dict[str, list[FeatureSuggestion]] = {k: [] for k in BUDGETS}
    for n in dates:
        for part in DATE_PARTS:
            made["datetime"].append(FeatureSuggestion(f"{n}__{part}", "datetime", (n,), f"{part}({n})", {"part": part}, "calendar part"))
        if reference_date is not None:
            made["datetime"].append(FeatureSuggestion(f"{n}__days_since__{reference_date:%Y_%m_%d}", "datetime", (n,), f"days from {n} to {reference_date}", {"part": "days_since", "reference_date": reference_date}, "age"))
    for a, b in combinations(numeric, 2):
        made["ratio"].append(FeatureSuggestion(f"{a}__div__{b}", "ratio", (a, b), f"{a} / {b}", {}, "relative size", "null over zero"))
        made["difference"].append(FeatureSuggestion(f"{a}__minus__{b}", "difference", (a, b), f"{a} - {b}", {}, "gap"))
        made["product"].append(FeatureSuggestion(f"{a}__times__{b}", "product", (a, b), f"{a} * {b}", {}, "interaction"))
    for n in numeric:
        made["binning"].append(FeatureSuggestion(f"{n}__binned", "binning", (n,), f"bins of {n}", {}, "nonlinearity", "fit on training rows", True))
    for g in levels:
        for n in numeric[:1]:
            made["group_aggregate"].append(FeatureSuggestion(f"{n}__mean_by__{g}", "group_aggregate", (n, g), f"mean of {n} by {g}", {}, "context", "fit on training rows", True))
        if target is not None:
            made["target_encoding"].append(FeatureSuggestion(f"{g}__target_encoded", "target_encoding", (g,), f"encoded {g}", {}, "levels", "leaks unless fitted in folds", True))
    counts = {k: len(v) for k, v in made.items()}
    kept = [s for k, v in made.items() for s in v[: BUDGETS[k]]]
    kept = kept[:max_suggestions]
    kept = [FeatureSuggestion(**{**s.__dict__, "priority": i}) for i, s in enumerate(kept)]
    total = sum(counts.values())
    return FeatureSuggestionReport(report.n_rows, target, tuple(exclude_columns), reference_date, tuple(left), tuple(reasons), reasons, max_suggestions, dict(BUDGETS), counts, total, len(kept) < total, tuple(kept))


def _bounded(column: Column) -> Column:
    """Null where a result is not finite."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), F.lit(None)).otherwise(column)


def expression(s: FeatureSuggestion, df: DataFrame) -> Column:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if s.feature_type == "datetime":
        c = F.col(f"`{s.source_columns[0]}`")
        part = s.parameters["part"]
        if part == "days_since":
            return F.datediff(F.lit(s.parameters["reference_date"]), F.to_date(c)).cast("double")
        plain = {"year": F.year(c), "month": F.month(c), "quarter": F.quarter(c), "dayofweek": F.weekday(c), "is_weekend": F.when(c.isNotNull(), (F.weekday(c) >= 5).cast("int"))}
        return plain[part].cast("double")
    a, b = (present(n, kinds[n]).cast("double") for n in s.source_columns)
    if s.feature_type == "ratio":
        return _bounded(F.try_divide(a, b))
    return _bounded(a - b if s.feature_type == "difference" else a * b)


def derive_features(df: DataFrame, suggestions: Sequence[FeatureSuggestion] | FeatureSuggestionReport) -> FeatureDerivationResult:
    """One projection for all suggestions that need no fitting; name clashes and missing sources are skipped."""
    wanted = suggestions.suggestions if isinstance(suggestions, FeatureSuggestionReport) else tuple(suggestions)
    applied, skipped, taken = [], {}, set(df.columns)
    for s in wanted:
        if s.requires_fit or s.feature_type in NEEDS_FIT:
            skipped[s.name] = "requires_fit"
        elif any(c not in df.columns for c in s.source_columns):
            skipped[s.name] = "missing_source_column"
        elif s.name in taken:
            skipped[s.name] = "name_collision"
        else:
            taken.add(s.name)
            applied.append(s)
    data = df.select("*", *[expression(s, df).alias(s.name) for s in applied])
    return FeatureDerivationResult(data, tuple(applied), tuple(s for s in wanted if s.name in skipped), skipped)


def suggestion_table(df: DataFrame, report: FeatureSuggestionReport) -> DataFrame:
    rows = [(s.priority, s.name, s.feature_type, ",".join(s.source_columns), s.requires_fit) for s in report.suggestions]
    return small(df.sparkSession, rows, "priority int, name string, feature_type string, sources string, requires_fit boolean")
