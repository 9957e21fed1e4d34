"""Data quality issues of a table, in table-then-code-then-column order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import infinite, is_floating, present
from ..plans.shapes import check_columns, small
from .profile import SchemaReport, infer_schema, parsed_date

# Issue codes with their severities, and thresholds.
SEVERITY = {
    "empty_dataframe": "warning",
    "duplicate_rows": "warning",
    "all_missing_column": "warning",
    "high_missing_column": "warning",
    "constant_column": "warning",
    "near_constant_column": "info",
    "high_cardinality_categorical": "info",
    "identifier_like_column": "info",
    "infinite_values": "warning",
    "mixed_python_types": "warning",
    "datetime_parse_failures": "info",
}
MISSING_THRESHOLD, NEAR_CONSTANT, HIGH_LEVELS, HIGH_RATE = 0.40, 0.95, 50, 0.5


@dataclass(frozen=True)
class QualityIssue:
    code: str
    severity: str
    scope: str
    column: str | None
    count: int
    ratio: float
    threshold: float | None
    message: str
    suggestion: str


@dataclass(frozen=True)
class QualityReport:
    n_rows: int
    n_columns: int
    issue_count: int
    severity_counts: dict[str, int]
    issues: tuple[QualityIssue, ...]


def _issue(code: str, column: str | None, count: int, ratio: float, threshold: float | None, message: str, suggestion: str, severity: str | None = None) -> QualityIssue:
    return QualityIssue(code, severity or SEVERITY[code], "column" if column else "dataset", column, count, ratio, threshold, message, suggestion)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(duplicate_rows): members of groups of equal rows, all of them counted; nulls and NaNs equal themselves."""
    keys = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*keys).groupBy(*[f"`{n}`" for n in df.columns]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_rows"))


def top_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, top_count, non_missing): the most frequent value's rows by column, one shuffle for all columns.

    Values meet as hashes of their type-tagged text, counted map-side first.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(n).alias("column"), F.xxhash64(present(n, kinds[n])).alias("h"), present(n, kinds[n]).isNull().alias("missing")) for n in columns])
    counted = df.select(F.explode(cells).alias("c")).select("c.*").where("not missing").groupBy("column", "h").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("column").agg(F.max("n").alias("top_count"), F.sum("n").alias("non_missing"))


def check_data_quality(df: DataFrame, *, schema: SchemaReport | None = None, missing_threshold: float = MISSING_THRESHOLD) -> QualityReport:
    names = check_columns(df)
    report = schema or infer_schema(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n = report.n_rows
    if not n or not names:
        hard = not n and not names
        issues = [_issue("empty_dataframe", None, n, 0.0, None, "the table has no rows or no columns", "load data first", "error" if hard else "warning")]
        return _report(n, len(names), issues)
    issues = []
    copies = duplicate_rows(df).first()[0]
    if copies:
        issues.append(_issue("duplicate_rows", None, copies, copies / n, None, "rows occur more than once", "drop or explain duplicates"))
    filled = [c for c in report.columns if c.missing_count < n]
    for c in report.columns:
        if c.missing_count == n:
            issues.append(_issue("all_missing_column", c.name, n, 1.0, None, "no value is present", "drop the column"))
    for c in filled:
        if c.missing_rate >= missing_threshold:
            issues.append(_issue("high_missing_column", c.name, c.missing_count, c.missing_rate, missing_threshold, "many values are missing", "impute or drop"))
    for c in filled:
        if c.is_constant:
            issues.append(_issue("constant_column", c.name, n - c.missing_count, 1.0, None, "one value only", "drop the column"))
    varied = [c.name for c in filled if not c.is_constant]
    tops = {r["column"]: r for r in top_shares(df, varied).collect()} if varied else {}  # a row a column
    for name in varied:
        top = tops[name]
        share = top["top_count"] / top["non_missing"]
        if share >= NEAR_CONSTANT:
            issues.append(_issue("near_constant_column", name, top["top_count"], share, NEAR_CONSTANT, "one value prevails", "check whether it informs"))
    for c in filled:
        if c.logical_type == "categorical" and c.unique_count > HIGH_LEVELS and c.unique_rate > HIGH_RATE:
            issues.append(_issue("high_cardinality_categorical", c.name, c.unique_count, c.unique_rate, HIGH_RATE, "many levels", "group levels"))
    for c in filled:
        if c.is_id_like:
            issues.append(_issue("identifier_like_column", c.name, c.unique_count, c.unique_rate, None, "values identify rows", "keep it out of features"))
    floats = [x for x in names if is_floating(kinds[x])]
    dates = [c.name for c in filled if c.logical_type == "datetime" and isinstance(kinds[c.name], T.StringType)]
    if floats or dates:
        odd = df.agg(*[F.count_if(infinite(F.col(f"`{x}`"))).alias(f"i{i}") for i, x in enumerate(floats)], *[F.count_if(F.col(f"`{x}`").isNotNull() & parsed_date(F.trim(F.col(f"`{x}`"))).isNull()).alias(f"d{i}") for i, x in enumerate(dates)]).first()
        for i, name in enumerate(floats):
            if odd[f"i{i}"]:
                issues.append(_issue("infinite_values", name, odd[f"i{i}"], odd[f"i{i}"] / n, None, "infinite values", "replace them"))
        for i, name in enumerate(dates):
            if odd[f"d{i}"]:
                issues.append(_issue("datetime_parse_failures", name, odd[f"d{i}"], odd[f"d{i}"] / n, None, "some dates do not parse", "mend them"))
    return _report(n, len(names), issues)


def _report(n: int, columns: int, issues: list[QualityIssue]) -> QualityReport:
    counts = {s: sum(i.severity == s for i in issues) for s in ("error", "warning", "info")}
    return QualityReport(n, columns, len(issues), counts, tuple(issues))


def issue_table(df: DataFrame, report: QualityReport) -> DataFrame:
    rows = [(i, x.code, x.severity, x.scope, x.column, x.count, x.ratio) for i, x in enumerate(report.issues)]
    return small(df.sparkSession, rows, "position int, code string, severity string, scope string, column string, count long, ratio double")
