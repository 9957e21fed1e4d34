"""Schema inference and table summaries: one aggregate over the table, then rules over a few rows."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_datetime, is_floating, is_numeric, present
from ..plans.distinct import distinct_counts
from ..plans.quantiles import quantiles
from ..plans.shapes import check_columns, small, tall

# Logical types, thresholds and name signals of schema inference.
LOGICAL_TYPES = ("numeric", "categorical", "datetime", "boolean", "text", "identifier", "unknown")
ID_THRESHOLD = 0.98
DATE_SHARE = 0.80
CATEGORY_RATE, CATEGORY_LEVELS = 0.5, 50
ID_TOKENS = ("id", "key", "uuid")
TARGET_NAMES = ("target", "y", "label", "outcome")
TARGET_LEVELS = 20
#: Spark parses dates by pattern, so the accepted ones are listed.
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "yyyyMMdd")


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    spark_type: str
    logical_type: str
    nullable: bool
    missing_count: int
    missing_rate: float
    unique_count: int
    unique_rate: float
    is_constant: bool
    is_id_like: bool
    confidence: float
    reasons: tuple[str, ...]


@dataclass(frozen=True)
class TargetCandidate:
    name: str
    suggested_task_type: str
    confidence: float
    reasons: tuple[str, ...]


@dataclass(frozen=True)
class SchemaReport:
    n_rows: int
    n_columns: int
    columns: tuple[ColumnSchema, ...]
    logical_type_counts: dict[str, int]
    target_candidates: tuple[TargetCandidate, ...] = field(default=())

    def column(self, name: str) -> ColumnSchema:
        return next(c for c in self.columns if c.name == name)

    def of_type(self, *logical: str) -> list[str]:
        return [c.name for c in self.columns if c.logical_type in logical]


def parsed_date(column: Column) -> Column:
    """The time that one of the patterns reads; a text is tried only by the pattern whose shape it has, since a
    failed attempt costs far more than a look."""
    shapes = {p: "^" + re.sub("[A-Za-z]", r"[0-9]", p.replace("'T'", "\0")).replace(".", r"\.").replace("\0", "T") + "$" for p in DATE_PATTERNS}
    return F.coalesce(*[F.when(column.rlike(shape), F.try_to_timestamp(column, F.lit(p))) for p, shape in shapes.items()])


def name_tokens(name: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def infer_schema(df: DataFrame, *, target: str | None = None, id_threshold: float = ID_THRESHOLD, approximate: float | None = None) -> SchemaReport:
    """Logical types by rules over one aggregate; the first rule that fits counts.

    Distinct counts are those of ``plans.distinct``; with ``approximate`` (a relative error) they are
    sketches within the one scan.
    An empty table gives unknown columns.
    """
    names = check_columns(df)
    if target is not None and target not in names:
        raise ValueError(f"unknown column: {target}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        c = present(name, kinds[name])
        aggregates.append(F.count(c).alias(f"p{i}"))
        if approximate:
            aggregates.append(F.approx_count_distinct(c, approximate).alias(f"u{i}"))
        if isinstance(kinds[name], T.StringType):
            aggregates.append(F.count_if(F.lower(F.trim(c)).isin("true", "false")).alias(f"b{i}"))
            aggregates.append(F.count_if(parsed_date(F.trim(c)).isNotNull()).alias(f"d{i}"))
    row = df.agg(*aggregates).first()
    n = row["n"]
    exact = {} if approximate else distinct_counts(df, {name: present(name, kinds[name]) for name in names})
    columns = []
    for i, name in enumerate(names):
        kind, there = kinds[name], row[f"p{i}"]
        unique = min(row[f"u{i}"], there) if approximate else exact[name]
        rate = unique / there if there else 0.0
        text = isinstance(kind, T.StringType)
        logical, confidence, reason, identifies = _logical(name, kind, n, there, unique, rate, row[f"b{i}"] if text else 0, row[f"d{i}"] if text else 0, id_threshold)
        columns.append(ColumnSchema(name, kind.simpleString(), logical, there < n, n - there, (n - there) / n if n else 0.0, unique, rate, there > 0 and unique == 1, identifies, confidence, (reason,)))
    counts = {t: sum(c.logical_type == t for c in columns) for t in LOGICAL_TYPES}
    return SchemaReport(n, len(names), tuple(columns), counts, _candidates(columns, target))


def _logical(name: str, kind: T.DataType, n: int, there: int, unique: int, rate: float, booleans: int, dates: int, threshold: float) -> tuple[str, float, str, bool]:
    if not n:
        return "unknown", 0.5, "empty_dataframe", False
    if not there:
        return "unknown", 0.5, "all_missing", False
    if isinstance(kind, T.BooleanType):
        return "boolean", 1.0, "boolean_dtype", False
    text = isinstance(kind, T.StringType)
    if text and booleans == there:
        return "boolean", 0.8, "boolean_strings", False
    if is_datetime(kind):
        return "datetime", 1.0, "datetime_dtype", False
    if text and dates >= DATE_SHARE * there:
        return "datetime", 0.85, "date_strings", False
    named = any(t in ID_TOKENS for t in name_tokens(name))
    whole = isinstance(kind, T.IntegralType) or text
    if rate >= threshold and (named or (unique == there and whole)):
        return "identifier", 0.9, "identifier_like", True
    if is_numeric(kind):
        return "numeric", 1.0, "numeric_dtype", False
    if text:
        few = rate <= CATEGORY_RATE or unique <= CATEGORY_LEVELS
        return ("categorical", 0.8, "low_cardinality", False) if few else ("text", 0.8, "high_cardinality", False)
    return "unknown", 0.5, "fallback_unknown", False


def _candidates(columns: list[ColumnSchema], target: str | None) -> tuple[TargetCandidate, ...]:
    found = []
    for c in columns:
        named = c.name.lower() in TARGET_NAMES
        if c.name != target and not named:
            continue
        few = c.logical_type in ("categorical", "boolean") or c.unique_count <= TARGET_LEVELS
        found.append(TargetCandidate(c.name, "classification" if few else "regression", 1.0 if c.name == target else 0.8, ("explicit_target",) if c.name == target else ("name_signal",)))
    return tuple(found)


_SCHEMA = "position int, column string, logical_type string, missing_count long, missing_rate double, unique_count long, unique_rate double, is_constant boolean, is_id_like boolean, confidence double, reason string"


def schema_table(df: DataFrame, report: SchemaReport) -> DataFrame:
    rows = [(i, c.name, c.logical_type, c.missing_count, c.missing_rate, c.unique_count, c.unique_rate, c.is_constant, c.is_id_like, c.confidence, c.reasons[0]) for i, c in enumerate(report.columns)]
    return small(df.sparkSession, rows, _SCHEMA)


@dataclass(frozen=True)
class DataFrameSummary:
    n_rows: int
    n_columns: int
    memory_usage_bytes: int | None
    total_missing_cells: int
    total_missing_rate: float
    schema: SchemaReport
    column_summary: DataFrame


def _plan_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the table's size; Spark has no exact figure."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:
        return None


def summarize_dataframe(df: DataFrame, *, schema: SchemaReport | None = None) -> DataFrameSummary:
    """Missing cells, and per column the schema's figures with min, max, mean, sample deviation and quartiles.

    Quartiles interpolate linearly.  Columns that are not numeric have null statistics.
    """
    report = schema or infer_schema(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    missing = sum(c.missing_count for c in report.columns)
    cells = report.n_rows * report.n_columns
    numeric = [c.name for c in report.columns if is_numeric(kinds[c.name]) and c.missing_count < report.n_rows]
    base = schema_table(df, report)
    stats = "min double, max double, mean double, std double, q25 double, median double, q75 double"
    if numeric:
        figures = {}
        for name in numeric:
            c = present(name, kinds[name]).cast("double")
            figures[name] = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "std": F.stddev_samp(c)}
        distinct = sum(c.unique_count for c in report.columns if c.name in numeric)
        middle = quantiles(df, {n: present(n, kinds[n]) for n in numeric}, distinct=distinct).toDF("column", "q25", "median", "q75")
        extra = tall(df, figures).drop("position").join(F.broadcast(middle), "column")  # a row a column
    else:
        extra = small(df.sparkSession, [], f"column string, {stats}")
    joined = base.join(F.broadcast(extra), "column", "left")
    return DataFrameSummary(report.n_rows, report.n_columns, _plan_bytes(df), missing, missing / cells if cells else 0.0, report, joined)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_floating(f.dataType)]
