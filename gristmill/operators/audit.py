"""Data audit: profiles, slices, missingness, drift, rules, leakage, overlap and point-in-time checks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import correlation, finite, infinite, is_categorical, is_datetime, is_floating, is_numeric, present, ratio
from ..plans.distinct import _SALT
from ..plans.quantiles import quantiles
from ..plans.scopes import scoped
from ..plans.shapes import check_columns, small, tall
from .analysis import frequencies
from .profile import infer_schema
from .quality import duplicate_rows

# Thresholds, severities by finding (all others are warnings), and relations between times.
HIGH_MISSING, NEAR_CONSTANT, COLLINEAR, NEAR_COPY, COPY_ROWS, PAIR_ROWS, MAX_PATTERNS, RARE_CLASS = 0.4, 0.95, 0.999, 0.99, 2, 20, 100, 0.05
ERRORS = (
    "empty_dataset", "all_missing_column", "datetime_role_mismatch", "audit_input_dtype_mismatch", "target_constant", "target_non_binary", "target_in_features", "exact_target_copy", "post_outcome_feature", "range_violation",
    "allowed_value_violation", "cross_column_order_violation", "monotonic_time_violation", "feature_after_observation", "observation_after_outcome_end", "event_before_observation", "event_after_outcome_end",
    "label_before_outcome_end", "observation_at_or_after_cutoff", "feature_after_cutoff", "window_start_after_window_end", "window_end_after_analysis_as_of", "horizon_end_after_analysis_as_of",
)
INFOS = ("duplicate_index", "high_cardinality_column", "suspected_identifier", "whitespace_only", "target_distribution_shift", "singleton_group", "budget_exceeded")
#: (earlier, later, whether they may be equal, reason), by role
CHRONOLOGY = (
    ("observation_time", "outcome_end_time", True, "observation_after_outcome_end"), ("observation_time", "event_time", True, "event_before_observation"), ("event_time", "outcome_end_time", True, "event_after_outcome_end"),
    ("outcome_end_time", "label_available_time", True, "label_before_outcome_end"), ("observation_time", "partition_cutoff", False, "observation_at_or_after_cutoff"), ("window_start", "window_end", True, "window_start_after_window_end"),
    ("window_end", "analysis_as_of", True, "window_end_after_analysis_as_of"), ("horizon_end", "analysis_as_of", True, "horizon_end_after_analysis_as_of"),
)


def severity(reason: str) -> str:
    return "error" if reason in ERRORS else "info" if reason in INFOS else "warning"


@dataclass(frozen=True)
class ColumnAuditRule:
    column: str
    minimum: float | None = None
    maximum: float | None = None
    minimum_inclusive: bool = True
    maximum_inclusive: bool = True
    allowed: tuple[object, ...] = ()
    special: tuple[object, ...] = ()
    not_after: tuple[str, ...] = ()
    nondecreasing: bool = False


@dataclass(frozen=True)
class AuditRoles:
    target: str | None = None
    identifier: str | None = None
    group: str | None = None
    partition: str | None = None
    entity: str | None = None
    observation_time: str | None = None
    key: str | None = None
    slices: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    post_outcome: tuple[str, ...] = ()
    fold: str | None = None
    exposure: str | None = None
    scores: tuple[str, ...] = ()
    event_time: str | None = None
    outcome_end_time: str | None = None
    label_available_time: str | None = None
    partition_cutoff: str | None = None
    window_start: str | None = None
    window_end: str | None = None
    horizon_end: str | None = None
    analysis_as_of: str | None = None
    #: when a feature was known, for all features or by feature
    feature_available_time: str | None = None
    feature_available_times: tuple[tuple[str, str], ...] = ()

    @property
    def times(self) -> tuple[str, ...]:
        named = [getattr(self, r) for pair in CHRONOLOGY for r in pair[:2]] + [self.feature_available_time, *(t for _, t in self.feature_available_times)]
        return tuple(dict.fromkeys(t for t in named if t))


@dataclass(frozen=True)
class AuditConfig:
    high_missing: float = HIGH_MISSING
    near_constant: float = NEAR_CONSTANT
    collinear: float = COLLINEAR
    rules: tuple[ColumnAuditRule, ...] = ()
    max_patterns: int = MAX_PATTERNS
    high_cardinality_count: int = 50
    high_cardinality_rate: float = 0.5
    rare_class_rate: float = RARE_CLASS
    rare_class_count: int = 20
    missing_change: float = 0.1
    missing_relative_change: float = 0.5
    minimum_drift_rows: int = 30
    #: no finding on shifts of the target without one
    target_shift: float | None = None
    target_shift_support: int = 30
    samples: int = 20


def _kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def dataset_profile(df: DataFrame) -> DataFrame:
    """(rows, columns, duplicate_rows)"""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    return rows.crossJoin(duplicate_rows(df)).select("rows", F.lit(len(df.columns)).cast("long").alias("columns"), "duplicate_rows")


def column_profile(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """(column, missing, unique, top, shares, empty and blank strings): one shuffle of value counts for all columns.

    A value travels as its column's number and a hash.  One of 64 bits is one to one on whole numbers, dates
    and times without zone; all else goes by 128 bits of its text, as in ``plans.distinct``.
    """
    kinds = _kinds(df)
    cells = []
    for i, c in enumerate(df.columns):
        x, kind = present(c, kinds[c]), kinds[c]
        exact = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampNTZType))
        v = x if exact else x.cast("string")
        text = F.when(x == "", F.lit(2)).when(F.trim(x) == "", F.lit(3)).otherwise(F.lit(1)) if isinstance(kind, T.StringType) else F.lit(1)
        what = F.when(v.isNull(), F.lit(0)).otherwise(text)  # missing, filled, empty, blank
        cells.append(F.struct(F.lit(i).alias("i"), what.alias("what"), F.xxhash64(v).alias("a"), (F.lit(0).cast("long") if exact else F.xxhash64(F.lit(_SALT), v)).alias("b")))
    counted = df.select(F.inline(F.array(*cells))).groupBy("i", "what", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    there, n = F.col("what") > 0, F.col("n")
    total = lambda w: F.coalesce(F.sum(F.when(w, n)), F.lit(0))
    grouped = counted.groupBy("i").agg(
        F.sum("n").alias("rows"), total(~there).alias("missing"), F.count_if(there).alias("unique"), F.coalesce(F.max(F.when(there, n)), F.lit(0)).alias("top_count"), F.count_if(there & (n == 1)).alias("singletons"),
        total(F.col("what") == 2).alias("empty_strings"), total(F.col("what") == 3).alias("blank_strings"),
    )
    out = grouped.withColumn("column", F.array(*[F.lit(c) for c in df.columns])[F.col("i")])
    filled = F.col("rows") - F.col("missing")
    return out.select(
        "column", "rows", "missing", ratio(F.col("missing"), F.col("rows")).alias("missing_rate"), "unique", "top_count", ratio(F.col("top_count"), filled).alias("top_share"), "singletons", "empty_strings", "blank_strings",
        (filled == 0).alias("all_missing"), (F.col("unique") == 1).alias("constant"), ((F.col("unique") > 1) & (F.col("top_count") >= NEAR_CONSTANT * filled)).alias("near_constant"),
        ((filled >= 20) & (F.col("unique") >= 0.98 * filled)).alias("suspected_identifier"),
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Finite-only moments and quartiles with counts of infinities and a status."""
    kinds = _kinds(df)
    names = list(columns) if columns is not None else [c for c in df.columns if is_numeric(kinds[c])]
    cells = {}
    for c in names:
        x = finite(c, kinds[c])
        odd = lambda v, c=c: F.count_if(F.col(f"`{c}`").cast("double") == float(v))
        cells[c] = {"finite_count": F.count(x), "positive_infinite": odd("inf"), "negative_infinite": odd("-inf"), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}
    middle = quantiles(df, {c: finite(c, kinds[c]) for c in names}).toDF("column", "q25", "median", "q75")
    out = tall(df, cells).join(F.broadcast(middle), "column")  # a row a column
    return out.withColumn("status", F.when(F.col("finite_count") == 0, "unavailable").when(F.col("finite_count") < 2, "undefined").otherwise("available")).drop("position")


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    kinds = _kinds(df)
    names = list(columns) if columns is not None else [c for c in df.columns if is_categorical(kinds[c])]
    counted = frequencies(df, names, None).where("value is not null")
    return counted.groupBy("column").agg(F.count(F.lit(1)).alias("levels"), F.sum("n").alias("non_missing"), F.count_if(F.col("n") == 1).alias("singleton_levels"), F.max("n").alias("top_count")).withColumn("top_share", ratio(F.col("top_count"), F.col("non_missing")))


def unseen_levels(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): levels of ``current`` that ``reference`` does not have."""
    a, b = (frequencies(x, columns, None).where("value is not null").select("column", "value", "n") for x in (reference, current))
    return b.join(a.select("column", "value"), ["column", "value"], "left_anti")


def target_profile(df: DataFrame, target: str) -> DataFrame:
    """(class, count, rate, is_rare): rates among rows with a target."""
    kinds = _kinds(df)
    counted = df.groupBy(present(target, kinds[target]).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
    total = counted.where("class is not null").agg(F.sum("count").alias("total"))
    out = counted.crossJoin(F.broadcast(total))  # one row
    rate = F.when(F.col("class").isNotNull(), ratio(F.col("count"), F.col("total")))
    return out.select("class", "count", rate.alias("rate"), F.coalesce(rate < RARE_CLASS, F.lit(False)).alias("is_rare"))


def slice_profile(df: DataFrame, slices: Sequence[str], target: str, positive: object = 1) -> DataFrame:
    """(slice_role, slice_value, rows, labelled, coverage, event_rate, gap to overall), all roles by grouping sets."""
    y = F.col(f"`{target}`")
    cells = {"rows": F.count(F.lit(1)), "labelled": F.count(y), "events": F.count_if(y == F.lit(positive))}
    wide = scoped(df, list(slices), [[], *[[s] for s in slices]], cells)
    base = wide.where("scope = 'overall'").select(ratio(F.col("events"), F.col("labelled")).alias("base"))
    out = wide.crossJoin(F.broadcast(base))
    value = F.coalesce(*[F.col(f"`{s}`").cast("string") for s in slices])
    rate = ratio(F.col("events"), F.col("labelled"))
    return out.select(F.col("scope").alias("slice_role"), value.alias("slice_value"), "rows", "labelled", ratio(F.col("labelled"), F.col("rows")).alias("coverage"), rate.alias("event_rate"), (rate - F.col("base")).alias("event_rate_gap"))


def missing_patterns(df: DataFrame, columns: Sequence[str] | None = None, max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(pattern, rows, rate): a bit for each column, 1 where it is missing; beyond the most frequent ones one row for the rest."""
    kinds = _kinds(df)
    names = list(columns) if columns is not None else df.columns
    bits = F.concat(*[present(c, kinds[c]).isNull().cast("int").cast("string") for c in names])
    counted = df.groupBy(bits.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))
    top = counted.orderBy(F.desc("rows"), "pattern").limit(max_patterns).select("pattern", F.lit(True).alias("_top"))
    named = counted.join(F.broadcast(top), "pattern", "left").select(F.when(F.col("_top"), F.col("pattern")).otherwise("__OTHER__").alias("pattern"), "rows")
    grouped = named.groupBy("pattern").agg(F.sum("rows").alias("rows"))
    return grouped.crossJoin(F.broadcast(grouped.agg(F.sum("rows").alias("_t")))).select("pattern", "rows", ratio(F.col("rows"), F.col("_t")).alias("rate"))


def missing_counts(df: DataFrame) -> DataFrame:
    kinds = _kinds(df)
    return tall(df, {c: {"rows": F.count(F.lit(1)), "missing": F.count_if(present(c, kinds[c]).isNull())} for c in df.columns}).drop("position")


def missing_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, rates, change, flags): full outer join of both sides' figures, a row a column."""
    a, b = (missing_counts(x).select("column", ratio(F.col("missing"), F.col("rows")).alias(n)) for x, n in ((reference, "reference_rate"), (current, "current_rate")))
    joined = a.join(b, "column", "full_outer")
    change = F.col("current_rate") - F.col("reference_rate")
    return joined.select(
        "column", "reference_rate", "current_rate", F.abs(change).alias("absolute_change"), ratio(change, F.col("reference_rate")).alias("relative_change"),
        F.coalesce((F.col("current_rate") == 1) & (F.col("reference_rate") < 1), F.lit(False)).alias("new_all_missing"), F.coalesce((F.col("reference_rate") == 1) & (F.col("current_rate") < 1), F.lit(False)).alias("recovered"),
    )


def pattern_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """(pattern, reference_rows, current_rows, rate change): full outer join of both sides' patterns."""
    a, b = (missing_patterns(x, columns, max_patterns).select("pattern", F.col("rows").alias(f"{n}_rows"), F.col("rate").alias(f"{n}_rate")) for x, n in ((reference, "reference"), (current, "current")))
    out = a.join(b, "pattern", "full_outer").fillna(0, ["reference_rows", "current_rows", "reference_rate", "current_rate"])
    return out.select("pattern", "reference_rows", "current_rows", (F.col("current_rate") - F.col("reference_rate")).alias("rate_change"))


def logical_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, reference_type, current_type): common columns whose inferred logical type changed."""
    a, b = ({c.name: c.logical_type for c in infer_schema(x).columns} for x in (reference, current))
    rows = [(c, a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return small(current.sparkSession, rows, "column string, reference_type string, current_type string")


def role_findings(df: DataFrame, *, exposure: str | None = None, score: str | None = None, times: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """(column, reason, count): negative exposures, scores outside [0, 1], and columns of the wrong type for their role."""
    kinds = _kinds(df)
    rows = [(c, "datetime_role_mismatch", 0) for c in times if not is_datetime(kinds[c])]
    rows += [(c, "audit_input_dtype_mismatch", 0) for c in numeric if not is_numeric(kinds[c])]
    out = small(df.sparkSession, rows, "column string, reason string, count long")
    cells = {}
    if exposure and is_numeric(kinds[exposure]):
        cells[f"{exposure}\0negative_exposure"] = {"count": F.count_if(present(exposure, kinds[exposure]) < 0)}
    if score and is_numeric(kinds[score]):
        x = present(score, kinds[score])
        cells[f"{score}\0score_out_of_range"] = {"count": F.count_if((x < 0) | (x > 1))}
    if not cells:
        return out
    found = tall(df, cells, "role").where("count > 0")
    return out.unionByName(found.select(F.split("role", "\0")[0].alias("column"), F.split("role", "\0")[1].alias("reason"), "count"))


def schema_drift(reference: DataFrame, current: DataFrame) -> DataFrame:
    """(column, change, reference_type, current_type): added, removed or retyped columns."""
    a, b = ({f.name: f.dataType.simpleString() for f in x.schema.fields} for x in (reference, current))
    rows = []
    for c in sorted(a.keys() | b.keys()):
        if a.get(c) != b.get(c):
            rows.append((c, "current_column_added" if c not in a else "current_column_missing" if c not in b else "dtype_changed", a.get(c), b.get(c)))
    return small(current.sparkSession, rows, "column string, change string, reference_type string, current_type string")


def collinearity(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = COLLINEAR) -> DataFrame:
    kinds = _kinds(df)
    names = (list(columns) if columns is not None else [c for c in df.columns if is_numeric(kinds[c])])[:50]
    pairs = list(combinations(names, 2))
    if not pairs:
        raise ValueError("no columns to aggregate")
    # a row a pair, under one small aggregate: one of all pairs is past what the JVM compiles
    values = df.select(*[finite(n, kinds[n]).alias(f"v{i}") for i, n in enumerate(names)])
    at = {n: F.col(f"v{i}") for i, n in enumerate(names)}
    rows = values.select(F.inline(F.array(*[F.struct(F.lit(i).alias("pair"), at[a].alias("x"), at[b].alias("y")) for i, (a, b) in enumerate(pairs)])))
    x, y = F.col("x"), F.col("y")
    found = rows.where(x.isNotNull() & y.isNotNull()).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("correlation"))
    out = found.where((F.col("n") >= PAIR_ROWS) & (F.abs("correlation") >= threshold))
    left, right = (F.array(*[F.lit(p[side]) for p in pairs])[F.col("pair")] for side in (0, 1))
    return out.select(left.alias("left"), right.alias("right"), "n", "correlation")


def rule_violations(df: DataFrame, rules: Sequence[ColumnAuditRule], order_by: str | None = None, group: str | None = None) -> DataFrame:
    """(column, reason, count, denominator, rate): all rules in one aggregate; missing values and special values pass.

    ``nondecreasing`` compares with the row before in ``order_by``, within ``group`` when there is one.
    """
    kinds = _kinds(df)
    rows, cells = df, {}
    for i, r in enumerate(rules):
        x = present(r.column, kinds[r.column])
        usable = x.isNotNull() if not r.special else x.isNotNull() & ~x.isin(list(r.special))
        if r.minimum is not None or r.maximum is not None:
            bad = F.lit(False)
            if r.minimum is not None:
                bad = bad | ((x < r.minimum) if r.minimum_inclusive else (x <= r.minimum))
            if r.maximum is not None:
                bad = bad | ((x > r.maximum) if r.maximum_inclusive else (x >= r.maximum))
            cells[f"{r.column}\0range_violation"] = (usable, bad)
        if r.allowed:
            cells[f"{r.column}\0allowed_value_violation"] = (usable, ~x.isin(list(r.allowed)))
        for other in r.not_after:
            cells[f"{r.column}\0cross_column_order_violation"] = (usable & F.col(f"`{other}`").isNotNull(), x > F.col(f"`{other}`"))
        if r.nondecreasing:
            if order_by is None or group is None:
                raise ValueError("nondecreasing needs order_by and group: an order over all rows would be one task")
            rows = rows.withColumn(f"_before{i}", F.lag(x).over(Window.partitionBy(group).orderBy(order_by)))
            cells[f"{r.column}\0monotonic_time_violation"] = (usable & F.col(f"_before{i}").isNotNull(), x < F.col(f"_before{i}"))
    flat = tall(rows, {k: {"count": F.count_if(u & b), "denominator": F.count_if(u)} for k, (u, b) in cells.items()}, "rule")
    return flat.select(F.split("rule", "\0")[0].alias("column"), F.split("rule", "\0")[1].alias("reason"), "count", "denominator", ratio(F.col("count"), F.col("denominator")).alias("rate"))


def leakage(df: DataFrame, target: str, features: Sequence[str], post_outcome: Sequence[str] = ()) -> DataFrame:
    """(column, reason, value, support): copies and deterministic proxies of the target."""
    kinds = _kinds(df)
    y = present(target, kinds[target])
    declared = [(c, "target_in_features", 1.0, 0) for c in features if c == target] + [(c, "post_outcome_feature", 1.0, 0) for c in features if c in post_outcome]
    names = [c for c in features if c != target]
    cells = {}
    for c in names:
        if is_numeric(kinds[c]) == is_numeric(kinds[target]):
            x = present(c, kinds[c])
            both = x.isNotNull() & y.isNotNull()
            cells[c] = {"same": F.count_if(both & (x == y)), "support": F.count_if(both)}
    spark = df.sparkSession
    out = small(spark, declared, "column string, reason string, value double, support long")
    if cells:
        rate = ratio(F.col("same"), F.col("support"))
        copies = tall(df, cells).where((F.col("support") >= COPY_ROWS) & ((rate == 1) | ((rate >= NEAR_COPY) & (F.col("support") >= PAIR_ROWS))))
        out = out.unionByName(copies.select("column", F.when(rate == 1, "exact_target_copy").otherwise("near_target_copy").alias("reason"), rate.alias("value"), "support"))
    levels = [c for c in names if is_categorical(kinds[c])]
    if levels:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), present(c, kinds[c]).cast("string").alias("value")) for c in levels])
        exploded = df.select(y.cast("string").alias("y"), F.explode(pairs).alias("p")).select("y", "p.*").where("y is not null and value is not null")
        by = exploded.groupBy("column", "value").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.count(F.lit(1)).alias("n"))
        whole = by.groupBy("column").agg(F.every((F.col("a") == F.col("b")) & (F.col("n") >= 2)).alias("fixed"), F.sum("n").alias("support"), F.min("a").alias("a"), F.max("b").alias("b"))
        out = out.unionByName(whole.where("fixed and a <> b").select("column", F.lit("deterministic_categorical_proxy").alias("reason"), F.lit(1.0).alias("value"), "support"))
    return out


def partition_overlap(df: DataFrame, identifier: str, partition: str) -> DataFrame:
    """(identifiers, overlapping, rows): identifiers that occur in more than one partition."""
    by = df.where(F.col(identifier).isNotNull() & F.col(partition).isNotNull()).groupBy(identifier).agg(F.min(partition).alias("a"), F.max(partition).alias("b"), F.count(F.lit(1)).alias("n"))
    cross = F.col("a") != F.col("b")
    return by.agg(F.count(F.lit(1)).alias("identifiers"), F.count_if(cross).alias("overlapping"), F.coalesce(F.sum(F.when(cross, F.col("n"))), F.lit(0)).alias("rows"))


def payload_overlap(df: DataFrame, partition: str, columns: Sequence[str]) -> DataFrame:
    """(groups, rows): equal rows of ``columns`` in more than one partition."""
    by = df.groupBy(*columns).agg(F.min(partition).alias("_a"), F.max(partition).alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b")
    return by.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"))


def chronology(roles: AuditRoles) -> dict[str, tuple[str | None, Column, Column, bool]]:
    """By name (reason, and feature where it is about one): the feature, the two times, and whether they may be equal."""
    col = lambda n: F.col(f"`{n}`")
    out: dict[str, tuple[str | None, Column, Column, bool]] = {}
    known = dict(roles.feature_available_times)
    for feature in roles.features:
        available = roles.feature_available_time or known.get(feature)
        if available and roles.observation_time:
            out[f"feature_after_observation\0{feature}"] = (feature, col(available), col(roles.observation_time), True)
        if available and roles.partition_cutoff:
            out[f"feature_after_cutoff\0{feature}"] = (feature, col(available), col(roles.partition_cutoff), False)
    for left, right, equal, reason in CHRONOLOGY:
        a, b = getattr(roles, left), getattr(roles, right)
        if a and b:
            out[reason] = (None, col(a), col(b), equal)
    return out


def point_in_time(df: DataFrame, relations: Mapping[str, tuple]) -> DataFrame:
    """(reason, count, denominator, rate, unverified): ``relations`` are those of ``chronology``, or pairs of times of
    which the first must not be after the second.  Rows without one of the times are not verified."""
    cells = {}
    for name, relation in relations.items():
        a, b, equal = (*relation, True) if len(relation) == 2 else relation[1:]
        both = a.isNotNull() & b.isNotNull()
        cells[name] = {"count": F.count_if(both & ((a > b) if equal else (a >= b))), "denominator": F.count_if(both), "unverified": F.count_if(~both)}
    return tall(df, cells, "reason").select("reason", "count", "denominator", ratio(F.col("count"), F.col("denominator")).alias("rate"), "unverified")


def unverified_features(roles: AuditRoles) -> list[str]:
    """Features of which nobody said when they were known, where times are declared at all."""
    if not roles.times:
        return []
    known = dict(roles.feature_available_times)
    return [f for f in roles.features if not (roles.feature_available_time or known.get(f)) or not roles.observation_time]


def duplicate_entity_time(df: DataFrame, entity: str, time: str) -> DataFrame:
    by = df.where(F.col(entity).isNotNull() & F.col(time).isNotNull()).groupBy(entity, time).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return by.agg(F.count(F.lit(1)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def time_order(df: DataFrame, entity: str, time: str, key: str) -> DataFrame:
    """(rows, violations): rows whose time is before that of the entity's row before it in ``key`` order."""
    before = F.lag(time).over(Window.partitionBy(entity).orderBy(key))
    return df.select((F.col(time) < before).alias("bad")).agg(F.count(F.lit(1)).alias("rows"), F.count_if("bad").alias("violations"))


@dataclass(frozen=True)
class Finding:
    """``samples``: the first keys, in order, of the rows that it is about, where single rows are to blame."""

    reason: str
    severity: str
    column: str | None
    count: int | None
    value: float | None
    threshold: float | None = None
    denominator: int | None = None
    samples: tuple = ()
    detail_table: str = ""
    finding_key: str = field(default="")


@dataclass(frozen=True)
class DataAudit:
    config_fingerprint: str
    dataset: DataFrame
    columns: DataFrame
    numeric: DataFrame | None
    categorical: DataFrame | None
    target: DataFrame | None
    slices: DataFrame | None
    patterns: DataFrame
    rules: DataFrame | None
    drift: DataFrame | None
    schema_drift: DataFrame | None
    pattern_drift: DataFrame | None
    collinear: DataFrame | None
    point_in_time: DataFrame | None
    roles: DataFrame
    findings: tuple[Finding, ...]
    #: (detail_table, reason, column) by finding key: where its evidence is
    links: dict[str, tuple[str, str, str | None]]

    def findings_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f.finding_key, f.reason, f.severity, f.column, f.count, f.denominator, f.value, f.threshold, [str(x) for x in f.samples], f.detail_table) for f in self.findings]
        return small(spark, rows, "finding_key string, reason string, severity string, column string, count long, denominator long, value double, threshold double, samples array<string>, detail_table string")


def _families(value: object) -> object:
    """Values of rules by type, so that a fingerprint gives none away; names and thresholds stay."""
    if isinstance(value, dict):
        return {k: [type(x).__name__ for x in v] if k in ("allowed", "special") else _families(v) for k, v in value.items()}
    return [_families(x) for x in value] if isinstance(value, (list, tuple)) else value


def fingerprint(*configs: object) -> str:
    return hashlib.sha256(json.dumps([_families(asdict(c)) for c in configs], sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class _Findings:
    def __init__(self, df: DataFrame, roles: AuditRoles, config: AuditConfig):
        self.df, self.roles, self.config = df, roles, config
        self.rows: list[Finding] = []

    def add(self, reason: str, table: str, column: str | None = None, *, count: int | None = None, value: float | None = None, threshold: float | None = None, denominator: int | None = None, rows: Column | None = None) -> None:
        samples: tuple = ()
        if rows is not None and self.roles.key:  # a bounded top-k by key
            samples = tuple(r[0] for r in self.df.where(rows).select(F.col(f"`{self.roles.key}`")).orderBy(self.roles.key).limit(self.config.samples).collect())
        body = json.dumps([table, reason, column, count, denominator, str(samples[0]) if samples else None], sort_keys=True, separators=(",", ":"))
        self.rows.append(Finding(reason, severity(reason), column, count, value, threshold, denominator, samples, table, hashlib.sha256(body.encode()).hexdigest()))

    def columns(self, table: DataFrame) -> None:
        c = self.config
        for r in table.orderBy("column").collect():  # a row a column
            name, x = r["column"], F.col(f"`{r['column']}`")
            filled = r["rows"] - r["missing"]
            if r["all_missing"]:
                self.add("all_missing_column", "columns", name, count=r["missing"], value=1.0, denominator=r["rows"])
            elif r["missing_rate"] is not None and r["missing_rate"] >= c.high_missing:
                self.add("high_missing_column", "columns", name, count=r["missing"], value=r["missing_rate"], threshold=c.high_missing, denominator=r["rows"], rows=x.isNull())
            if r["constant"]:
                self.add("constant_column", "columns", name, count=r["top_count"], value=1.0, denominator=filled)
            elif r["near_constant"]:
                self.add("near_constant_column", "columns", name, count=r["top_count"], value=r["top_share"], threshold=c.near_constant, denominator=filled)
            if r["blank_strings"]:
                self.add("whitespace_only", "columns", name, count=r["blank_strings"], denominator=filled, rows=(x != "") & (F.trim(x) == ""))
            if r["suspected_identifier"]:
                self.add("suspected_identifier", "columns", name, count=r["unique"], denominator=filled)
            elif r["unique"] > c.high_cardinality_count and r["unique"] > c.high_cardinality_rate * filled:
                self.add("high_cardinality_column", "columns", name, count=r["unique"], threshold=c.high_cardinality_rate, denominator=filled)

    def target(self, table: DataFrame) -> None:
        c, name = self.config, self.roles.target
        rows = table.collect()  # a row a class
        held = [r for r in rows if r["class"] is not None]
        missing, total = sum(r["count"] for r in rows if r["class"] is None), sum(r["count"] for r in rows)
        if missing:
            self.add("target_missing", "target", name, count=missing, denominator=total, rows=F.col(f"`{name}`").isNull())
        if len(held) == 1:
            self.add("target_constant", "target", name, count=held[0]["count"], denominator=total - missing)
        elif len(held) > 2:
            self.add("target_non_binary", "target", name, count=len(held))
        for r in sorted(held, key=lambda r: r["class"]):
            if len(held) > 1 and (r["rate"] < c.rare_class_rate or r["count"] < c.rare_class_count):
                self.add("rare_target_class", "target", name, count=r["count"], value=r["rate"], threshold=c.rare_class_rate, denominator=total - missing)

    def slices(self, table: DataFrame) -> None:
        c = self.config
        if c.target_shift is None:
            return
        rows = table.orderBy("slice_role", "slice_value").collect()  # a row a slice
        base = next((r for r in rows if r["slice_role"] == "overall"), None)
        for r in rows:
            if r["slice_role"] == "overall" or r["labelled"] < c.target_shift_support:
                continue
            if r["event_rate_gap"] is not None and abs(r["event_rate_gap"]) >= c.target_shift:
                self.add("target_distribution_shift", "slices", r["slice_role"], count=r["rows"], value=r["event_rate_gap"], threshold=c.target_shift, denominator=r["labelled"])
            if base is not None and abs(r["coverage"] - base["coverage"]) >= c.target_shift:
                self.add("selection_outcome_support_gap", "slices", r["slice_role"], count=r["labelled"], value=r["coverage"] - base["coverage"], threshold=c.target_shift, denominator=r["rows"])

    def drift(self, missing: DataFrame, schema: DataFrame, sizes: tuple[int, int]) -> None:
        c = self.config
        for r in schema.orderBy("column").collect():  # a row a changed column
            self.add(r["change"], "schema_drift", r["column"])
        if min(sizes) < c.minimum_drift_rows:
            return
        for r in missing.orderBy("column").collect():  # a row a column
            change = r["absolute_change"]
            if change is not None and change >= c.missing_change and (r["relative_change"] is None or abs(r["relative_change"]) >= c.missing_relative_change):
                self.add("missingness_rate_changed", "drift", r["column"], value=r["current_rate"] - r["reference_rate"], threshold=c.missing_change)

    def leaks(self) -> None:
        r, df = self.roles, self.df
        if r.target and r.features:
            for row in leakage(df, r.target, r.features, r.post_outcome).orderBy("column", "reason").collect():
                self.add(row["reason"], "leakage", row["column"], count=row["support"], value=row["value"])
        for c in r.features:
            if c in (r.identifier, r.group, r.partition, r.entity, r.fold, r.key) + r.times:
                self.add("role_column_in_features", "roles", c)
        split = r.partition or r.fold
        for column, reason in ((r.identifier, "identifier_partition_overlap"), (r.group, "group_partition_overlap"), (r.entity if r.entity not in (r.identifier, r.group) else None, "entity_partition_overlap")):
            if column and split:
                one = partition_overlap(df, column, split).first()
                if one["overlapping"]:
                    self.add(reason, "overlap", column, count=one["overlapping"], denominator=one["identifiers"])
        if split:
            payload = [c for c in df.columns if c not in (split, r.key, r.partition, r.fold)]
            one = payload_overlap(df, split, payload).first()
            if one["groups"]:
                self.add("duplicate_row_partition_overlap", "overlap", split, count=one["rows"])
        if r.partition and r.fold:
            crossed = df.where(F.col(f"`{r.fold}`").isNotNull()).groupBy(F.col(f"`{r.fold}`")).agg(F.count_distinct(F.col(f"`{r.partition}`")).alias("n")).where("n > 1").count()
            if crossed:
                self.add("fold_partition_inconsistent", "overlap", r.fold, count=crossed)
        if r.group:
            one = df.where(F.col(f"`{r.group}`").isNotNull()).groupBy(F.col(f"`{r.group}`")).count().agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("count") == 1).alias("single")).first()
            if one["single"]:
                self.add("singleton_group", "overlap", r.group, count=one["single"], denominator=one["n"])

    def times(self, table: DataFrame | None, relations: Mapping[str, tuple]) -> None:
        r, df = self.roles, self.df
        if table is not None:
            for row in table.orderBy("reason").collect():  # a row a relation
                feature, a, b, equal = relations[row["reason"]]
                reason = row["reason"].split("\0")[0]
                if row["count"]:
                    self.add(reason, "point_in_time", feature, count=row["count"], value=row["rate"], denominator=row["denominator"], rows=(a > b) if equal else (a >= b))
                if row["unverified"]:
                    self.add("missing_availability_metadata", "point_in_time", feature or reason, count=row["unverified"], denominator=row["unverified"] + row["denominator"])
        for feature in unverified_features(r):
            self.add("partial_feature_availability_mapping", "point_in_time", feature)
        if r.entity and r.observation_time:
            one = duplicate_entity_time(df, r.entity, r.observation_time).first()
            if one["pairs"]:
                self.add("duplicate_entity_time", "point_in_time", r.entity, count=one["rows"])
            if r.key:
                one = time_order(df, r.entity, r.observation_time, r.key).first()
                if one["violations"]:
                    self.add("time_order_violation", "point_in_time", r.observation_time, count=one["violations"], denominator=one["rows"])


def audit_data_quality(df: DataFrame, *, roles: AuditRoles | None = None, config: AuditConfig | None = None, reference: DataFrame | None = None) -> DataAudit:
    """All tables lazily, and the findings of the small ones."""
    roles, config = roles or AuditRoles(), config or AuditConfig()
    check_columns(df)
    kinds = _kinds(df)
    found = _Findings(df, roles, config)
    columns, dataset = column_profile(df, roles.key), dataset_profile(df)
    one = dataset.first()
    if not one["rows"]:
        found.add("empty_dataset", "dataset", count=0)
    if one["duplicate_rows"]:
        found.add("duplicate_rows", "dataset", count=one["duplicate_rows"], denominator=one["rows"])
    if one["rows"]:
        found.columns(columns)
    floats = [c for c in df.columns if is_floating(kinds[c])]
    if floats:
        odd = df.agg(*[F.count_if(infinite(F.col(f"`{c}`"))).alias(c) for c in floats]).first()
        for c in floats:
            if odd[c]:
                found.add("nonfinite_values", "numeric", c, count=odd[c], denominator=one["rows"], rows=infinite(F.col(f"`{c}`")))
    rules = rule_violations(df, config.rules, roles.key, roles.group or roles.entity) if config.rules else None
    if rules is not None:
        for r in rules.orderBy("column", "reason").collect():  # a row a rule
            if r["count"]:
                found.add(r["reason"], "rules", r["column"], count=r["count"], value=r["rate"], denominator=r["denominator"])
    target = target_profile(df, roles.target) if roles.target else None
    if target is not None:
        found.target(target)
    slices = slice_profile(df, roles.slices, roles.target) if roles.target and roles.slices else None
    if slices is not None:
        found.slices(slices)
    found.leaks()
    relations = chronology(roles)
    usable = {n: x for n, x in relations.items() if all(is_datetime(kinds[t]) for t in roles.times)}
    timed = point_in_time(df, usable) if usable else None
    found.times(timed, usable)
    typed = None
    for score in roles.scores or (None,):
        part = role_findings(df, exposure=roles.exposure if typed is None else None, score=score, times=roles.times if typed is None else (), numeric=[c for c in (roles.exposure, *roles.scores) if c] if typed is None else ())
        typed = part if typed is None else typed.unionByName(part)
    for r in typed.orderBy("column", "reason").collect():  # a row a role
        found.add(r["reason"], "roles", r["column"], count=r["count"])
    numeric = [c for c in df.columns if is_numeric(kinds[c])]
    levels = [c for c in df.columns if is_categorical(kinds[c])]
    paired = collinearity(df, numeric, config.collinear) if len(numeric) > 1 else None
    if paired is not None:
        for r in paired.orderBy("left", "right").collect():  # of 50 columns at most
            found.add("collinear_columns", "collinear", f"{r['left']}, {r['right']}", count=r["n"], value=r["correlation"], threshold=config.collinear)
    drift = changed = patterned = None
    if reference is not None:
        drift, changed = missing_drift(reference, df), schema_drift(reference, df)
        shared = [c for c in df.columns if c in reference.columns]
        patterned = pattern_drift(reference, df, shared, config.max_patterns) if shared else None
        found.drift(drift, changed, (reference.count(), one["rows"]))
        for r in logical_drift(reference, df).orderBy("column").collect():  # a row a changed column
            found.add("logical_type_changed", "schema_drift", r["column"])
    order = {"error": 0, "warning": 1, "info": 2}
    found.rows.sort(key=lambda f: (order[f.severity], f.reason, f.column or ""))
    return DataAudit(
        fingerprint(roles, config), dataset, columns, numeric_profile(df, numeric) if numeric else None, categorical_profile(df, levels) if levels else None, target, slices, missing_patterns(df, None, config.max_patterns), rules, drift, changed, patterned, paired, timed, typed,
        tuple(found.rows), {f.finding_key: (f.detail_table, f.reason, f.column) for f in found.rows},
    )


__all__ = ["AuditConfig", "AuditRoles", "ColumnAuditRule", "DataAudit", "Finding", "audit_data_quality"]
