"""Expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_datetime(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_categorical(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BooleanType))


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def present(name: str, kind: T.DataType) -> Column:
    """The column with NaN as null: a NaN is missing, an infinity is not."""
    column = F.col(f"`{name}`")
    return F.when(F.isnan(column), F.lit(None)).otherwise(column) if is_floating(kind) else column


def finite(name: str, kind: T.DataType) -> Column:
    """The column as double, null where it is missing or infinite."""
    column = present(name, kind).cast("double")
    return F.when(F.abs(column) == float("inf"), F.lit(None)).otherwise(column)


def infinite(column: Column) -> Column:
    return F.abs(column) == float("inf")


def sample_skewness(column: Column) -> Column:
    """Bias-adjusted skewness G1; null below three values or without spread."""
    n = F.count(column).cast("double")
    return F.when((F.count(column) >= 3) & (F.stddev_pop(column) > 0), F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null over zero."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null where one of them does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
