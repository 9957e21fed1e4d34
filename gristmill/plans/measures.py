"""Measures: values that say what they rest on, and why there is none when there is none."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _measure(value: Column, top: Column, bottom: Column, support: Column, status: Column, reason: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.struct(d(value).alias("value"), d(top).alias("numerator"), d(bottom).alias("denominator"), support.cast("long").alias("support"), status.alias("status"), reason.alias("reason"))


def amount(value: Column, support: Column) -> Column:
    return _measure(value, F.lit(None), F.lit(None), support, F.lit("available"), F.lit("computed"))


def rate(top: Column, bottom: Column, support: Column) -> Column:
    """A zero denominator is undefined."""
    zero = bottom == 0
    return _measure(F.when(~zero, top.cast("double") / bottom), top, bottom, support, F.when(zero, "undefined").otherwise("available"), F.when(zero, "zero_denominator").otherwise("computed"))


def absent(status: str, reason: str) -> Column:
    return _measure(F.lit(None), F.lit(None), F.lit(None), F.lit(0), F.lit(status), F.lit(reason))


def first_of(cases: Sequence[tuple[Column, Column]], otherwise: Column) -> Column:
    """The measure of the first condition that holds."""
    out = otherwise
    for condition, measure in reversed(list(cases)):
        out = F.when(condition, measure).otherwise(out)
    return out


def measured(wide: DataFrame, labels: Sequence[str], metrics: Mapping[str, Column]) -> DataFrame:
    """Tall rows (labels, metric, value, numerator, denominator, support, status, reason)."""
    names = ("value", "numerator", "denominator", "support", "status", "reason")
    cells = wide.select(*labels, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), m.alias("m")) for n, m in metrics.items()])))
    return cells.select(*labels, "metric", *[F.col(f"m.{n}").alias(n) for n in names])
