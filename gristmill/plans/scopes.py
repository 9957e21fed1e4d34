"""Grouping sets: every summary scope of a table from one expansion and one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scoped(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], aggregates: Mapping[str, Column]) -> DataFrame:
    """(scope, *keys, *aggregates): ``sets`` are lists of keys; a key outside its set is null there.

    scope names the set: its keys joined by ``*``, or overall.
    """
    columns = [F.col(f"`{k}`") for k in keys]
    grouped = df.groupingSets([[F.col(f"`{k}`") for k in s] for s in sets], *columns)
    marker = F.grouping_id(*columns) if keys else F.lit(0)
    out = grouped.agg(*[c.alias(n) for n, c in aggregates.items()], marker.alias("_set"))
    name = F.lit(None).cast("string")
    for s in sets:
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        name = F.when(F.col("_set") == number, F.lit("*".join(s) or "overall")).otherwise(name)
    return out.select(name.alias("scope"), *columns, *[F.col(n) for n in aggregates])
