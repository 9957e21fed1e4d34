"""Exact quantiles at any size.

Few distinct values: one aggregate, whose buffer holds them.  Many: value counts are cumulated over
bucketed ranges and the two order statistics around each position are picked, so no task ever holds
a column.  Both interpolate linearly and give the same numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums
from .shapes import tall

#: Distinct values (estimated), of all columns together, that the buffers of one aggregate may hold.
BUFFERED = 1_500_000


def buffered(df: DataFrame, columns: Mapping[str, Column], limit: int = BUFFERED) -> bool:
    """Whether the columns' distinct values fit the buffers of one aggregate, by sketches."""
    row = df.agg(*[F.approx_count_distinct(c, 0.05) for c in columns.values()]).first()
    return sum(row) <= limit


def quantiles(df: DataFrame, columns: Mapping[str, Column], probabilities: Sequence[float] = (0.25, 0.5, 0.75), *, distributed: bool | None = None, distinct: int | None = None) -> DataFrame:
    """(column, q0, q1, ...): a row a column; null for a column without values.

    ``distinct``: the columns' distinct values together, where they are known already.
    """
    names = [f"q{i}" for i in range(len(probabilities))]
    if distributed is None:
        distributed = distinct > BUFFERED if distinct is not None else not buffered(df, columns)
    if not distributed:
        cells = {}
        for name, c in columns.items():
            q = F.percentile(c.cast("double"), F.array(*[F.lit(float(p)) for p in probabilities]))
            cells[name] = {n: q[i] for i, n in enumerate(names)}
        return tall(df, cells).drop("position")
    cells = F.array(*[F.struct(F.lit(n).alias("column"), c.cast("double").alias("v")) for n, c in columns.items()])
    counted = df.select(F.inline(cells)).where("v is not null").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    summed = running_sums(counted, "v", ["n"], by=["column"])
    totals = counted.groupBy(F.col("column").alias("_column")).agg(F.sum("n").alias("total"))
    ranked = summed.join(F.broadcast(totals), F.col("column") == F.col("_column"))  # a row a column
    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for name, rank in ((f"a{i}", F.floor(at)), (f"b{i}", F.ceil(at))):
            picks.append(F.min(F.when(F.col("n_upto") > rank, F.col("v"))).alias(name))
    found = ranked.groupBy("column", "total").agg(*picks)
    out = [F.col("column")]
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("total") - 1)
        out.append((F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (at - F.floor(at))).alias(names[i]))
    every = df.sparkSession.createDataFrame([(n,) for n in columns], "column string")
    return every.join(found.select(*out), "column", "left")
