"""Global order without a global task: running sums and average ranks over bucketed windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column, splits: list[float]) -> Column:
    """How many of the sorted ``splits`` are at most ``value``; a balanced tree of comparisons."""

    def node(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value >= F.lit(splits[mid]), node(mid + 1, high)).otherwise(node(low, mid))

    return node(0, len(splits))


def splits_of(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of ``key``: at most as many as there are shuffle partitions."""
    n = buckets or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    n = min(n, 512)
    if n == 1:
        return []
    found = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / n) for i in range(1, n)]), 20 * n)).first()[0]
    return sorted(set(found or []))


def running_sums(df: DataFrame, key: str, sums: list[str], descending: bool = False, buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``df``, one row a (by, key), with ``<name>_upto``: the sum of name up to and with the row.

    Rows are dealt into ranges of ``key``; sums within a range are windows over one partition,
    and the totals of the ranges before it (a few rows) are joined.
    """
    by = by or []
    splits = splits_of(df, key, buckets)
    dealt = df.withColumn("_range", bucket(F.col(key), splits))
    order = [F.desc("_range")] if descending else [F.asc("_range")]
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_{s}_before") for s in sums])
    within = Window.partitionBy(*by, "_range").orderBy(F.desc(key) if descending else F.asc(key)).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(offsets, [*by, "_range"])
    for s in sums:
        joined = joined.withColumn(f"{s}_upto", F.sum(s).over(within) + F.col(f"_{s}_before"))
    return joined.drop("_range", *[f"_{s}_before" for s in sums])


def average_ranks(df: DataFrame, key: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, key, n, rank): tie-averaged ranks of the distinct values of ``key`` among all rows."""
    by = by or []
    counted = df.groupBy(*by, key).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    summed = running_sums(counted, key, ["n"], by=by)
    return summed.withColumn("rank", F.col("n_upto") - (F.col("n") - 1) / 2.0).drop("n_upto")
