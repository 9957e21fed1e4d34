"""Univariate and bivariate analysis: profiles, correlations, outliers, groups, target relationships."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, infinite, is_categorical, is_floating, is_numeric, present, ratio, sample_skewness
from ..functions.special import chi2_sf, pearson_p
from ..plans.ordered import average_ranks, running_sums
from ..plans.quantiles import quantiles
from ..plans.shapes import check_columns, small, tall

# Limits of the analyses.
MAX_CORRELATED, MAX_FEATURES, MAX_CATEGORIES, MAX_GROUPS, TOP_N, IQR_FACTOR = 50, 50, 20, 20, 10, 1.5


def _kinds(df: DataFrame) -> dict:
    return {f.name: f.dataType for f in df.schema.fields}


def _counts(df: DataFrame, names: Sequence[str]) -> dict:
    """n, and by column: rows present, and whether it has one value only."""
    kinds = _kinds(df)
    cells = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(names):
        c = present(name, kinds[name])
        cells += [F.count(c).alias(f"p{i}"), (F.min(c) == F.max(c)).alias(f"k{i}")]
        if is_floating(kinds[name]):
            cells.append(F.count_if(infinite(F.col(f"`{name}`"))).alias(f"i{i}"))
    row = df.agg(*cells).first().asDict()
    return {"n": row["n"], "present": {x: row[f"p{i}"] for i, x in enumerate(names)}, "constant": {x: bool(row[f"k{i}"]) for i, x in enumerate(names)}, "infinite": {x: row.get(f"i{i}", 0) for i, x in enumerate(names)}}


@dataclass(frozen=True)
class NumericAnalysis:
    n_rows: int
    requested_columns: tuple[str, ...]
    analyzed_columns: tuple[str, ...]
    skipped_columns: tuple[str, ...]
    skipped_reasons: dict[str, str]
    summary: DataFrame


def _chosen(df: DataFrame, columns: Sequence[str] | None, accept, reason: str) -> tuple[list[str], list[str], dict[str, str]]:
    kinds = _kinds(df)
    names = check_columns(df, columns) if columns is not None else [n for n in check_columns(df) if accept(kinds[n])]
    skipped = {n: reason for n in names if not accept(kinds[n])}
    return names, [n for n in names if n not in skipped], skipped


def numeric_profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    kinds = _kinds(df)
    cells = {}
    for name in names:
        c = present(name, kinds[name]).cast("double")
        zero = F.count_if(c == 0)
        cells[name] = {
            "count": F.count(c), "missing": F.count(F.lit(1)) - F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c),
            "max": F.max(c), "skew": sample_skewness(c), "zero_count": zero, "zero_rate": ratio(zero, F.count(c)),
        }
    middle = quantiles(df, {n: present(n, kinds[n]) for n in names}).toDF("column", "q25", "median", "q75")
    joined = tall(df, cells).join(F.broadcast(middle), "column")  # a row a column
    return joined.select("position", "column", "count", "missing", "mean", "std", "min", "q25", "median", "q75", "max", "skew", "zero_count", "zero_rate")


def analyze_numeric_features(df: DataFrame, *, columns: Sequence[str] | None = None) -> NumericAnalysis:
    """Moments, quartiles, adjusted skewness and zeros of numeric columns in one aggregate; booleans are not numeric."""
    names, kept, skipped = _chosen(df, columns, is_numeric, "not_numeric")
    seen = _counts(df, kept)
    skipped |= {n: "all_missing" for n in kept if not seen["present"][n]}
    kept = [n for n in kept if n not in skipped]
    schema = "position int, column string, count long, missing long, mean double, std double, min double, q25 double, median double, q75 double, max double, skew double, zero_count long, zero_rate double"
    summary = numeric_profile(df, kept) if kept else small(df.sparkSession, [], schema)
    return NumericAnalysis(seen["n"], tuple(names), tuple(kept), tuple(skipped), skipped, summary)


@dataclass(frozen=True)
class CategoricalAnalysis:
    n_rows: int
    requested_columns: tuple[str, ...]
    analyzed_columns: tuple[str, ...]
    skipped_columns: tuple[str, ...]
    skipped_reasons: dict[str, str]
    top_n: int
    summary: DataFrame
    top_categories: DataFrame


def frequencies(df: DataFrame, names: Sequence[str], order_by: str | None) -> DataFrame:
    """(column, value, n, first): value counts of all columns through one shuffle; first is the least ``order_by``."""
    kinds = _kinds(df)
    first = F.col(f"`{order_by}`") if order_by else F.lit(0)
    cells = F.array(*[F.struct(F.lit(n).alias("column"), present(n, kinds[n]).cast("string").alias("value")) for n in names])
    return df.select(first.alias("_first"), F.explode(cells).alias("c")).select("_first", "c.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("_first").alias("first"))


def analyze_categorical_features(df: DataFrame, *, columns: Sequence[str] | None = None, top_n: int = TOP_N, order_by: str | None = None) -> CategoricalAnalysis:
    """Levels, the most frequent value and the top values; equal counts rank by first appearance in ``order_by``."""
    names, kept, skipped = _chosen(df, columns, is_categorical, "not_categorical")
    seen = _counts(df, kept)
    skipped |= {n: "all_missing" for n in kept if not seen["present"][n]}
    kept = [n for n in kept if n not in skipped]
    if not kept:
        empty = small(df.sparkSession, [], "column string, count long, missing long, unique long, top string, top_count long, top_rate double")
        return CategoricalAnalysis(seen["n"], tuple(names), (), tuple(skipped), skipped, top_n, empty, small(df.sparkSession, [], "column string, rank int, value string, count long, rate double"))
    counted = frequencies(df, kept, order_by)
    best = F.min_by(F.struct("value", "n"), F.struct(-F.col("n"), "first", "value"))
    there = counted.where("value is not null")
    totals = counted.groupBy("column").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("count"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique"),
    )
    tops = there.groupBy("column").agg(best.alias("b"))
    summary = totals.join(F.broadcast(tops), "column").select("column", "count", "missing", "unique", F.col("b.value").alias("top"), F.col("b.n").alias("top_count"), ratio(F.col("b.n"), F.col("count")).alias("top_rate"))
    ranked = there.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first", "value"))).where(F.col("rank") <= top_n)
    top = ranked.join(F.broadcast(totals.select("column", "count")), "column").select("column", "rank", "value", F.col("n").alias("count"), ratio(F.col("n"), F.col("count")).alias("rate"))
    return CategoricalAnalysis(seen["n"], tuple(names), tuple(kept), tuple(skipped), skipped, top_n, summary, top)


@dataclass(frozen=True)
class CorrelationAnalysis:
    n_rows: int
    requested_columns: tuple[str, ...]
    analyzed_columns: tuple[str, ...]
    skipped_columns: tuple[str, ...]
    skipped_reasons: dict[str, str]
    method: str
    max_columns: int
    min_periods: int
    truncated: bool
    correlations: DataFrame


def compute_correlations(df: DataFrame, *, columns: Sequence[str] | None = None, method: str = "pearson", max_columns: int = MAX_CORRELATED, min_periods: int = 2) -> CorrelationAnalysis:
    """(left, right, n, correlation) for pairs of numeric columns over the rows where both are present.

    Pearson: all pairs in one aggregate.  Spearman: columns without missing values are ranked once and
    paired in one aggregate; with missing values, ranks are taken anew on each pair's rows.
    """
    if method not in ("pearson", "spearman"):
        raise ValueError("method must be pearson or spearman")
    names, kept, skipped = _chosen(df, columns, is_numeric, "not_numeric")
    seen = _counts(df, kept)
    for n in kept:
        if not seen["present"][n]:
            skipped[n] = "all_missing"
        elif seen["present"][n] < min_periods:
            skipped[n] = "insufficient_non_missing"
        elif seen["constant"][n]:
            skipped[n] = "constant"
    kept = [n for n in kept if n not in skipped]
    skipped |= dict.fromkeys(kept[max_columns:], "exceeds_max_columns")
    truncated, kept = len(kept) > max_columns, kept[:max_columns]
    kinds = _kinds(df)
    pairs = list(combinations(kept, 2))
    if not pairs:
        table = small(df.sparkSession, [], "left string, right string, n long, correlation double")
    elif method == "pearson":
        cells = {}
        for a, b in pairs:
            x, y = present(a, kinds[a]).cast("double"), present(b, kinds[b]).cast("double")
            both = x.isNotNull() & y.isNotNull()
            cells[f"{a}\0{b}"] = {"n": F.count_if(both), "correlation": correlation(x, y)}
        table = tall(df, cells, "pair").select(F.split("pair", "\0")[0].alias("left"), F.split("pair", "\0")[1].alias("right"), "n", "correlation")
    else:
        full = [n for n in kept if seen["present"][n] == seen["n"]]
        table = _spearman_full(df, full, kinds) if len(full) > 1 else None
        for a, b in pairs:
            if a in full and b in full:
                continue
            part = _spearman(df, a, b, kinds)
            table = part if table is None else table.unionByName(part)
    table = table.where((F.col("n") >= min_periods) & F.col("correlation").isNotNull())
    return CorrelationAnalysis(seen["n"], tuple(names), tuple(kept), tuple(skipped), skipped, method, max_columns, min_periods, truncated, table)


def _spearman_full(df: DataFrame, names: Sequence[str], kinds: dict) -> DataFrame:
    """All pairs of columns without missing values: each is ranked once, then one aggregate has all pairs."""
    rows = df.select(*[present(n, kinds[n]).cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    for i in range(len(names)):
        ranks = average_ranks(rows.select(f"v{i}"), f"v{i}").select(f"v{i}", F.col("rank").alias(f"r{i}"))
        rows = rows.join(ranks, f"v{i}").drop(f"v{i}")
    cells = {}
    for i, j in combinations(range(len(names)), 2):
        cells[f"{names[i]}\0{names[j]}"] = {"n": F.count(F.lit(1)), "correlation": correlation(F.col(f"r{i}"), F.col(f"r{j}"))}
    pair = F.split("pair", "\0")
    return tall(rows, cells, "pair").select(pair[0].alias("left"), pair[1].alias("right"), "n", "correlation")


def _spearman(df: DataFrame, a: str, b: str, kinds: dict) -> DataFrame:
    both = df.select(present(a, kinds[a]).cast("double").alias("x"), present(b, kinds[b]).cast("double").alias("y")).where("x is not null and y is not null")
    counted = both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))  # equal pairs once
    x = average_ranks(counted, "x", weight="k").select("x", F.col("rank").alias("rx"))
    y = average_ranks(counted, "y", weight="k").select("y", F.col("rank").alias("ry"))
    ranked = counted.join(x, "x").join(y, "y")
    k = F.col("k")
    n, sx, sy = F.sum(k), F.sum(k * F.col("rx")), F.sum(k * F.col("ry"))
    sxx, syy, sxy = (F.sum(k * u * v) for u, v in ((F.col("rx"), F.col("rx")), (F.col("ry"), F.col("ry")), (F.col("rx"), F.col("ry"))))
    spread = F.sqrt((n * sxx - sx * sx) * (n * syy - sy * sy))
    return ranked.agg(n.alias("n"), F.when(spread > 0, (n * sxy - sx * sy) / spread).alias("correlation")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "n", "correlation")


@dataclass(frozen=True)
class OutlierAnalysis:
    n_rows: int
    requested_columns: tuple[str, ...]
    analyzed_columns: tuple[str, ...]
    skipped_columns: tuple[str, ...]
    skipped_reasons: dict[str, str]
    method: str
    threshold: float
    summary: DataFrame
    outliers: DataFrame


def detect_outliers(df: DataFrame, *, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = IQR_FACTOR, key: Sequence[str] = ()) -> OutlierAnalysis:
    """Values strictly outside [Q1 - k IQR, Q3 + k IQR]; ``key`` columns identify rows in the detail table.

    Bounds are one aggregate, joined as one row; columns with infinities are skipped.
    """
    if method != "iqr":
        raise ValueError("method must be iqr")
    names, kept, skipped = _chosen(df, columns, is_numeric, "not_numeric")
    seen = _counts(df, kept)
    for n in kept:
        if not seen["present"][n]:
            skipped[n] = "all_missing"
        elif seen["infinite"][n]:
            skipped[n] = "non_finite_values"
    kept = [n for n in kept if n not in skipped]
    kinds = _kinds(df)
    if not kept:
        empty = df.limit(0).select(*key, F.lit("").alias("column"), F.lit(0.0).alias("value"), F.lit("").alias("side"))
        none = small(df.sparkSession, [], "column string, q25 double, q75 double, iqr double, lower double, upper double, outlier_count long, outlier_rate double")
        return OutlierAnalysis(seen["n"], tuple(names), (), tuple(skipped), skipped, method, threshold, none, empty)
    bounds = quantiles(df, {n: present(n, kinds[n]) for n in kept}, (0.25, 0.75)).toDF("column", "q25", "q75")
    bounds = bounds.withColumn("iqr", F.col("q75") - F.col("q25")).withColumn("lower", F.col("q25") - threshold * F.col("iqr")).withColumn("upper", F.col("q75") + threshold * F.col("iqr"))
    values = df.select(*key, F.explode(F.array(*[F.struct(F.lit(n).alias("column"), present(n, kinds[n]).cast("double").alias("value")) for n in kept])).alias("c")).select(*key, "c.*")
    joined = values.where("value is not null").join(F.broadcast(bounds), "column")  # a row a column
    out = joined.where("value < lower or value > upper").select(*key, "column", "value", F.when(F.col("value") < F.col("lower"), "low").otherwise("high").alias("side"))
    counted = joined.groupBy("column", "q25", "q75", "iqr", "lower", "upper").agg(F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("outlier_count"), F.count(F.lit(1)).alias("n"))
    summary = counted.select("column", "q25", "q75", "iqr", "lower", "upper", "outlier_count", ratio(F.col("outlier_count"), F.col("n")).alias("outlier_rate"))
    return OutlierAnalysis(seen["n"], tuple(names), tuple(kept), tuple(skipped), skipped, method, threshold, summary, out)


@dataclass(frozen=True)
class GroupComparison:
    n_rows: int
    group_by: str
    requested_values: tuple[str, ...]
    analyzed_values: tuple[str, ...]
    skipped_values: tuple[str, ...]
    skipped_reasons: dict[str, str]
    max_groups: int
    available_group_count: int
    displayed_group_count: int
    missing_group_count: int
    truncated: bool
    truncation_reason: str | None
    summary: DataFrame


def compare_groups(df: DataFrame, group_by: str, *, values: Sequence[str] | None = None, max_groups: int = MAX_GROUPS, order_by: str | None = None) -> GroupComparison:
    """Count, missing, mean and quartiles of each value column in the most frequent groups."""
    check_columns(df, [group_by])
    kinds = _kinds(df)
    wanted = values if values is not None else [n for n in df.columns if n != group_by and is_numeric(kinds[n])]
    names, kept, skipped = _chosen(df, wanted, is_numeric, "not_numeric")
    counted = frequencies(df, [group_by], order_by)
    there = counted.where("value is not null")
    sizes = counted.agg(F.count("value").alias("groups"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")).first()
    top = there.orderBy(F.desc("n"), "first", "value").limit(max_groups).select(F.col("value").alias("_group"), F.col("n").alias("group_size"))
    shown = df.withColumn("_group", present(group_by, kinds[group_by]).cast("string")).join(F.broadcast(top), "_group")
    whole, seen = _counts(df, kept), _counts(shown, kept)
    for n in kept:
        if not whole["present"][n]:
            skipped[n] = "all_missing"
        elif whole["infinite"][n]:
            skipped[n] = "non_finite_values"
        elif seen["present"][n] < 2:
            skipped[n] = "insufficient_non_missing"
        elif seen["constant"][n]:
            skipped[n] = "constant"
    kept = [n for n in kept if n not in skipped]
    cells = {}
    for n in kept:
        c = present(n, kinds[n]).cast("double")
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        cells[n] = {"count": F.count(c), "missing": F.count(F.lit(1)) - F.count(c), "mean": F.avg(c), "q25": q[0], "median": q[1], "q75": q[2]}
    schema = "_group string, position int, column string, count long, missing long, mean double, q25 double, median double, q75 double"
    table = (tall(shown, cells, by=["_group"]) if kept else small(df.sparkSession, [], schema)).withColumnRenamed("_group", "group")
    truncated = sizes["groups"] > max_groups
    return GroupComparison(whole["n"], group_by, tuple(names), tuple(kept), tuple(skipped), skipped, max_groups, sizes["groups"], min(sizes["groups"], max_groups), sizes["missing"], truncated, "exceeds_max_groups" if truncated else None, table.drop("position"))


@dataclass(frozen=True)
class TargetAnalysis:
    n_rows: int
    target: str
    task: str
    requested_features: tuple[str, ...]
    analyzed_features: tuple[str, ...]
    skipped_features: tuple[str, ...]
    skipped_reasons: dict[str, str]
    statistical_tests: DataFrame
    numeric_details: DataFrame
    category_details: DataFrame
    limitations: tuple[str, ...]


def kruskal(df: DataFrame, group: Column, value: Column) -> DataFrame:
    """(n, groups, statistic, effect): tie-corrected Kruskal-Wallis H and epsilon squared; groups under two rows drop.

    Ranks come from the counts of distinct values, so no row-level global sort is needed.
    """
    rows = df.select(group.cast("string").alias("g"), value.cast("double").alias("v")).where("g is not null and v is not null")
    counted = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("k"))
    large = counted.groupBy("g").agg(F.sum("k").alias("size")).where("size >= 2")
    kept = counted.join(large.select("g"), "g")
    ranks = average_ranks(kept, "v", weight="k")
    by_group = kept.join(ranks.select("v", "rank"), "v").groupBy("g").agg(F.sum("k").cast("double").alias("n"), F.sum(F.col("k") * F.col("rank")).alias("r"))
    one = by_group.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    n = F.col("n").cast("double")
    ties = ranks.agg(F.sum(F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1)).alias("ties"))
    plain = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    both = one.crossJoin(F.broadcast(ties))  # one row and one row
    h = F.when((F.col("groups") >= 2) & (n >= 4) & (F.col("ties") < n * n * n - n), plain / (1 - F.col("ties") / (n * n * n - n)))
    return both.select(F.col("n").cast("long").alias("n"), "groups", h.alias("statistic"), F.when(n > F.col("groups"), F.greatest(F.lit(0.0), (h - F.col("groups") + 1) / (n - F.col("groups")))).alias("effect"))


def chi_square(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """(n, levels_left, levels_right, statistic, effect, degrees, low_expected): contingency test and Cramer's V.

    Two by two tables get Yates' correction.  Only cells that occur are formed: an empty one adds its
    expectation, and expectations sum to n.  Low expectations are counted over sorted marginals.
    """
    cells = df.select(left.cast("string").alias("a"), right.cast("string").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("o"))
    rows, columns = cells.groupBy("a").agg(F.sum("o").alias("ra")), cells.groupBy("b").agg(F.sum("o").alias("cb"))
    margins = lambda t, m, n: t.agg(F.sum(m).alias(f"{n}_n"), F.count(F.lit(1)).alias(n), F.sum(1 / F.col(m)).alias(f"{n}_inverse"))
    one = margins(rows, "ra", "r").crossJoin(margins(columns, "cb", "c")).withColumnRenamed("r_n", "n")  # one row and one row
    n, r, c = F.col("n").cast("double"), F.col("r"), F.col("c")
    held = cells.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(one.select("n")))
    e = F.col("ra").cast("double") * F.col("cb") / n
    off = F.abs(F.col("o") - e)
    sums = held.agg(F.sum(off * off / e).alias("terms"), F.sum(e).alias("expected"), F.max(off).alias("off"))
    # pairs of marginals with ra * cb < 5 n: for each row, the columns below 5 n / ra
    sized = columns.groupBy(F.col("cb").cast("double").alias("key")).agg(F.count(F.lit(1)).alias("columns"), F.lit(0).cast("long").alias("rows"))
    asked = rows.crossJoin(F.broadcast(one.select("n"))).groupBy((5 * n / F.col("ra")).alias("key")).agg(F.lit(0).cast("long").alias("columns"), F.count(F.lit(1)).alias("rows"))
    merged = sized.unionByName(asked).groupBy("key").agg(F.sum("columns").alias("columns"), F.sum("rows").alias("rows"))
    low = running_sums(merged, "key", ["columns"]).agg(F.coalesce(F.sum(F.col("rows") * (F.col("columns_upto") - F.col("columns"))), F.lit(0)).alias("low_expected"))
    kept = F.col("off") - F.least(F.lit(0.5), F.col("off"))
    statistic = F.when((r == 2) & (c == 2), kept * kept * n * F.col("r_inverse") * F.col("c_inverse")).otherwise(F.col("terms") + n - F.col("expected"))
    whole = one.crossJoin(sums).crossJoin(low).withColumn("statistic", F.greatest(F.lit(0.0), statistic))
    return whole.where((r >= 2) & (c >= 2)).select(
        "n", r.alias("levels_left"), c.alias("levels_right"), "statistic", F.sqrt(F.col("statistic") / (n * (F.least(r, c) - 1))).alias("effect"), ((r - 1) * (c - 1)).alias("degrees"), "low_expected"
    )


def analyze_target_relationships(df: DataFrame, target: str, *, task: str, features: Sequence[str] | None = None, max_features: int = MAX_FEATURES, max_categories: int = MAX_CATEGORIES) -> TargetAnalysis:
    """One test a feature: Kruskal-Wallis, chi-square or Pearson, by the types of feature and target."""
    if task not in ("classification", "regression"):
        raise ValueError("task must be classification or regression")
    kinds = _kinds(df)
    names = check_columns(df, features) if features is not None else [n for n in check_columns(df) if n != target]
    check_columns(df, [target])
    skipped: dict[str, str] = {}
    usable = []
    for n in names:
        if not (is_numeric(kinds[n]) or is_categorical(kinds[n])):
            skipped[n] = "unsupported_dtype"
        elif len(usable) >= max_features:
            skipped[n] = "exceeds_max_features"
        else:
            usable.append(n)
    if task == "regression" and not is_numeric(kinds[target]):
        raise ValueError("a regression target must be numeric")
    y = present(target, kinds[target])
    labelled = df.where(y.isNotNull())
    seen = _counts(labelled, usable)
    levels = labelled.agg(*[F.count_distinct(present(n, kinds[n])).alias(f"l{i}") for i, n in enumerate(usable)], F.count_distinct(y).alias("t")).first() if usable else None
    if task == "classification" and levels and levels["t"] > MAX_CATEGORIES:
        raise ValueError("too many target classes")
    tests, numeric, category = [], None, None
    for i, n in enumerate(usable):
        if not seen["present"][n]:
            skipped[n] = "all_missing"
            continue
        if seen["constant"][n]:
            skipped[n] = "constant"
            continue
        x = present(n, kinds[n])
        if is_categorical(kinds[n]) and levels[i] > max_categories:
            skipped[n] = "exceeds_max_categories"
            continue
        if is_numeric(kinds[n]) and seen["infinite"][n]:
            skipped[n] = "non_finite_values"
            continue
        details = None
        if task == "classification" and is_numeric(kinds[n]):
            name, one = "kruskal_wallis", kruskal(labelled, y, x).first()
            p = chi2_sf(one["statistic"], one["groups"] - 1) if one["statistic"] is not None else None
            details = labelled.groupBy(y.cast("string").alias("class")).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.lit(n).alias("feature"))
            numeric = details if numeric is None else numeric.unionByName(details)
        elif task == "classification":
            name, one = "chi_square", chi_square(labelled, x, y).first()
            p = chi2_sf(one["statistic"], one["degrees"]) if one else None
            details = labelled.where(x.isNotNull()).groupBy(x.cast("string").alias("category"), y.cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"), F.lit(n).alias("feature"))
            category = details if category is None else category.unionByName(details, allowMissingColumns=True)
        elif is_numeric(kinds[n]):
            name = "pearson"
            one = labelled.agg(correlation(x.cast("double"), y.cast("double")).alias("statistic"), F.abs(correlation(x.cast("double"), y.cast("double"))).alias("effect"), F.count_if(x.isNotNull()).alias("n")).first()
            p = pearson_p(one["statistic"], one["n"]) if one["statistic"] is not None and one["n"] >= 3 else None
        else:
            name, one = "kruskal_wallis", kruskal(labelled, x, y).first()
            p = chi2_sf(one["statistic"], one["groups"] - 1) if one["statistic"] is not None else None
            details = labelled.where(x.isNotNull()).groupBy(x.cast("string").alias("category")).agg(F.count(F.lit(1)).alias("count"), F.avg(y).alias("mean"), F.median(y).alias("median"), F.lit(n).alias("feature"))
            category = details if category is None else category.unionByName(details, allowMissingColumns=True)
        if one is None or one["statistic"] is None:
            skipped[n] = "statistical_test_not_applicable"
            continue
        tests.append((n, name, int(one["n"]), float(one["statistic"]), p, float(one["effect"]) if one["effect"] is not None else None))
    spark = df.sparkSession
    table = small(spark, tests, "feature string, test string, n long, statistic double, p_value double, effect double")
    numeric = numeric if numeric is not None else small(spark, [], "class string, count long, mean double, median double, feature string")
    category = category if category is not None else small(spark, [], "category string, count long, feature string")
    return TargetAnalysis(seen["n"], target, task, tuple(names), tuple(t[0] for t in tests), tuple(skipped), skipped, table, numeric, category, ("no_multiple_testing_correction", "association_is_not_causation"))


