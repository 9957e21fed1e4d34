"""Registered queries of the engine's operators on the provided tables, with their SQL twins."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import analysis, audit, features, governance, lifecycle, metrics, modeling, plotdata, profile, quality, risk, strategy
from .plans.conditions import Condition, compile_condition

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{f.name}`"), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


LABELLED = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"

# ---- schema, summary, quality ------------------------------------------------------------------


def _schema_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name)
        return profile.schema_table(df, profile.infer_schema(df)).select("column", "logical_type", "missing_count", "unique_count", "is_constant", F.round("unique_rate", 6).alias("unique_rate"))

    return run


_KINDS = {
    "int": "CASE WHEN u = p THEN 'identifier' ELSE 'numeric' END",
    "double": "'numeric'",
    "time": "'datetime'",
    "string": "CASE WHEN u = p THEN 'identifier' WHEN u <= 50 OR u <= 0.5 * p THEN 'categorical' ELSE 'text' END",
}


def _schema_sql(name: str, columns: dict[str, str]) -> str:
    return union([f"SELECT '{c}' AS \"column\", {_KINDS[k]} AS logical_type, n - p AS missing_count, u AS unique_count, u = 1 AS is_constant, round(u / p, 6) AS unique_rate FROM (SELECT count(*) AS n, count({c}) AS p, count(DISTINCT {c}) AS u FROM {name})" for c, k in columns.items()])


for _name, _columns in {
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "time", "o_orderpriority": "string"},
    "customer": {"c_custkey": "int", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "events": {"event_id": "int", "ts": "time", "user_id": "int", "event_type": "string", "value": "double", "props": "string"},
}.items():
    QUERIES[f"schema_inference_{_name}"] = _schema_query(_name)
    ORACLES[f"schema_inference_{_name}"] = _schema_sql(_name, _columns)

LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem" for c in LINE]))
def summary_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*LINE)
    return rounded(profile.summarize_dataframe(df).column_summary.select("column", "missing_count", "min", "max", "mean", "std", "q25", "median", "q75"))


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1)")
def quality_duplicate_rows(spark, sf_dir):
    return quality.duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang"))


@query(union([f"SELECT '{c}' AS \"column\", max(n) AS top_count, CAST(sum(n) AS BIGINT) AS non_missing FROM (SELECT {c}, count(*) AS n FROM {LABELLED} WHERE {c} IS NOT NULL GROUP BY 1)" for c in ("lang", "source", "quality", "toxic")]))
def quality_near_constant(spark, sf_dir):
    return quality.top_shares(labelled(spark, sf_dir), ["lang", "source", "quality", "toxic"])


@query(
    f"""SELECT 'high_missing_column' AS code, 'quality' AS "column", count(*) - count(quality) AS count FROM {LABELLED} HAVING count(quality) <= 0.6 * count(*)
UNION ALL SELECT 'high_missing_column', 'toxic', count(*) - count(toxic) FROM {LABELLED} HAVING count(toxic) <= 0.6 * count(*)
UNION ALL SELECT 'identifier_like_column', 'doc_id', count(DISTINCT doc_id) FROM documents
UNION ALL SELECT 'near_constant_column', c, n FROM (SELECT 'quality' AS c, max(n) AS n, sum(n) AS s FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1) UNION ALL SELECT 'toxic', max(n), sum(n) FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1)) WHERE n >= 0.95 * s"""
)
def quality_issues_documents(spark, sf_dir):
    df = labelled(spark, sf_dir).select("doc_id", "lang", "source", "quality", "toxic")
    return quality.issue_table(df, quality.check_data_quality(df)).select("code", "column", "count")


# ---- univariate and bivariate analysis -----------------------------------------------------------


@query(
    union(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(median({c}), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4) AS max, round(skewness({c}), 4) AS skew, count(*) FILTER ({c} = 0) AS zero_count, round(count(*) FILTER ({c} = 0) / count({c}), 4) AS zero_rate FROM lineitem"
            for c in LINE
        ]
    )
)
def numeric_profile_lineitem(spark, sf_dir):
    return rounded(analysis.analyze_numeric_features(table(spark, sf_dir, "lineitem"), columns=LINE).summary.drop("position"))


ORDER_LEVELS = ("o_orderstatus", "o_orderpriority")


@query(
    union(
        [
            f"SELECT '{c}' AS \"column\", CAST(sum(n) AS BIGINT) AS count, CAST(0 AS BIGINT) AS missing, count(*) AS \"unique\", arg_min({c}, (-n, f)) AS top, arg_min(n, (-n, f)) AS top_count, round(arg_min(n, (-n, f)) / sum(n), 4) AS top_rate FROM (SELECT {c}, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1)"
            for c in ORDER_LEVELS
        ]
    )
)
def categorical_profile_orders(spark, sf_dir):
    return rounded(analysis.analyze_categorical_features(table(spark, sf_dir, "orders"), columns=ORDER_LEVELS, order_by="o_orderkey").summary)


@query(union([f"SELECT '{c}' AS \"column\", CAST(row_number() OVER (ORDER BY n DESC, f) AS INTEGER) AS rank, {c} AS value, n AS count, round(n / sum(n) OVER (), 4) AS rate FROM (SELECT {c}, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, f) <= 3" for c in ORDER_LEVELS]))
def top_categories_orders(spark, sf_dir):
    return rounded(analysis.analyze_categorical_features(table(spark, sf_dir, "orders"), columns=ORDER_LEVELS, top_n=3, order_by="o_orderkey").top_categories)


_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(union([f"SELECT '{a}' AS \"left\", '{b}' AS \"right\", count(*) AS n, round(corr({a}, {b}), 6) AS correlation FROM lineitem" for a, b in _PAIRS]))
def correlation_pearson_lineitem(spark, sf_dir):
    return rounded(analysis.compute_correlations(table(spark, sf_dir, "lineitem"), columns=LINE).correlations, 6)


ORDER_CUSTOMER = "(SELECT o.*, c.c_acctbal, c.c_mktsegment, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"


def order_customer(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey", "c_name")


@query(f"SELECT 'o_totalprice' AS \"left\", 'c_acctbal' AS \"right\", count(*) AS n, round(corr(a, b), 6) AS correlation FROM (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS a, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS b FROM {ORDER_CUSTOMER})")
def correlation_spearman_orders(spark, sf_dir):
    return rounded(analysis.compute_correlations(order_customer(spark, sf_dir), columns=["o_totalprice", "c_acctbal"], method="spearman").correlations, 6)


_BOUNDS = "SELECT quantile_cont(p_retailprice, 0.25) AS q25, quantile_cont(p_retailprice, 0.75) AS q75 FROM part"


@query(f"SELECT 'p_retailprice' AS \"column\", round(q25, 4) AS q25, round(q75, 4) AS q75, round(q75 - q25, 4) AS iqr, count(*) FILTER (p_retailprice < q25 - 0.25 * (q75 - q25) OR p_retailprice > q75 + 0.25 * (q75 - q25)) AS outlier_count FROM part, ({_BOUNDS}) GROUP BY q25, q75")
def outliers_iqr_summary(spark, sf_dir):
    return rounded(analysis.detect_outliers(table(spark, sf_dir, "part"), columns=["p_retailprice"], threshold=0.25).summary.select("column", "q25", "q75", "iqr", "outlier_count"))


@query(f"SELECT p_partkey, 'p_retailprice' AS \"column\", p_retailprice AS value, CASE WHEN p_retailprice < q25 - 0.25 * (q75 - q25) THEN 'low' ELSE 'high' END AS side FROM part, ({_BOUNDS}) WHERE p_retailprice < q25 - 0.25 * (q75 - q25) OR p_retailprice > q75 + 0.25 * (q75 - q25)")
def outliers_iqr_rows(spark, sf_dir):
    return analysis.detect_outliers(table(spark, sf_dir, "part"), columns=["p_retailprice"], threshold=0.25, key=["p_partkey"]).outliers


@query(f"SELECT c_mktsegment AS \"group\", 'o_totalprice' AS \"column\", count(o_totalprice) AS count, count(*) - count(o_totalprice) AS missing, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.25), 4) AS q25, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q75 FROM {ORDER_CUSTOMER} GROUP BY 1")
def group_comparison_segment(spark, sf_dir):
    return rounded(analysis.compare_groups(order_customer(spark, sf_dir), "c_mktsegment", values=["o_totalprice"]).summary)


def _kruskal_sql(group: str, value: str, source: str) -> str:
    return f"""WITH r AS (SELECT {group} AS g, {value} AS v, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0 AS k FROM {source}),
s AS (SELECT count(*) AS c, sum(k) AS t FROM r GROUP BY g), n AS (SELECT count(*) AS n FROM r),
ties AS (SELECT sum(c * (c * c - 1.0)) AS t FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY v)),
h AS (SELECT (12.0 / (n * (n + 1.0)) * (SELECT sum(t * t / c) FROM s) - 3 * (n + 1)) / (1 - (SELECT t FROM ties) / (CAST(n AS DOUBLE) * n * n - n)) AS h, n, (SELECT count(*) FROM s) AS k FROM n)
SELECT n, k AS groups, round(h, 4) AS statistic, round(greatest(0, (h - k + 1) / (n - k)), 6) AS effect FROM h"""


@query(_kruskal_sql("o_orderstatus", "o_totalprice", "orders"))
def target_kruskal_status_price(spark, sf_dir):
    out = analysis.kruskal(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), F.col("o_totalprice"))
    return out.select("n", "groups", F.round("statistic", 4).alias("statistic"), F.round("effect", 6).alias("effect"))


@query(_kruskal_sql("c_mktsegment", "c_acctbal", "customer"))
def target_kruskal_segment_acctbal(spark, sf_dir):
    out = analysis.kruskal(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), F.col("c_acctbal"))
    return out.select("n", "groups", F.round("statistic", 4).alias("statistic"), F.round("effect", 6).alias("effect"))


def _chi_sql(where: str) -> str:
    return f"""WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem WHERE {where} GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS r FROM c GROUP BY a), cb AS (SELECT b, sum(o) AS k FROM c GROUP BY b), n AS (SELECT CAST(sum(o) AS DOUBLE) AS n FROM c),
e AS (SELECT r * k / n AS e, abs(coalesce(o, 0) - r * k / n) AS d, n, (SELECT count(*) FROM ra) AS la, (SELECT count(*) FROM cb) AS lb FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN c USING (a, b)),
y AS (SELECT e, CASE WHEN la = 2 AND lb = 2 THEN d - least(0.5, d) ELSE d END AS d, n, la, lb FROM e)
SELECT CAST(n AS BIGINT) AS n, la AS levels_left, lb AS levels_right, round(sum(d * d / e), 6) AS statistic, round(sqrt(sum(d * d / e) / (n * (least(la, lb) - 1))), 6) AS effect, (la - 1) * (lb - 1) AS degrees, count(*) FILTER (e < 5) AS low_expected FROM y GROUP BY n, la, lb"""


@query(_chi_sql("true"))
def target_chi2_flag_status(spark, sf_dir):
    return rounded(analysis.chi_square(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus")), 6)


@query(_chi_sql("l_returnflag <> 'A'"))
def target_chi2_yates(spark, sf_dir):
    return rounded(analysis.chi_square(table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'"), F.col("l_returnflag"), F.col("l_linestatus")), 6)


@query("SELECT 'l_quantity' AS feature, 'pearson' AS test, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS statistic, round(abs(corr(l_quantity, l_extendedprice)), 6) AS effect FROM lineitem")
def target_pearson_qty_price(spark, sf_dir):
    out = analysis.analyze_target_relationships(table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice"), "l_extendedprice", task="regression")
    return rounded(out.statistical_tests.select("feature", "test", "n", "statistic", "effect"), 6)


# ---- features --------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / nullif(l_quantity, 0), 9) AS l_extendedprice__div__l_quantity, round(l_extendedprice - l_quantity, 4) AS l_extendedprice__minus__l_quantity, round(l_extendedprice * l_quantity, 4) AS l_extendedprice__times__l_quantity FROM lineitem")
def features_arithmetic_lineitem(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    wanted = [features.FeatureSuggestion(f"l_extendedprice__{w}__l_quantity", t, ("l_extendedprice", "l_quantity"), "") for w, t in (("div", "ratio"), ("minus", "difference"), ("times", "product"))]
    out = features.derive_features(df, wanted).data.drop("l_extendedprice", "l_quantity")
    # a quotient can end in a five at any digit up to the ninth; differences and products cannot
    return out.withColumns({c: F.round(c, 9 if "div" in c else 4) for c in out.columns if "__" in c})


_PARTS = {"year": "year(o_orderdate)", "month": "month(o_orderdate)", "quarter": "quarter(o_orderdate)", "dayofweek": "isodow(o_orderdate) - 1", "is_weekend": "CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END", "days_since__1999_01_01": "date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')"}


@query("SELECT o_orderkey, " + ", ".join(f"CAST({sql} AS DOUBLE) AS o_orderdate__{k}" for k, sql in _PARTS.items()) + " FROM orders")
def features_datetime_orders(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    report = features.suggest_feature_derivations(df, reference_date=dt.date(1999, 1, 1))
    return features.derive_features(df, report).data.drop("o_orderdate")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, 'o_orderdate__{p}', 'datetime')" for i, p in enumerate(("year", "month", "quarter", "dayofweek", "is_weekend")))
    + ", (5, 'o_custkey__div__o_totalprice', 'ratio'), (6, 'o_custkey__minus__o_totalprice', 'difference'), (7, 'o_custkey__times__o_totalprice', 'product'), (8, 'o_custkey__binned', 'binning'), (9, 'o_totalprice__binned', 'binning'), (10, 'o_custkey__mean_by__o_orderstatus', 'group_aggregate'), (11, 'o_custkey__mean_by__o_orderpriority', 'group_aggregate')) t(priority, name, feature_type)"
)
def feature_suggestions(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return features.suggestion_table(df, features.suggest_feature_derivations(df)).select("priority", "name", "feature_type")


# ---- conditions and audit ----------------------------------------------------------------------------


def _verdicts(df: DataFrame, conditions: dict[str, Condition], key: str) -> DataFrame:
    columns = [F.col(key)]
    for name, c in conditions.items():
        v = compile_condition(c, df)
        columns += [v.truth.alias(f"{name}_truth"), v.status.alias(f"{name}_status"), v.reason.alias(f"{name}_reason")]
    return df.select(*columns)


def _case(name: str, truth: str, reason: str = "'missing_operand'") -> str:
    return f"({truth}) AS {name}_truth, CASE WHEN ({truth}) IS NULL THEN 'not_verifiable' ELSE 'available' END AS {name}_status, CASE WHEN ({truth}) IS NULL THEN {reason} ELSE 'computed' END AS {name}_reason"


@query(f"SELECT doc_id, {_case('good', 'quality = 1')}, {_case('long_text', 'n_chars BETWEEN 100 AND 2000')}, {_case('lang', 'lang IN (' + chr(39) + 'en' + chr(39) + ', ' + chr(39) + 'de' + chr(39) + ')')}, {_case('unlabelled', 'quality IS NULL')} FROM {LABELLED}")
def condition_truth_table(spark, sf_dir):
    return _verdicts(labelled(spark, sf_dir), {"good": Condition(operator="eq", left="quality", right=1), "long_text": Condition(operator="between", left="n_chars", right=(100, 2000)), "lang": Condition(operator="in", left="lang", right=("en", "de")), "unlabelled": Condition(operator="is_missing", left="quality")}, "doc_id")


@query(f"SELECT doc_id, {_case('either', '(quality = 1 AND n_chars > 500) OR toxic = 1')}, {_case('mixed', 'NOT (n_chars > 100)')}, NULL::BOOLEAN AS typed_truth, 'not_verifiable' AS typed_status, CASE WHEN quality IS NULL THEN 'missing_operand' ELSE 'type_mismatch' END AS typed_reason FROM {LABELLED}")
def condition_nested_reason(spark, sf_dir):
    good, long_text, toxic = Condition(operator="eq", left="quality", right=1), Condition(operator="gt", left="n_chars", right=500), Condition(operator="eq", left="toxic", right=1)
    either = Condition("or", children=(Condition("and", children=(good, long_text)), toxic))
    return _verdicts(labelled(spark, sf_dir), {"either": either, "mixed": Condition("not", children=(Condition(operator="gt", left="n_chars", right=100),)), "typed": Condition(operator="eq", left="quality", right="one")}, "doc_id")


@query("SELECT count(*) AS rows, CAST(6 AS BIGINT) AS columns, CAST(0 AS BIGINT) AS duplicate_rows FROM orders")
def audit_dataset_profile(spark, sf_dir):
    return audit.dataset_profile(table(spark, sf_dir, "orders"))


_AUDITED = ("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query(union([f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS missing_rate, count(DISTINCT {c}) AS \"unique\", (SELECT max(n) FROM (SELECT count(*) AS n FROM {LABELLED} WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count, (SELECT count(*) FROM (SELECT 1 FROM {LABELLED} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) = 1)) AS singletons FROM {LABELLED}" for c in _AUDITED]))
def audit_column_profile(spark, sf_dir):
    return rounded(audit.column_profile(labelled(spark, sf_dir).select(*_AUDITED)).select("column", "rows", "missing", "missing_rate", "unique", "top_count", "singletons"), 6)


@query(union([f"SELECT '{c}' AS \"column\", count({c}) AS finite_count, CAST(0 AS BIGINT) AS positive_infinite, CAST(0 AS BIGINT) AS negative_infinite, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75, CAST(max({c}) AS DOUBLE) AS max, 'available' AS status FROM {LABELLED}" for c in ("n_chars", "quality", "toxic")]))
def audit_numeric_profile(spark, sf_dir):
    return rounded(audit.numeric_profile(labelled(spark, sf_dir), ["n_chars", "quality", "toxic"]))


@query(union([f"SELECT '{c}' AS \"column\", count(*) AS levels, CAST(sum(n) AS BIGINT) AS non_missing, count(*) FILTER (n = 1) AS singleton_levels, max(n) AS top_count, round(max(n) / sum(n), 6) AS top_share FROM (SELECT count(*) AS n FROM documents GROUP BY {c})" for c in ("lang", "source")]))
def audit_categorical_profile(spark, sf_dir):
    return rounded(audit.categorical_profile(table(spark, sf_dir, "documents"), ["lang", "source"]), 6)


@query(f"SELECT CAST(quality AS VARCHAR) AS class, count(*) AS count, CASE WHEN quality IS NOT NULL THEN round(count(*) / (SELECT count(*) FROM labels), 6) END AS rate, coalesce(CASE WHEN quality IS NOT NULL THEN count(*) / (SELECT count(*) FROM labels) END < 0.05, false) AS is_rare FROM {LABELLED} GROUP BY quality")
def audit_target_profile(spark, sf_dir):
    return rounded(audit.target_profile(labelled(spark, sf_dir), "quality"), 6)


@query(
    f"""WITH s AS (SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'overall' END AS slice_role, coalesce(lang, source) AS slice_value, count(*) AS rows, count(quality) AS labelled, count(*) FILTER (quality = 1) AS events FROM {LABELLED} GROUP BY GROUPING SETS ((), (lang), (source)))
SELECT slice_role, slice_value, rows, labelled, round(labelled / rows, 6) AS coverage, round(events / nullif(labelled, 0), 6) AS event_rate, round(events / nullif(labelled, 0) - (SELECT events / labelled FROM s WHERE slice_role = 'overall'), 6) AS event_rate_gap FROM s"""
)
def audit_slice_profile(spark, sf_dir):
    return rounded(audit.slice_profile(labelled(spark, sf_dir), ["lang", "source"], "quality"), 6)


@query("SELECT " + " || ".join(f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in _AUDITED) + f" AS pattern, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents), 6) AS rate FROM {LABELLED} GROUP BY 1")
def audit_missing_patterns(spark, sf_dir):
    return rounded(audit.missing_patterns(labelled(spark, sf_dir), _AUDITED), 6)


def _sides(spark, sf_dir):
    df = labelled(spark, sf_dir).select("doc_id", "source", "quality", "toxic")
    early = F.col("source").isin("src0", "src1", "src2", "src3")
    return df.where(early), df.where(~early).drop("toxic").withColumn("extra", F.lit(1))


@query(
    union(
        [
            f"SELECT '{c}' AS \"column\", {a} AS reference_rate, {b} AS current_rate, round(abs({b} - {a}), 6) AS absolute_change FROM (SELECT round(count(*) FILTER (s AND v IS NULL) / count(*) FILTER (s), 6) AS a, round(count(*) FILTER (NOT s AND v IS NULL) / count(*) FILTER (NOT s), 6) AS b FROM (SELECT source IN ('src0', 'src1', 'src2', 'src3') AS s, {v} AS v FROM {LABELLED}))"
            for c, v, a, b in (("doc_id", "doc_id", "a", "b"), ("source", "source", "a", "b"), ("quality", "quality", "a", "b"), ("toxic", "toxic", "a", "NULL::DOUBLE"), ("extra", "1", "NULL::DOUBLE", "b"))
        ]
    )
)
def audit_missing_drift(spark, sf_dir):
    out = audit.missing_drift(*_sides(spark, sf_dir))
    a, b = F.round("reference_rate", 6), F.round("current_rate", 6)
    return out.select("column", a.alias("reference_rate"), b.alias("current_rate"), F.round(F.abs(b - a), 6).alias("absolute_change"))


@query("SELECT * FROM (VALUES ('extra', 'current_column_added', NULL, 'int'), ('toxic', 'current_column_missing', 'int', NULL)) t(\"column\", change, reference_type, current_type)")
def audit_schema_drift(spark, sf_dir):
    return audit.schema_drift(*_sides(spark, sf_dir))


@query("SELECT 'l_extendedprice' AS \"left\", 'gross' AS \"right\", count(*) AS n, round(corr(l_extendedprice, l_extendedprice * 1.5 + 2), 6) AS correlation FROM lineitem")
def audit_collinearity(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_extendedprice") * 1.5 + 2).alias("gross"))
    return rounded(audit.collinearity(df), 6)


@query("SELECT 'l_quantity' AS \"column\", 'range_violation' AS reason, count(*) FILTER (l_quantity < 5 OR l_quantity >= 40) AS count, count(*) AS denominator, round(count(*) FILTER (l_quantity < 5 OR l_quantity >= 40) / count(*), 6) AS rate FROM lineitem UNION ALL SELECT 'l_returnflag', 'allowed_value_violation', count(*) FILTER (l_returnflag NOT IN ('A', 'R')), count(*), round(count(*) FILTER (l_returnflag NOT IN ('A', 'R')) / count(*), 6) FROM lineitem")
def audit_rules_range_allowed(spark, sf_dir):
    rules = [audit.ColumnAuditRule("l_quantity", 5, 40, True, False), audit.ColumnAuditRule("l_returnflag", allowed=("A", "R"))]
    return rounded(audit.rule_violations(table(spark, sf_dir, "lineitem"), rules), 6)


ORDER_LINES = "(SELECT * FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def order_lines(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))


@query(f"SELECT 'o_orderdate' AS \"column\", 'cross_column_order_violation' AS reason, count(*) FILTER (o_orderdate > l_shipdate) AS count, count(*) AS denominator, round(count(*) FILTER (o_orderdate > l_shipdate) / count(*), 6) AS rate FROM {ORDER_LINES}")
def audit_rule_cross_column(spark, sf_dir):
    return rounded(audit.rule_violations(order_lines(spark, sf_dir), [audit.ColumnAuditRule("o_orderdate", not_after=("l_shipdate",))]), 6)


@query("SELECT 'value' AS \"column\", 'monotonic_time_violation' AS reason, count(*) FILTER (value < b) AS count, count(b) AS denominator, round(count(*) FILTER (value < b) / count(b), 6) AS rate FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)")
def audit_rule_nondecreasing(spark, sf_dir):
    return rounded(audit.rule_violations(table(spark, sf_dir, "events"), [audit.ColumnAuditRule("value", nondecreasing=True)], "event_id", "user_id"), 6)


@query("SELECT 'copy' AS \"column\", 'exact_target_copy' AS reason, CAST(1 AS DOUBLE) AS value, count(*) AS support FROM labels UNION ALL SELECT 'level', 'deterministic_categorical_proxy', 1, count(*) FROM labels")
def audit_target_proxy(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("quality", F.col("quality").alias("copy"), (F.col("toxic") + F.col("quality") * 0).alias("other"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("level"))
    return audit.leakage(df, "quality", ["copy", "other", "level"])


@query("SELECT count(*) AS identifiers, count(*) FILTER (k > 1) AS overlapping, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS rows FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS k, count(*) AS n FROM orders GROUP BY 1)")
def audit_partition_overlap(spark, sf_dir):
    return audit.partition_overlap(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING min(source) <> max(source))")
def audit_payload_overlap(spark, sf_dir):
    return audit.payload_overlap(table(spark, sf_dir, "documents"), "source", ["text"])


@query(f"SELECT 'feature_after_observation' AS reason, count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 30 DAY) AS count, count(*) AS denominator, round(count(*) FILTER (l_shipdate > o_orderdate + INTERVAL 30 DAY) / count(*), 6) AS rate, count(*) FILTER (l_shipdate IS NULL OR o_orderdate IS NULL) AS unverified FROM {ORDER_LINES}")
def audit_point_in_time(spark, sf_dir):
    return rounded(audit.point_in_time(order_lines(spark, sf_dir), {"feature_after_observation": (F.col("l_shipdate"), F.col("o_orderdate") + F.lit(dt.timedelta(days=30)))}), 6)


_AUDIT_ROLES = audit.AuditRoles(
    target="y", group="o_custkey", partition="part", key="o_orderkey", features=("copy", "o_totalprice"), exposure="exposure", observation_time="seen", event_time="happened", outcome_end_time="ended", label_available_time="known", partition_cutoff="cutoff",
    window_start="opened", window_end="closed", horizon_end="ended", analysis_as_of="as_of", feature_available_time="measured",
)
_AUDIT_FRAME = """(SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 2 AS twice, CAST(o_totalprice > 150000 AS INTEGER) AS y, CAST(o_totalprice > 150000 AS INTEGER) AS copy, 'c' AS const, CASE WHEN o_orderkey % 3 = 0 THEN 'test' ELSE 'train' END AS part, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE 1 END AS exposure,
o AS seen, CASE WHEN o_orderkey % 4 = 0 THEN o + (CAST(o_orderkey % 7 AS INTEGER) - 2) * INTERVAL 1 DAY END AS happened, o + (CAST(o_orderkey % 9 AS INTEGER) - 1) * INTERVAL 1 DAY AS ended, o + 3 * INTERVAL 1 DAY AS known, TIMESTAMP '1999-01-01' AS cutoff, o - (CAST(o_orderkey % 5 AS INTEGER) - 1) * INTERVAL 1 DAY AS opened, o AS closed,
TIMESTAMP '2000-06-01' AS as_of, o + (CAST(o_orderkey % 6 AS INTEGER) - 4) * INTERVAL 1 DAY AS measured FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS o FROM orders))"""


def audited_orders(spark, sf_dir):
    o, k = F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderkey")
    days = lambda n, less: F.make_dt_interval((k % n).cast("int") - less)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    y = (F.col("o_totalprice") > 150000).cast("int")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("twice"), y.alias("y"), y.alias("copy"), F.lit("c").alias("const"), F.when(k % 3 == 0, "test").otherwise("train").alias("part"), F.when(k % 11 == 0, -1).otherwise(1).alias("exposure"),
        o.alias("seen"), F.when(k % 4 == 0, o + days(7, 2)).alias("happened"), (o + days(9, 1)).alias("ended"), (o + F.lit(dt.timedelta(days=3))).alias("known"), at("1999-01-01 00:00:00").alias("cutoff"), (o - days(5, 1)).alias("opened"), o.alias("closed"), at("2000-06-01 00:00:00").alias("as_of"), (o + days(6, 4)).alias("measured"),
    )


_RELATED = (
    ("observation_after_outcome_end", "seen", ">", "ended"), ("event_before_observation", "seen", ">", "happened"), ("event_after_outcome_end", "happened", ">", "ended"), ("label_before_outcome_end", "ended", ">", "known"), ("observation_at_or_after_cutoff", "seen", ">=", "cutoff"),
    ("window_start_after_window_end", "opened", ">", "closed"), ("window_end_after_analysis_as_of", "closed", ">", "as_of"), ("horizon_end_after_analysis_as_of", "ended", ">", "as_of"),
    *((f"feature_after_observation|{f}", "measured", ">", "seen") for f in ("copy", "o_totalprice")), *((f"feature_after_cutoff|{f}", "measured", ">=", "cutoff") for f in ("copy", "o_totalprice")),
)


@query(union([f"SELECT '{r}' AS reason, count(*) FILTER ({a} {o} {b}) AS count, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS denominator, count(*) FILTER ({a} IS NULL OR {b} IS NULL) AS unverified FROM {_AUDIT_FRAME}" for r, a, o, b in _RELATED]))
def audit_chronology(spark, sf_dir):
    out = audit.point_in_time(audited_orders(spark, sf_dir), audit.chronology(_AUDIT_ROLES))
    return out.select(F.translate("reason", "\0", "|").alias("reason"), "count", "denominator", "unverified")


_FOUND = [
    ("constant_column", "'const'", "count(*)", "count(*)", "1.0"), ("exact_target_copy", "'copy'", "count(*)", "NULL", "1.0"), ("collinear_columns", "'o_totalprice, twice'", "count(*)", "NULL", "1.0"), ("collinear_columns", "'y, copy'", "count(*)", "NULL", "1.0"), ("negative_exposure", "'exposure'", "count(*) FILTER (exposure < 0)", "NULL", "NULL"),
    *((r.split("|")[0], f"'{r.split('|')[1]}'" if "|" in r else "NULL", f"count(*) FILTER ({a} {o} {b})", f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL)", f"round(count(*) FILTER ({a} {o} {b}) / count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), 6)") for r, a, o, b in _RELATED),
    *(("missing_availability_metadata", f"'{r}'", f"count(*) FILTER ({a} IS NULL OR {b} IS NULL)", "count(*)", "NULL") for r, a, o, b in _RELATED[1:3]),
]


@query(
    f"""SELECT * FROM ({union([f"SELECT '{r}' AS reason, {c} AS col, CAST({n} AS BIGINT) AS count, CAST({d} AS BIGINT) AS denominator, CAST({v} AS DOUBLE) AS value FROM {_AUDIT_FRAME}" for r, c, n, d, v in _FOUND])}) WHERE count > 0
UNION ALL SELECT 'group_partition_overlap', 'o_custkey', count(*) FILTER (a <> b), count(*), NULL FROM (SELECT min(part) AS a, max(part) AS b FROM {_AUDIT_FRAME} GROUP BY o_custkey) HAVING count(*) FILTER (a <> b) > 0
UNION ALL SELECT 'singleton_group', 'o_custkey', count(*) FILTER (n = 1), count(*), NULL FROM (SELECT count(*) AS n FROM {_AUDIT_FRAME} GROUP BY o_custkey) HAVING count(*) FILTER (n = 1) > 0"""
)
def audit_findings(spark, sf_dir):
    """Reasons that do not hang on a column's share of distinct values; the others are held to made-up rows in the tests."""
    reasons = {r for r, *_ in _FOUND} | {"group_partition_overlap", "singleton_group"}
    found = audit.audit_data_quality(audited_orders(spark, sf_dir), roles=_AUDIT_ROLES).findings_table(spark)
    return found.where(F.col("reason").isin(*reasons) & ((F.col("reason") != "constant_column") | (F.col("column") == "const"))).select("reason", F.col("column").alias("col"), "count", "denominator", F.round("value", 6).alias("value"))


@query("SELECT count(*) AS pairs, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)")
def audit_duplicate_entity_time(spark, sf_dir):
    return audit.duplicate_entity_time(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("SELECT count(*) AS rows, count(*) FILTER (o_orderdate < b) AS violations FROM (SELECT o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)")
def audit_time_order(spark, sf_dir):
    return audit.time_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT 'source' AS \"column\", source AS value, count(*) AS n FROM documents WHERE lang = 'es' AND source NOT IN (SELECT source FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3')) GROUP BY source")
def audit_unseen_levels(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return audit.unseen_levels(df.where("lang = 'fr' and source in ('src1', 'src2', 'src3')"), df.where("lang = 'es'"), ["source"])


# ---- metrics of binary scores ----------------------------------------------------------------------

# lineitem as a scored table: event: returned; probability: discount in tenths, by ship mode of the part
_SCORED = "(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round(l_discount * 8 + l_tax, 4) AS p, CAST(l_linenumber % 4 AS VARCHAR) AS fold, l_quantity AS exposure, l_extendedprice * 0.01 AS loss FROM lineitem)"


def scored_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_discount") * 8 + F.col("l_tax"), 4).alias("p"), (F.col("l_linenumber") % 4).cast("string").alias("fold"), F.col("l_quantity").alias("exposure"), (F.col("l_extendedprice") * 0.01).alias("loss"))


def scored_rows(spark, sf_dir, fold=True):
    df = scored_lines(spark, sf_dir)
    return metrics.scored(df, F.col("y"), F.col("p"), fold=F.col("fold") if fold else None, probability=F.col("p"))


_CURVE = f"""c AS (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM {_SCORED} GROUP BY 1, 2),
u AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY fold) AS tpos, sum(neg) OVER (PARTITION BY fold) AS tneg FROM c WINDOW w AS (PARTITION BY fold ORDER BY p DESC))"""


@query(
    f"""WITH {_CURVE}
SELECT fold, CAST(max(tpos) AS BIGINT) AS n_pos, CAST(max(tneg) AS BIGINT) AS n_neg, round(sum(neg * (tp - pos) + neg * pos / 2.0) / (max(tpos) * max(tneg)), 6) AS roc_auc,
round(2 * sum(neg * (tp - pos) + neg * pos / 2.0) / (max(tpos) * max(tneg)) - 1, 6) AS normalized_gini, round(sum(pos * tp / (tp + fp)) / max(tpos), 6) AS average_precision,
round(max(round(tp / tpos - fp / tneg, 12)), 6) AS ks_statistic, arg_max(p, (round(tp / tpos - fp / tneg, 12), p)) AS ks_threshold, 'available' AS status, 'computed' AS reason FROM u GROUP BY fold"""
)
def risk_ranking_metrics(spark, sf_dir):
    return rounded(metrics.ranking_metrics(scored_rows(spark, sf_dir)), 6)


@query(f"WITH {_CURVE} SELECT fold, p AS threshold, round(fp / tneg, 6) AS fpr, round(tp / tpos, 6) AS tpr FROM u UNION ALL SELECT DISTINCT fold, 'infinity'::DOUBLE, 0.0, 0.0 FROM u")
def risk_roc_curve(spark, sf_dir):
    return metrics.roc_curve(scored_rows(spark, sf_dir)).select("fold", "threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


@query(f"SELECT fold, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier_score, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q FROM {_SCORED}) GROUP BY fold")
def risk_brier_logloss(spark, sf_dir):
    return rounded(metrics.probability_metrics(scored_rows(spark, sf_dir)), 6)


_BINS = f"SELECT fold, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS m, avg(y) AS e FROM {_SCORED} GROUP BY 1, 2"


@query(f"WITH b AS ({_BINS}), f AS (SELECT DISTINCT fold FROM b) SELECT f.fold, CAST(g.i AS INTEGER) AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_probability, round(e, 6) AS event_rate FROM f CROSS JOIN range(10) g(i) LEFT JOIN b ON b.fold = f.fold AND b.bin = g.i")
def risk_calibration_bins(spark, sf_dir):
    return rounded(metrics.calibration_bins(scored_rows(spark, sf_dir)).select("fold", "bin", "n", "mean_probability", "event_rate"), 6)


@query(f"WITH b AS ({_BINS}) SELECT fold, round(sum(n * abs(e - m)) / sum(n), 6) AS expected_calibration_error FROM b GROUP BY fold")
def risk_ece(spark, sf_dir):
    return rounded(metrics.calibration_error(scored_rows(spark, sf_dir)), 6)


@query(
    f"""WITH {_CURVE}, k AS (SELECT fold, f AS fraction, CAST(greatest(1, ceil(round(f * (tpos + tneg), 9))) AS BIGINT) AS k, p, tp, fp, tpos, tneg FROM u CROSS JOIN (VALUES (0.1::DOUBLE), (0.2), (0.5)) v(f)),
b AS (SELECT fold, fraction, k, max(p) AS boundary FROM k WHERE tp + fp >= k GROUP BY 1, 2, 3)
SELECT b.fold, b.fraction, b.k, boundary, CAST(tp + fp AS BIGINT) AS selected, CAST(tp AS BIGINT) AS selected_pos, round(tp / tpos, 6) AS capture, round((tp / tpos) / ((tp + fp) / (tpos + tneg)), 6) AS lift FROM b JOIN u ON u.fold = b.fold AND u.p = b.boundary"""
)
def risk_gains(spark, sf_dir):
    return rounded(metrics.gains(scored_rows(spark, sf_dir)), 6)


_THRESHOLDS = (0.2, 0.4, 0.6)
_TABLE = f"SELECT fold, t AS threshold, count(*) FILTER (p >= t AND y = 1) AS tp, count(*) FILTER (p >= t AND y = 0) AS fp, count(*) FILTER (p < t AND y = 0) AS tn, count(*) FILTER (p < t AND y = 1) AS fn FROM {_SCORED} CROSS JOIN (VALUES (0.2::DOUBLE), (0.4), (0.6)) v(t) GROUP BY 1, 2"


@query(f"SELECT *, round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tn / nullif(tn + fn, 0), 6) AS negative_predictive_value, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round((tp + fp) / (tp + fp + tn + fn), 6) AS predicted_positive_rate FROM ({_TABLE})")
def risk_thresholds(spark, sf_dir):
    return rounded(metrics.threshold_table(scored_rows(spark, sf_dir), _THRESHOLDS), 6)


@query(f"SELECT fold, 'f1' AS metric, arg_max(threshold, (f1, threshold)) AS threshold, round(max(f1), 6) AS value FROM (SELECT fold, threshold, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM ({_TABLE})) WHERE f1 IS NOT NULL GROUP BY fold")
def risk_operating_point(spark, sf_dir):
    return rounded(metrics.operating_point(metrics.threshold_table(scored_rows(spark, sf_dir), _THRESHOLDS)), 6)


@query(
    f"""WITH s AS {_SCORED}, k AS (SELECT greatest(1, ceil(0.2 * count(*))) AS k FROM s), b AS (SELECT p AS boundary FROM s ORDER BY p DESC LIMIT 1 OFFSET (SELECT CAST(k AS BIGINT) - 1 FROM k)),
x AS (SELECT 'all' AS segment, * FROM s UNION ALL SELECT 'top_fraction', s.* FROM s, b WHERE p >= boundary UNION ALL SELECT 'threshold_selected', * FROM s WHERE p >= 0.4)
SELECT segment, count(*) AS n, round(avg(y), 6) AS event_rate, round(avg(CASE WHEN p >= 0.4 THEN 1 ELSE 0 END), 6) AS predicted_positive_rate, round(sum(exposure), 2) AS exposure_sum, round(sum(loss), 2) AS observed_loss_sum, round(sum(p * exposure * 0.5), 2) AS expected_loss_sum FROM x GROUP BY segment"""
)
def risk_business_metrics(spark, sf_dir):
    out = metrics.business_metrics(scored_lines(spark, sf_dir), F.col("y"), F.col("p"), probability=F.col("p"), exposure=F.col("exposure"), loss_fraction=F.lit(0.5), observed_loss=F.col("loss"), threshold=0.4, fraction=0.2)
    return out.select("segment", "n", F.round("event_rate", 6).alias("event_rate"), F.round("predicted_positive_rate", 6).alias("predicted_positive_rate"), *[F.round(c, 2).alias(c) for c in ("exposure_sum", "observed_loss_sum", "expected_loss_sum")])


@query(f"WITH m AS (SELECT fold, avg((p - y) * (p - y)) AS v FROM {_SCORED} GROUP BY fold) SELECT 'brier_score' AS metric, count(*) AS folds, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sample_std FROM m")
def risk_fold_summary(spark, sf_dir):
    return rounded(metrics.fold_summary(metrics.probability_metrics(scored_rows(spark, sf_dir)), ["brier_score"]), 6)


_CUTS = (dt.datetime(1996, 1, 1), dt.datetime(1997, 6, 1), dt.datetime(1999, 1, 1))
_TIME = risk.TimePlan("o_orderdate", "observation_horizon", _CUTS, dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 15), horizon=dt.timedelta(days=30), reporting_delay=dt.timedelta(days=5))
_RISKY = "(SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS o, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 35 DAY AS a, CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_totalprice > 150000 AS INTEGER) END AS y FROM orders)"


def risky_orders(spark, sf_dir):
    y = F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_totalprice") > 150000).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", y.alias("y"))


def _place(*keys: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '42', {', '.join(f"'=' || {k}" for k in keys)})), 1, 15) AS BIGINT)"


def _plan_sql(fold: str, folds: int) -> str:
    """Counts by fold, for modes in which every other row trains."""
    return f"""WITH r AS (SELECT *, {fold} AS fold FROM {_RISKY} WHERE y IS NOT NULL)
SELECT CAST(k AS INTEGER) AS fold_id, count(*) FILTER (fold IS DISTINCT FROM k) AS train_n, count(*) FILTER (fold IS DISTINCT FROM k AND y = 1) AS train_positive_n, round(avg(y) FILTER (fold IS DISTINCT FROM k), 6) AS train_positive_rate,
count(*) FILTER (fold = k) AS validation_n, count(*) FILTER (fold = k) AS evaluable_validation_n, count(*) FILTER (fold = k AND y = 1) AS evaluable_positive_n, round(avg(y) FILTER (fold = k), 6) AS evaluable_positive_rate, 0::BIGINT AS purged_train_n, 0::BIGINT AS immature_validation_n
FROM r, range({folds}) g(k) GROUP BY k"""


def _folds(spark, sf_dir, **config):
    plan = risk.fold_plan(risky_orders(spark, sf_dir), "y", risk.RiskValidationConfig(**config), ["o_orderkey"])
    names = ("fold_id", "train_n", "train_positive_n", "train_positive_rate", "validation_n", "evaluable_validation_n", "evaluable_positive_n", "evaluable_positive_rate", "purged_train_n", "immature_validation_n")
    return rounded(risk.check_plan(plan).select(*names), 6)


_SHARE = int(0.2 * (1 << 20))


@query(_plan_sql(f"CASE WHEN {_place('y', 'o_orderkey')} % 1048576 < {_SHARE} THEN 0 END", 1))
def risk_stratified_holdout_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="stratified_holdout")


@query(_plan_sql(f"{_place('y', 'o_orderkey')} % 5", 5))
def risk_stratified_kfold_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="stratified_kfold")


@query(_plan_sql(f"CASE WHEN {_place('o_custkey')} % 1048576 < {_SHARE} THEN 0 END", 1))
def risk_group_holdout_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="group_holdout", group="o_custkey")


@query(_plan_sql(f"{_place('o_custkey')} % 5", 5))
def risk_group_kfold_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="group_kfold", group="o_custkey")


def _time_sql(windows) -> str:
    return union(
        [
            f"""SELECT {i} AS fold_id, count(*) FILTER (o < c AND a <= c) AS train_n, count(*) FILTER (o < c AND a <= c AND y = 1) AS train_positive_n, round(avg(y) FILTER (o < c AND a <= c), 6) AS train_positive_rate, count(*) FILTER (o >= c AND o < e) AS validation_n,
count(*) FILTER (o >= c AND o < e AND a <= s) AS evaluable_validation_n, count(*) FILTER (o >= c AND o < e AND a <= s AND y = 1) AS evaluable_positive_n, round(avg(y) FILTER (o >= c AND o < e AND a <= s), 6) AS evaluable_positive_rate,
count(*) FILTER (o < c AND NOT a <= c) AS purged_train_n, count(*) FILTER (o >= c AND o < e AND NOT a <= s) AS immature_validation_n
FROM (SELECT *, TIMESTAMP '{c:%Y-%m-%d}' AS c, TIMESTAMP '{e:%Y-%m-%d}' AS e, TIMESTAMP '2001-01-15' AS s FROM {_RISKY} WHERE y IS NOT NULL)"""
            for i, (c, e) in enumerate(windows)
        ]
    )


@query(_time_sql(_TIME.windows))
def risk_time_forward_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="time_forward", time=_TIME)


_LATE = dataclasses.replace(_TIME, cutoffs=_CUTS[2:])


@query(_time_sql(_LATE.windows))
def risk_time_holdout_plan(spark, sf_dir):
    return _folds(spark, sf_dir, mode="time_holdout", time=_LATE)


_FOLD = " ".join(f"WHEN o >= TIMESTAMP '{c:%Y-%m-%d}' AND o < TIMESTAMP '{e:%Y-%m-%d}' THEN {i}" for i, (c, e) in enumerate(_TIME.windows))


@query(f"SELECT o_orderkey, CASE WHEN y IS NULL THEN 'missing_target' WHEN o < TIMESTAMP '1996-01-01' THEN 'before_first_validation_window' ELSE 'outside_validation_window' END AS reason FROM {_RISKY} WHERE y IS NULL OR o < TIMESTAMP '1996-01-01' OR o >= TIMESTAMP '2001-01-01'")
def risk_excluded_rows(spark, sf_dir):
    df = risky_orders(spark, sf_dir)
    return risk.excluded_rows(df, risk.fold_plan(df, "y", risk.RiskValidationConfig(mode="time_forward", time=_TIME), ["o_orderkey"]), ["o_orderkey"])


@query(
    f"""SELECT o_orderkey, CASE {_FOLD} END AS fold_id, CASE WHEN a <= TIMESTAMP '2001-01-15' THEN y END AS target_value, a <= TIMESTAMP '2001-01-15' AS is_evaluable, CASE WHEN NOT a <= TIMESTAMP '2001-01-15' THEN 'immature_validation_outcome' END AS unevaluable_reason,
-CAST(o_orderkey % 97 AS DOUBLE) AS ranking_score, (o_orderkey % 97) / 97.0 AS event_probability FROM {_RISKY} WHERE y IS NOT NULL AND o >= TIMESTAMP '1996-01-01' AND o < TIMESTAMP '2001-01-01'"""
)
def risk_external_predictions(spark, sf_dir):
    plan = risk.fold_plan(risky_orders(spark, sf_dir), "y", risk.RiskValidationConfig(mode="time_forward", time=_TIME), ["o_orderkey"])
    score = (F.col("o_orderkey") % 97).cast("double")
    given = plan.rows.where("fold is not null").select("o_orderkey", "fold", score.alias("ranking_score"), (score / 97).alias("event_probability"))
    return risk.prediction_table(risk.external_predictions(plan, given, ["o_orderkey"], "lower_risk"), "y", ["o_orderkey"])


@query()
def risk_validation_report(spark, sf_dir):
    return rounded(risk.validate_predictions(scored_lines(spark, sf_dir), "y", "p", config=risk.RiskValidationConfig(), fold="fold", probability="p").metrics, 6)

# ---- decision strategies -----------------------------------------------------------------------------


def customer_orders(spark, sf_dir):
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spent"))
    return table(spark, sf_dir, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey").withColumn("score", F.round(F.pmod(F.col("c_custkey"), F.lit(97)) / 97, 6)).withColumn("late", (F.pmod(F.col("c_custkey"), F.lit(7)) == 0).cast("int")).withColumns({"ripe": F.when(F.pmod(F.col("c_custkey"), F.lit(5)) != 2, F.col("late")), "owed": F.abs("c_acctbal"), "lost": F.col("late") * F.abs("c_acctbal") / 4})


CUSTOMERS = "(SELECT c.*, o.orders, o.spent, round((c_custkey % 97) / 97.0, 6) AS score, CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS late, CASE WHEN c_custkey % 5 <> 2 THEN CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END END AS ripe, abs(c_acctbal) AS owed, CASE WHEN c_custkey % 7 = 0 THEN abs(c_acctbal) / 4 ELSE 0 END AS lost FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1) o ON c_custkey = o_custkey)"


# metric, operator, threshold and action of a constraint each; one asks for more support than there is
_LIMITS = (
    ("action_count", "ge", 10.0, "accept"), ("action_rate", "le", 0.2, "decline"), ("selected_rate", "ge", 0.9, None), ("rejected_rate", "le", 0.05, None), ("review_count", "le", 20.0, None), ("review_rate", "le", 0.5, None),
    ("request_information_rate", "le", 0.1, None), ("selected_exposure_sum", "ge", 1000.0, None), ("expected_loss_sum", "le", 1000.0, None), ("expected_loss_rate", "le", 0.3, None), ("observed_loss_sum", "le", 100.0, None),
    ("observed_loss_rate", "le", 0.5, None), ("selected_event_rate", "le", 0.1, None),
)


def strategy_config() -> strategy.DecisionStrategyConfig:
    rule = strategy.DecisionRule
    return strategy.DecisionStrategyConfig(
        "limits", "1", dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1),
        (
            rule("in_debt", "eligibility", 1, Condition(operator="lt", left="c_acctbal", right=-500.0), "decline"),
            rule("large", "decision", 1, Condition(operator="ge", left="spent", right=1_000_000.0), "accept", stop_on_hit=False),
            rule("frequent", "decision", 2, Condition(operator="ge", left="orders", right=12), "accept", stop_on_hit=False),
            rule("risky", "decision", 3, Condition(operator="ge", left="score", right=0.8), "check"),
        ),
        "accept", "check", (("accept", "selected"), ("check", "review"), ("decline", "rejected")),
        constraints=tuple(strategy.DecisionConstraint(f"{m}_{o}", m, o, t, a, 1) for m, o, t, a in _LIMITS),
        historical_action_column="c_nationkey", historical_action_mapping=((0, "accept"), (1, "accept"), (2, "decline"), (3, "check")), action_assumptions=(("accept", 40.0, 5.0), ("check", 10.0, 8.0), ("decline", 0.0, 1.0)),
        outcome_column="ripe", probability_column="score", exposure_column="owed", loss_fraction=0.4, observed_loss_column="lost", segment_columns=("c_mktsegment",),
    )


# the fold as nested cases: e eligibility; a, b, c the decision rules; x stands for unknown
_DECIDED = f"""(SELECT *, CASE WHEN e THEN 'decline' WHEN e IS NULL THEN 'check'
 WHEN a IS NULL THEN 'check' WHEN a AND b IS NULL THEN 'check' WHEN a AND c IS NULL THEN 'check' WHEN a AND c THEN 'check' WHEN a THEN 'accept'
 WHEN b IS NULL THEN 'check' WHEN b AND c IS NULL THEN 'check' WHEN b AND c THEN 'check' WHEN b THEN 'accept' WHEN c IS NULL THEN 'check' WHEN c THEN 'check' ELSE 'accept' END AS final_action_name,
 CASE WHEN e THEN 'computed' WHEN e IS NULL THEN 'unknown_condition' WHEN (a OR b) AND coalesce(c, false) AND a IS NOT NULL AND b IS NOT NULL THEN 'rule_conflict'
 WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'unknown_condition' WHEN a OR b OR c THEN 'computed' ELSE 'default_action_applied' END AS decision_reason,
 CASE WHEN e THEN 'in_debt' WHEN a THEN 'large' WHEN a IS NULL THEN NULL WHEN b THEN 'frequent' WHEN b IS NULL THEN NULL WHEN c THEN 'risky' END AS applied_rule_key
 FROM (SELECT *, c_acctbal < -500 AS e, spent >= 1000000 AS a, orders >= 12 AS b, score >= 0.8 AS c FROM {CUSTOMERS}))"""


def decided(spark, sf_dir, **options):
    return strategy.decide(customer_orders(spark, sf_dir), strategy_config(), **options)


@query(f"SELECT c_custkey, final_action_name, decision_reason, applied_rule_key FROM {_DECIDED}")
def strategy_row_decisions(spark, sf_dir):
    return strategy.row_decisions(decided(spark, sf_dir), ["c_custkey"]).select("c_custkey", "final_action_name", "decision_reason", "applied_rule_key")


_TRUTHS = {"in_debt": "e", "large": "a", "frequent": "b", "risky": "c"}


@query(union([f"SELECT c_custkey, '{k}' AS rule_key, {i} AS rule_order, CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} THEN 'true' ELSE 'false' END AS truth, CASE WHEN {v} IS NULL THEN 'missing_operand' ELSE 'computed' END AS reason, coalesce(applied_rule_key = '{k}', false) AS is_applied FROM {_DECIDED}" for i, (k, v) in enumerate(_TRUTHS.items())]))
def strategy_rule_evaluations(spark, sf_dir):
    return strategy.rule_evaluations(decided(spark, sf_dir), ["c_custkey"]).select("c_custkey", "rule_key", "rule_order", "truth", "reason", "is_applied")


_WITHOUT = {
    "in_debt": "CASE WHEN a IS NULL THEN 'check' WHEN a AND b IS NULL THEN 'check' WHEN a AND c IS NULL THEN 'check' WHEN a AND c THEN 'check' WHEN a THEN 'accept' WHEN b IS NULL THEN 'check' WHEN b AND coalesce(c, true) THEN 'check' WHEN b THEN 'accept' WHEN coalesce(c, true) THEN 'check' ELSE 'accept' END",
    "large": "CASE WHEN e THEN 'decline' WHEN e IS NULL THEN 'check' WHEN b IS NULL THEN 'check' WHEN b AND coalesce(c, true) THEN 'check' WHEN b THEN 'accept' WHEN coalesce(c, true) THEN 'check' ELSE 'accept' END",
    "frequent": "CASE WHEN e THEN 'decline' WHEN e IS NULL THEN 'check' WHEN a IS NULL THEN 'check' WHEN a AND coalesce(c, true) THEN 'check' WHEN a THEN 'accept' WHEN coalesce(c, true) THEN 'check' ELSE 'accept' END",
    "risky": "CASE WHEN e THEN 'decline' WHEN e IS NULL THEN 'check' WHEN a IS NULL THEN 'check' WHEN a AND b IS NULL THEN 'check' WHEN a THEN 'accept' WHEN b IS NULL THEN 'check' ELSE 'accept' END",
}


_SCOPE = "CASE WHEN c_mktsegment IS NULL THEN 'overall' ELSE 'c_mktsegment' END AS scope, c_mktsegment"
_BY_SEGMENT = "GROUP BY GROUPING SETS ((), (c_mktsegment))"


def _tall(labels: str, source: str, values: dict[str, str]) -> str:
    """Metrics as rows; a metric is SQL for its value (null where a denominator is zero) and for its support."""
    return " UNION ALL ".join(f"SELECT {labels}, '{m}' AS metric, round(CAST({v} AS DOUBLE), 4) AS value, CAST({support} AS BIGINT) AS support FROM {source}" for m, (v, support) in values.items())


def _rule_sql(rule: str, truth: str, path: str, overlap: str, conflict: str) -> str:
    return f"""SELECT {_SCOPE}, '{rule}' AS rule_key, count(*) AS n, count(*) FILTER ({path}) AS evaluated, count(*) FILTER ({truth}) AS hit, count(*) FILTER ({truth} IS NULL) AS unknown, count(*) FILTER (NOT {path}) AS skipped, count(*) FILTER (applied_rule_key = '{rule}') AS applied,
count(*) FILTER ({truth} AND hits = 1) AS sole, count(*) FILTER ({overlap}) AS overlap, count(*) FILTER ({conflict}) AS conflict, count(*) FILTER (final_action_name <> {_WITHOUT[rule]}) AS changed, count(ripe) AS mature, count(*) FILTER (ripe = 1) AS positive, count(*) FILTER (ripe = 1 AND {truth}) AS captured
FROM (SELECT *, coalesce(CAST(e AS INTEGER), 0) + CASE WHEN e IS NOT NULL AND NOT e THEN coalesce(CAST(a AS INTEGER), 0) + coalesce(CAST(b AS INTEGER), 0) + coalesce(CAST(c AS INTEGER), 0) ELSE 0 END AS hits, coalesce(NOT e, false) AS open FROM {_DECIDED}) {_BY_SEGMENT}"""


_RULE_CELLS = union(
    [
        _rule_sql("in_debt", "e", "true", "false", "false"),
        _rule_sql("large", "a", "open", "false", "false"),
        _rule_sql("frequent", "b", "(open AND a IS NOT NULL)", "(open AND b AND coalesce(a, true))", "false"),
        _rule_sql("risky", "c", "(open AND a IS NOT NULL AND b IS NOT NULL)", "(open AND c AND (a IS NULL OR b IS NULL OR a OR b))", "(open AND c AND a IS NOT NULL AND b IS NOT NULL AND (a OR b))"),
    ]
)


@query(
    f"WITH w AS ({_RULE_CELLS}) "
    + _tall(
        "scope, c_mktsegment, rule_key",
        "w",
        {
            "evaluated_count": ("evaluated", "n"), "hit_count": ("hit", "n"), "hit_rate": ("hit / nullif(evaluated, 0)", "evaluated"), "unknown_count": ("unknown", "n"), "unknown_rate": ("unknown / nullif(evaluated, 0)", "evaluated"),
            "not_evaluated_count": ("skipped", "n"), "applied_count": ("applied", "n"), "sole_hit_count": ("sole", "n"), "overlap_count": ("overlap", "n"), "overlap_rate": ("overlap / nullif(evaluated, 0)", "evaluated"),
            "conflict_count": ("conflict", "n"), "incremental_action_count": ("applied", "n"), "leave_one_out_changed_action_count": ("changed", "n"), "captured_event_count": ("captured", "mature"),
            "target_capture_rate": ("captured / nullif(positive, 0)", "positive"),
        },
    )
)
def strategy_rule_summary(spark, sf_dir):
    return rounded(strategy.rule_summary(decided(spark, sf_dir, leave_one_out=True), strategy_config()).select("scope", "c_mktsegment", "rule_key", "metric", "value", "support"))


_PRICED = f"(SELECT *, score * owed * 0.4 AS el, ripe * owed * 0.4 AS ol, CASE final_action_name WHEN 'accept' THEN 40.0 WHEN 'check' THEN 10.0 ELSE 0.0 END AS worth, CASE final_action_name WHEN 'accept' THEN 5.0 WHEN 'check' THEN 8.0 ELSE 1.0 END AS price, CASE final_action_name WHEN 'accept' THEN 'selected' WHEN 'check' THEN 'review' ELSE 'rejected' END AS role FROM {_DECIDED})"


def _group_sql(label: str, group: str) -> str:
    return f"""SELECT {_SCOPE}, {label}, count(*) AS whole, count(*) FILTER ({group}) AS n, count(ripe) FILTER ({group}) AS mature, count(*) FILTER ({group} AND ripe = 1) AS events, coalesce(sum(owed) FILTER ({group}), 0) AS owed, coalesce(sum(el) FILTER ({group}), 0) AS el, coalesce(sum(ol) FILTER ({group}), 0) AS ol,
coalesce(sum(worth) FILTER ({group}), 0) AS worth, coalesce(sum(price) FILTER ({group}), 0) AS price, coalesce(sum(worth - price - el) FILTER ({group}), 0) AS payoff, sum(lost) FILTER ({group}) AS lost, avg(score) FILTER ({group}) AS s_mean, min(score) FILTER ({group}) AS s_min, max(score) FILTER ({group}) AS s_max,
count(*) FILTER ({group} AND role = 'selected') AS selected, count(*) FILTER ({group} AND role = 'rejected') AS rejected, count(*) FILTER ({group} AND role = 'review') AS review, count(*) FILTER ({group} AND c_nationkey IN (0, 1, 2, 3)) AS mapped,
count(ripe) FILTER ({group} AND role = 'selected') AS chosen, count(*) FILTER ({group} AND role = 'selected' AND ripe = 1) AS chosen_events FROM {_PRICED} {_BY_SEGMENT}"""


_SUMS = {
    "exposure_sum": ("owed", "n"), "expected_loss_sum": ("el", "n"), "assumption_based_observed_event_loss_sum": ("CASE WHEN mature > 0 THEN ol END", "mature"), "assumed_action_value_sum": ("worth", "n"), "assumed_action_cost_sum": ("price", "n"),
    "assumption_based_payoff_sum": ("payoff", "n"),
}
_ACTIONS = union([_group_sql(f"'{a}' AS action", f"final_action_name = '{a}'") for a in ("accept", "check", "decline")])


@query(
    f"WITH w AS ({_ACTIONS}) "
    + _tall("scope, c_mktsegment, action", "w", {"action_count": ("n", "whole"), "action_rate": ("n / whole", "whole"), "evaluable_event_count": ("nullif(mature, 0)", "mature"), "event_count": ("CASE WHEN mature > 0 THEN events END", "mature"), "event_rate": ("events / nullif(mature, 0)", "mature")} | _SUMS)
)
def strategy_action_summary(spark, sf_dir):
    return rounded(strategy.action_summary(decided(spark, sf_dir), strategy_config()).select("scope", "c_mktsegment", "action", "metric", "value", "support"))


_ROLES = union([_group_sql("CAST(NULL AS VARCHAR) AS role", "true"), *[_group_sql(f"'{r}' AS role", f"role = '{r}'") for r in ("selected", "rejected", "review")]])
_OVERALL = "CASE WHEN scope = 'overall' AND role IS NULL THEN {} END"


@query(
    f"WITH w AS ({_ROLES}) "
    + _tall(
        "scope, c_mktsegment, role",
        "w",
        {f"{p}_{f}": (f"s_{f}", "n") for p in ("ranking_score", "event_probability") for f in ("mean", "min", "max")}
        | _SUMS
        | {
            "row_count": ("n", "n"), "decided_rate": ("n / nullif(n, 0)", "n"), "observed_event_count": ("CASE WHEN mature > 0 THEN events END", "mature"), "observed_event_rate": ("events / nullif(mature, 0)", "mature"),
            "selected_rate": ("selected / nullif(n, 0)", "n"), "rejected_rate": ("rejected / nullif(n, 0)", "n"), "review_capacity_rate": ("review / nullif(n, 0)", "n"), "unknown_action_rate": ("review / nullif(n, 0)", "n"),
            "expected_loss_rate": ("el / nullif(owed, 0)", "n"), "actual_observed_loss_sum": (_OVERALL.format("lost"), f"coalesce({_OVERALL.format('n')}, 0)"), "actual_observed_loss_rate": (_OVERALL.format("lost / owed"), f"coalesce({_OVERALL.format('n')}, 0)"),
            "selected_event_rate": ("chosen_events / nullif(chosen, 0)", "chosen"), "historical_mapped_rate": ("mapped / nullif(n, 0)", "n"),
        },
    )
)
def strategy_business_summary(spark, sf_dir):
    return rounded(strategy.business_summary(decided(spark, sf_dir), strategy_config()).select("scope", "c_mktsegment", "role", "metric", "value", "support"))


_LIMIT_SQL = {
    "action_count": "count(*) FILTER (final_action_name = 'accept')", "action_rate": "avg(CASE WHEN final_action_name = 'decline' THEN 1.0 ELSE 0 END)", "selected_rate": "avg(CASE WHEN role = 'selected' THEN 1.0 ELSE 0 END)",
    "rejected_rate": "avg(CASE WHEN role = 'rejected' THEN 1.0 ELSE 0 END)", "review_count": "count(*) FILTER (role = 'review')", "review_rate": "avg(CASE WHEN role = 'review' THEN 1.0 ELSE 0 END)", "request_information_rate": "0",
    "selected_exposure_sum": "coalesce(sum(owed) FILTER (role = 'selected'), 0)", "expected_loss_sum": "sum(el)", "expected_loss_rate": "sum(el) / sum(owed)", "observed_loss_sum": "sum(lost)", "observed_loss_rate": "sum(lost) / sum(owed)",
    "selected_event_rate": "avg(ripe) FILTER (role = 'selected')",
}


@query(
    f"""WITH w AS (SELECT {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _LIMIT_SQL.items())} FROM {_PRICED}), t AS ({" UNION ALL ".join(f"SELECT '{m}_{o}' AS constraint_key, {m} AS v, {m} - {t} AS d, '{o}' AS o FROM w" for m, o, t, _ in _LIMITS)})
SELECT constraint_key, round(v, 4) AS value, round(CASE o WHEN 'ge' THEN d ELSE -d END, 4) + 0.0 AS gap, round(greatest(0, CASE o WHEN 'ge' THEN -d ELSE d END), 4) + 0.0 AS violation, 'available' AS status, CASE WHEN (o = 'ge' AND d >= 0) OR (o = 'le' AND d <= 0) THEN 'constraint_satisfied' ELSE 'constraint_failed' END AS reason FROM t"""
)
def strategy_constraints(spark, sf_dir):
    found = rounded(strategy.constraints(decided(spark, sf_dir), strategy_config()).select("constraint_key", "value", "gap", "violation", "status", "reason"))
    return found.withColumns({c: F.col(c) + F.lit(0.0) for c in ("gap", "violation")})


@query(
    f"""WITH t AS (SELECT CASE c_nationkey WHEN 0 THEN 'accept' WHEN 1 THEN 'accept' WHEN 2 THEN 'decline' WHEN 3 THEN 'check' END AS h, final_action_name AS f FROM {_DECIDED})
SELECT h AS historical_action, CASE WHEN h IS NOT NULL THEN f END AS final_action, count(*) AS rows, round(count(*) / (SELECT count(*) FROM customer), 6) AS rate, CASE WHEN h IS NULL THEN 'not_verifiable' ELSE 'available' END AS status FROM t GROUP BY 1, 2"""
)
def strategy_transitions(spark, sf_dir):
    return rounded(strategy.transitions(decided(spark, sf_dir), strategy_config()).drop("reason"), 6)


@query(union([f"SELECT '{k}' AS rule_key, count(*) AS rows, count(*) FILTER (final_action_name <> {v}) AS changed_actions, round(count(*) FILTER (final_action_name <> {v}) / count(*), 6) AS changed_rate FROM {_DECIDED}" for k, v in _WITHOUT.items()]))
def strategy_leave_one_out(spark, sf_dir):
    return rounded(strategy.leave_one_out(decided(spark, sf_dir, leave_one_out=True), strategy_config()), 6)


@query(
    f"""WITH a AS (SELECT *, events / nullif(mature, 0) AS event_rate FROM ({_ACTIONS})), o AS (SELECT action, event_rate AS b FROM a WHERE scope = 'overall')
SELECT c_mktsegment, action, round(event_rate, 4) AS value, round(b, 4) AS overall_baseline, round(event_rate - b, 4) AS absolute_delta FROM a JOIN o USING (action) WHERE scope = 'c_mktsegment'"""
)
def strategy_segment_baseline_delta(spark, sf_dir):
    rows = strategy.action_summary(decided(spark, sf_dir), strategy_config()).where("metric = 'event_rate'")
    return rounded(strategy.with_baseline(rows, ["action"]).select("c_mktsegment", "action", "value", "overall_baseline", "absolute_delta"))


# ---- lifecycle monitoring ------------------------------------------------------------------------------

_AS_OF = dt.datetime(2024, 1, 31)


def event_panel(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return df.withColumn("purchase_ts", F.when(F.col("event_type") == "purchase", F.col("ts")))


def lifecycle_config(**changes: object) -> lifecycle.LifecycleConfig:
    rule = lifecycle.WarningRule
    high, higher = Condition(operator="ge", left="value", right=60.0), Condition(operator="ge", left="value", right=120.0)
    base = {
        "analysis_as_of": _AS_OF, "entity": "user_id", "observed": "ts", "key": "event_id", "feature": "value",
        "scenarios": (lifecycle.WarningScenario("base", "single_threshold", (rule("high", 1, "warn", high),)), lifecycle.WarningScenario("strict", "rule_set", (rule("higher", 1, "alarm", higher, persistence=2, resolution=2), rule("slow", 2, "warn", high, cooldown=dt.timedelta(days=2)))), ),
        "reference_scenario": "base", "alert_ranks": (("warn", 1), ("alarm", 2)),
        "states": (lifecycle.LifecycleState("low", 0, 3, Condition(operator="lt", left="value", right=30.0)), lifecycle.LifecycleState("mid", 1, 2, Condition(operator="between", left="value", right=(30.0, 90.0))), lifecycle.LifecycleState("top", 2, 1, Condition(operator="gt", left="value", right=90.0))),
        "default_state": "low", "adverse_states": ("top",), "cure_states": ("low",), "event_time": "purchase_ts", "segment_columns": ("event_type",), "horizon": dt.timedelta(days=2), "history_window": dt.timedelta(days=7),
    }
    return lifecycle.LifecycleConfig(**(base | changes))


_EVENTS = "(SELECT *, CAST(event_id % 13 AS DOUBLE) AS other, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 1e6 AS x FROM events)"


def _prior(days: int, column: str) -> str:
    """Rows before this one by time and key, of the last days; the latest of them has the prior value."""
    return f"""SELECT e.event_id, arg_max(p.{column}, (p.ts, p.event_id)) AS prior, avg(p.{column}) AS mean, count(p.{column}) AS n, regr_slope(p.{column}, p.x) AS slope FROM {_EVENTS} e
JOIN {_EVENTS} p ON p.user_id = e.user_id AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id)) AND p.ts >= e.ts - INTERVAL {days} DAY GROUP BY 1"""


@query(f"SELECT e.event_id, round(prior, 4) AS prior_value, round(value - prior, 4) AS change, round(mean, 6) AS history_mean, CASE WHEN n >= 2 THEN round(slope * 86400, 3) + 0.0 END AS trend_per_day FROM events e LEFT JOIN ({_prior(7, 'value')}) USING (event_id)")
def lifecycle_signals(spark, sf_dir):
    out = lifecycle.signals(event_panel(spark, sf_dir), lifecycle_config())
    return out.select("event_id", *[F.round(c, 4).alias(c) for c in ("prior_value", "change")], F.round("history_mean", 6).alias("history_mean"), (F.round(F.col("trend") * 86400, 3) + F.lit(0.0)).alias("trend_per_day"))


@query(
    f"""SELECT e.event_id, round(v.prior, 4) AS recent_prior, round(e.value - l.prior, 4) AS long_change, round(o.mean, 6) AS recent_mean, CASE WHEN m.n >= 2 THEN round(m.slope * 86400, 3) + 0.0 END AS other_trend, CASE WHEN e.value < v.prior THEN 'true' WHEN v.prior IS NULL THEN 'unknown' ELSE 'false' END AS falling
FROM events e LEFT JOIN ({_prior(2, 'value')}) v USING (event_id) LEFT JOIN ({_prior(7, 'value')}) l USING (event_id) LEFT JOIN ({_prior(2, 'other')}) o USING (event_id) LEFT JOIN ({_prior(7, 'other')}) m USING (event_id)"""
)
def lifecycle_signals_two_columns_two_windows(spark, sf_dir):
    name = lifecycle.signal_name
    falling = lifecycle.WarningRule("falling", 1, "warn", Condition(operator="lt", left=name("change", "value", "recent"), right=0.0))
    config = lifecycle_config(features=("other",), recent_window=dt.timedelta(days=2), scenarios=(lifecycle.WarningScenario("base", "single_threshold", (falling,)),))
    df = event_panel(spark, sf_dir).withColumn("other", F.pmod(F.col("event_id"), F.lit(13)).cast("double"))
    asked = [("prior_value", "value", "recent"), ("change", "value", "history"), ("history_mean", "other", "recent"), ("trend", "other", "history")]
    out = lifecycle.signals(df, config, asked)
    matrix = lifecycle.rule_matrix(out, config).select("event_id", F.when(F.col("truth").isNull(), "unknown").otherwise(F.col("truth").cast("string")).alias("falling"))
    cells = [F.col(f"`{name(*x)}`") for x in asked]
    return out.select("event_id", F.round(cells[0], 4).alias("recent_prior"), F.round(cells[1], 4).alias("long_change"), F.round(cells[2], 6).alias("recent_mean"), (F.round(cells[3] * 86400, 3) + F.lit(0.0)).alias("other_trend")).join(matrix, "event_id")


@query("SELECT event_id, round(CASE WHEN ts > TIMESTAMP '2024-01-10' THEN value - m END, 4) AS peer_deviation FROM events LEFT JOIN (SELECT event_type, avg(value) AS m FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-10' GROUP BY 1 HAVING count(*) >= 2) USING (event_type)")
def lifecycle_peer_deviation(spark, sf_dir):
    config = lifecycle_config(peer_groups=("event_type",), peer_start=dt.datetime(2024, 1, 1), peer_end=dt.datetime(2024, 1, 10), available="known")
    out = lifecycle.peer_deviation(event_panel(spark, sf_dir).withColumn("known", F.col("ts") + F.lit(dt.timedelta(days=1))), config)
    return out.select("event_id", F.round("peer_deviation", 4).alias("peer_deviation"))


@query("SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR AS is_consecutive FROM events")
def lifecycle_is_consecutive(spark, sf_dir):
    return lifecycle.signals(event_panel(spark, sf_dir), lifecycle_config(expected_interval=dt.timedelta(hours=6))).select("event_id", "is_consecutive")


@query("SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(o)) / 86400000000.0) AS BIGINT) AS day_index, CAST(floor((epoch_us(ts) - epoch_us(o)) / 604800000000.0) AS BIGINT) AS week_index FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS o FROM events)")
def lifecycle_period_index(spark, sf_dir):
    from pyspark.sql import Window

    df = event_panel(spark, sf_dir).withColumn("o", F.min("ts").over(Window.partitionBy("user_id")))
    return df.select("event_id", lifecycle.period_index(F.col("o"), F.col("ts"), "day").alias("day_index"), lifecycle.period_index(F.col("o"), F.col("ts"), "week").alias("week_index"))


def matrix(spark, sf_dir, **changes):
    config = lifecycle_config(**changes)
    return lifecycle.rule_matrix(event_panel(spark, sf_dir), config, config.segment_columns), config


@query(union([f"SELECT event_id, '{s}' AS scenario_key, '{r}' AS rule_key, value >= {v} AS truth FROM events" for s, r, v in (("base", "high", 60), ("strict", "higher", 120), ("strict", "slow", 60))]))
def lifecycle_rule_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)[0].select("event_id", "scenario_key", "rule_key", "truth")


# without cooldown, persistence or gaps an episode is an island of trues
_ISLANDS = """SELECT user_id, min(ts) AS start_time, count(*) AS hit_count, max(ts) AS last_hit FROM (SELECT *, count(*) FILTER (NOT h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, value >= 60 AS h FROM events)) WHERE h GROUP BY user_id, g"""


@query(f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY start_time) - 1 AS BIGINT) AS episode_ordinal, start_time, hit_count FROM ({_ISLANDS})")
def lifecycle_episodes(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    out = lifecycle.episodes(lifecycle.machines(rows.where("rule_key = 'high'"), config), config)
    return out.select("user_id", "episode_ordinal", "start_time", "hit_count")


@query("SELECT user_id, ts AS notification_time, event_id AS source_key FROM events WHERE value >= 60")
def lifecycle_notifications(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    out = lifecycle.notifications(lifecycle.machines(rows.where("rule_key = 'high'"), config), config)
    return out.select("user_id", "notification_time", "source_key")


def _machine(rules: str, interval: str) -> str:
    """The warning machine as a recursion over an entity's rows: streaks, the open episode, its notifications."""
    return f"""WITH RECURSIVE r AS (SELECT user_id, scenario_key, rule_key, persistence, resolution, cooldown, truth, ts, event_id, row_number() OVER (PARTITION BY user_id, scenario_key, rule_key ORDER BY ts, event_id) AS k FROM ({rules})),
m AS (
  SELECT user_id, scenario_key, rule_key, k, ts, persistence, resolution, cooldown, CASE WHEN truth THEN 1 ELSE 0 END AS t, CASE WHEN NOT truth THEN 1 ELSE 0 END AS f, coalesce(truth, false) AND persistence <= 1 AS open, coalesce(truth, false) AND persistence <= 1 AS opens, false AS closes,
    CASE WHEN truth AND persistence <= 1 THEN 0 ELSE -1 END AS episode, coalesce(truth, false) AND persistence <= 1 AS sends, CASE WHEN truth AND persistence <= 1 THEN ts END AS sent, coalesce(truth, false) AND persistence <= 1 AS counts FROM r WHERE k = 1
  UNION ALL
  SELECT user_id, scenario_key, rule_key, k, ts, persistence, resolution, cooldown, t, f, (was OR opens) AND NOT closes, opens, closes, CASE WHEN opens THEN episode + 1 ELSE episode END, opens OR again, CASE WHEN opens OR again THEN ts ELSE sent END, opens OR (was AND hit)
  FROM (SELECT *, NOT was AND hit AND t >= persistence AS opens, was AND miss AND f >= resolution AS closes, was AND hit AND ts - sent >= cooldown AS again
    FROM (SELECT r.*, m.open AS was, m.episode, m.sent, coalesce(r.truth, false) AND NOT gap AS hit, NOT coalesce(r.truth, true) AND NOT gap AS miss, CASE WHEN coalesce(r.truth, false) AND NOT gap THEN m.t + 1 ELSE 0 END AS t, CASE WHEN NOT coalesce(r.truth, true) AND NOT gap THEN m.f + 1 ELSE 0 END AS f
      FROM m JOIN (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id, scenario_key, rule_key ORDER BY k) > {interval} AS gap FROM r) r ON r.user_id = m.user_id AND r.scenario_key = m.scenario_key AND r.rule_key = m.rule_key AND r.k = m.k + 1))
)"""


_TIMED = union([f"SELECT *, '{s}' AS scenario_key, '{r}' AS rule_key, {p} AS persistence, {q} AS resolution, INTERVAL {c} DAY AS cooldown, value >= {v} AS truth FROM events" for s, r, v, p, q, c in (("base", "high", 60, 1, 1, 0), ("strict", "higher", 120, 2, 2, 0), ("strict", "slow", 60, 1, 1, 2))])


@query(
    f"""{_machine(_TIMED, 'INTERVAL 1 DAY')} SELECT user_id, scenario_key, rule_key, CAST(episode AS BIGINT) AS episode_ordinal, min(ts) FILTER (opens) AS start_time, coalesce(min(ts) FILTER (closes), TIMESTAMP '2024-01-31') AS end_time, CASE WHEN bool_or(closes) THEN 'resolved' ELSE 'unresolved' END AS episode_status,
CAST(count(*) FILTER (counts) AS BIGINT) AS hit_count, CAST(count(*) FILTER (sends) AS BIGINT) AS notification_count, CAST(count(*) FILTER (counts AND NOT sends) AS BIGINT) AS suppressed_count FROM m WHERE episode >= 0 GROUP BY 1, 2, 3, 4"""
)
def lifecycle_episodes_with_cooldown(spark, sf_dir):
    rows, config = matrix(spark, sf_dir, expected_interval=dt.timedelta(days=1))
    return lifecycle.episodes(lifecycle.machines(rows, config), config).drop("alert_rank", "duration_seconds")


@query(f"{_machine(_TIMED, 'INTERVAL 1 DAY')} SELECT user_id, scenario_key, rule_key, ts AS notification_time, CASE WHEN NOT opens THEN 'repeated' WHEN episode > 0 THEN 'episode_reopen' ELSE 'episode_open' END AS notification_kind FROM m WHERE sends")
def lifecycle_notifications_with_cooldown(spark, sf_dir):
    rows, config = matrix(spark, sf_dir, expected_interval=dt.timedelta(days=1))
    return lifecycle.notifications(lifecycle.machines(rows, config), config).select("user_id", "scenario_key", "rule_key", "notification_time", "notification_kind")


@query("SELECT user_id, ts AS event_time, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS BIGINT) AS event_ordinal FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-31'")
def lifecycle_declared_events(spark, sf_dir):
    return lifecycle.declared_events(event_panel(spark, sf_dir), lifecycle_config())


_MATCHED = """SELECT e.user_id, e.ts AS event_time, min(n.ts) AS notification_time, count(*) AS candidate_count FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-31') e
JOIN (SELECT user_id, ts FROM events WHERE value >= 60) n ON e.user_id = n.user_id AND n.ts < e.ts AND e.ts < n.ts + INTERVAL 2 DAY AND n.ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31' GROUP BY 1, 2"""


@query(f"SELECT user_id, event_time, notification_time, candidate_count, (epoch_us(event_time) - epoch_us(notification_time)) / 1e6 AS lead_seconds FROM ({_MATCHED})")
def lifecycle_event_matches(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    notes = lifecycle.notifications(lifecycle.machines(rows.where("rule_key = 'high'"), config), config)
    out = lifecycle.event_matches(notes, lifecycle.declared_events(event_panel(spark, sf_dir), config), config)
    return out.select("user_id", "event_time", "notification_time", "candidate_count", "lead_seconds")


@query("SELECT event_id, ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31' AS is_mature, EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.ts <= TIMESTAMP '2024-01-31' AND p.user_id = o.user_id AND p.ts > o.ts AND p.ts < o.ts + INTERVAL 2 DAY) AS event_within_horizon FROM events o")
def lifecycle_observation_maturity(spark, sf_dir):
    df, config = event_panel(spark, sf_dir), lifecycle_config()
    return lifecycle.observation_maturity(df, lifecycle.declared_events(df, config), config).select("event_id", "is_mature", "event_within_horizon")


_STATES = """SELECT event_id, user_id, ts, s AS effective_state, lag(s) OVER w AS from_state FROM (SELECT *, CASE WHEN value > 90 THEN 'top' WHEN value BETWEEN 30 AND 90 THEN 'mid' ELSE 'low' END AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
_RANK = "CASE {} WHEN 'low' THEN 0 WHEN 'mid' THEN 1 ELSE 2 END"
_HISTORY = f"""SELECT *, CASE WHEN from_state IS NULL THEN 'entry' WHEN from_state = effective_state THEN 'stay' ELSE 'change' END AS transition_kind,
CASE WHEN from_state IS NULL THEN 'not_applicable' WHEN from_state = effective_state THEN 'flat' WHEN {_RANK.format('effective_state')} > {_RANK.format('from_state')} THEN 'roll_forward' ELSE 'roll_back' END AS transition_direction, coalesce(from_state = 'top' AND effective_state = 'low', false) AS is_cure FROM ({_STATES})"""


def history(spark, sf_dir, **changes):
    config = lifecycle_config(**changes)
    return lifecycle.states(event_panel(spark, sf_dir), config), config


@query(f"SELECT event_id, from_state, effective_state, transition_kind, transition_direction, is_cure FROM ({_HISTORY})")
def lifecycle_states(spark, sf_dir):
    return history(spark, sf_dir)[0].select("event_id", "from_state", "effective_state", "transition_kind", "transition_direction", "is_cure")


@query(f"WITH h AS ({_HISTORY}), c AS (SELECT from_state, effective_state, transition_kind, transition_direction, count(*) AS transitions, count(*) FILTER (is_cure) AS cures FROM h GROUP BY 1, 2, 3, 4) SELECT *, round(transitions / sum(transitions) OVER (PARTITION BY from_state), 6) AS rate FROM c")
def lifecycle_transitions(spark, sf_dir):
    return rounded(lifecycle.transition_summary(history(spark, sf_dir)[0]), 6)


@query()
def lifecycle_restricted_transitions(spark, sf_dir):
    return history(spark, sf_dir, allowed_transitions=(("low", "mid"), ("mid", "top"), ("mid", "low")), expected_interval=dt.timedelta(days=1))[0]


@query(f"SELECT effective_state AS state, count(*) AS observations, count(DISTINCT user_id) AS entities, round(count(*) / (SELECT count(*) FROM events), 6) AS rate, round(sum(epoch_us(coalesce(n, TIMESTAMP '2024-01-31')) - epoch_us(ts)) / 1e6, 2) AS seconds_in_state FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM ({_STATES})) GROUP BY 1")
def lifecycle_state_summary(spark, sf_dir):
    rows, config = history(spark, sf_dir)
    out = lifecycle.state_summary(rows, config)
    return out.select("state", "observations", "entities", F.round("rate", 6).alias("rate"), F.round("seconds_in_state", 2).alias("seconds_in_state"))


_RULES = union([f"SELECT event_id, user_id, event_type, '{s}' AS scenario_key, '{r}' AS rule_key, value >= {v} AS truth FROM events" for s, r, v in (("base", "high", 60), ("strict", "higher", 120), ("strict", "slow", 60))])
_SUMMARY = f"""SELECT CASE WHEN rule_key IS NOT NULL THEN 'scenario_key*rule_key' WHEN event_type IS NOT NULL THEN 'scenario_key*event_type' ELSE 'scenario_key' END AS scope, scenario_key, rule_key, event_type, count(*) AS evaluations, count(*) FILTER (truth) AS hits, count(*) FILTER (truth IS NULL) AS unknowns,
count(DISTINCT CASE WHEN truth THEN event_id END) AS hit_rows, count(DISTINCT CASE WHEN truth THEN user_id END) AS hit_entities, round(count(*) FILTER (truth) / count(*), 6) AS hit_rate FROM ({_RULES}) GROUP BY GROUPING SETS ((scenario_key), (scenario_key, rule_key), (scenario_key, event_type))"""


@query(_SUMMARY)
def lifecycle_monitoring_summary(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    return rounded(lifecycle.monitoring_summary(rows, lifecycle.machines(rows, config), config), 6)


def _monitored(spark, sf_dir, **changes):
    df = event_panel(spark, sf_dir).withColumn("chance", F.pmod(F.col("event_id"), F.lit(11)) / 11).withColumn("held", F.pmod(F.col("event_id"), F.lit(101)) * 10.0)
    return lifecycle.monitor_lifecycle(df, lifecycle_config(**changes))


_HITS = f"SELECT r.*, CASE rule_key WHEN 'higher' THEN '2' ELSE '1' END AS alert_rank, ts FROM ({_RULES}) r JOIN (SELECT event_id, ts FROM events) USING (event_id)"
# sums over sets of scenario, rule, alert rank and segment, with the scope's name
_SETS = "GROUPING SETS ((), (scenario_key), (scenario_key, rule_key), (scenario_key, alert_rank), (scenario_key, event_type))"
_NAMED = "CASE WHEN rule_key IS NOT NULL THEN 'scenario_key*rule_key' WHEN alert_rank IS NOT NULL THEN 'scenario_key*alert_rank' WHEN event_type IS NOT NULL THEN 'scenario_key*event_type' WHEN scenario_key IS NOT NULL THEN 'scenario_key' ELSE 'overall' END AS scope"
_SPANS = f"""{_machine(_TIMED, 'INTERVAL 1000 DAY')}, spans AS (SELECT user_id, scenario_key, rule_key, episode, min(ts) FILTER (opens) AS a, coalesce(min(ts) FILTER (closes), TIMESTAMP '2024-01-31') AS b, NOT bool_or(closes) AS unresolved, count(*) FILTER (sends) AS notes FROM m WHERE episode >= 0 GROUP BY 1, 2, 3, 4),
h AS (SELECT x.*, truth AND EXISTS (SELECT 1 FROM spans s WHERE s.user_id = x.user_id AND s.scenario_key = x.scenario_key AND s.rule_key = x.rule_key AND s.a <= x.ts AND x.ts <= s.b) AS lasting FROM ({_HITS}) x)"""


@query(
    f"""{_SPANS}, w AS (SELECT {_NAMED}, scenario_key, rule_key, alert_rank, event_type, count(*) AS active, count(*) FILTER (truth) AS hits, count(DISTINCT event_id) AS rows, count(DISTINCT CASE WHEN truth THEN event_id END) AS hit_rows, count(DISTINCT user_id) AS entities,
count(DISTINCT CASE WHEN truth THEN user_id END) AS warned, count(DISTINCT CASE WHEN lasting THEN event_id END) AS lasting FROM h GROUP BY {_SETS}),
e AS (SELECT scenario_key, rule_key, count(*) AS episodes, count(*) FILTER (unresolved) AS open, sum(notes) AS notes, sum(epoch_us(b) - epoch_us(a)) / 1e6 AS seconds, median((epoch_us(b) - epoch_us(a)) / 1e6) AS middle FROM spans GROUP BY GROUPING SETS ((), (scenario_key), (scenario_key, rule_key))),
j AS (SELECT w.*, coalesce(episodes, 0) AS episodes, coalesce(open, 0) AS open, coalesce(notes, 0) AS notes, coalesce(seconds, 0) AS seconds, middle FROM w LEFT JOIN e ON alert_rank IS NULL AND event_type IS NULL AND w.scenario_key IS NOT DISTINCT FROM e.scenario_key AND w.rule_key IS NOT DISTINCT FROM e.rule_key) """
    + _tall(
        "scope, scenario_key, rule_key, alert_rank, event_type",
        "j",
        {
            "warning_hit_count": ("hits", "active"), "warning_observation_rate": ("hit_rows / rows", "rows"), "warned_entity_count": ("warned", "entities"), "warned_entity_rate": ("warned / entities", "entities"), "persistent_warning_count": ("lasting", "rows"),
            "persistent_warning_rate": ("lasting / rows", "rows"),
        },
    )
    + " UNION ALL "
    + _tall(
        "scope, scenario_key, rule_key, alert_rank, event_type",
        "(SELECT * FROM j WHERE alert_rank IS NULL AND event_type IS NULL)",
        {
            "notification_count": ("notes", "notes"), "notifications_per_entity": ("notes / entities", "entities"), "episode_count": ("episodes", "episodes"), "open_episode_count": ("open", "episodes"), "resolved_episode_count": ("episodes - open", "episodes"),
            "episode_duration_mean": ("seconds / nullif(episodes, 0)", "episodes"), "episode_duration_median": ("middle", "episodes"),
        },
    )
)
def lifecycle_warning_metrics(spark, sf_dir):
    return rounded(_monitored(spark, sf_dir).warning_metrics.select("scope", "scenario_key", "rule_key", "alert_rank", "event_type", "metric", "value", "support"))


@query(f"WITH k AS (SELECT scenario_key, event_id, count(*) FILTER (truth) AS n, max(alert_rank) FILTER (truth) AS top, list(alert_rank) FILTER (truth) AS ranks FROM ({_HITS}) GROUP BY 1, 2) SELECT scenario_key, 'overlap_count' AS metric, CAST(count(*) FILTER (n >= 2) AS DOUBLE) AS value, count(*) AS support FROM k GROUP BY 1 UNION ALL SELECT scenario_key, 'conflict_count', CAST(count(*) FILTER (n >= 2 AND len(list_filter(ranks, lambda r: r = top)) >= 2) AS DOUBLE), count(*) FROM k GROUP BY 1")
def lifecycle_overlap_metrics(spark, sf_dir):
    return _monitored(spark, sf_dir).overlap_metrics.select("scenario_key", "metric", "value", "support")


_BACK_TEST = f"""{_machine(_TIMED, 'INTERVAL 1000 DAY')}, notes AS (SELECT m.user_id, m.scenario_key, m.rule_key, m.ts, r.event_id FROM m JOIN r USING (user_id, scenario_key, rule_key, k) WHERE sends AND m.ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31'),
p AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-31'),
o AS (SELECT event_id, user_id, ts, EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND p.ts > e.ts AND p.ts < e.ts + INTERVAL 2 DAY) AS held FROM events e WHERE ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31'),
v AS (SELECT p.*, EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND p.ts > o.ts AND p.ts < o.ts + INTERVAL 2 DAY) AS ripe FROM p),
owners AS (SELECT v.user_id, v.ts, v.ripe, n.scenario_key, arg_min(n.rule_key, (n.ts, n.rule_key)) AS rule_key, min(n.ts) AS sent FROM v JOIN notes n ON n.user_id = v.user_id AND n.ts < v.ts AND v.ts < n.ts + INTERVAL 2 DAY GROUP BY 1, 2, 3, 4),
best AS (SELECT event_id, scenario_key, arg_min(rule_key, (-CAST(alert_rank AS INTEGER), CASE rule_key WHEN 'slow' THEN 1 ELSE 0 END)) AS rule_key FROM ({_HITS}) WHERE truth GROUP BY 1, 2),
s(scenario_key, rule_key) AS (VALUES (NULL, NULL), ('base', NULL), ('strict', NULL), ('base', 'high'), ('strict', 'higher'), ('strict', 'slow')),
c AS (SELECT scenario_key, rule_key, CASE WHEN scenario_key IS NULL THEN 'overall' WHEN rule_key IS NULL THEN 'scenario_key' ELSE 'scenario_key*rule_key' END AS scope,
  (SELECT count(*) FROM v WHERE ripe) * CASE WHEN s.scenario_key IS NULL THEN 2 ELSE 1 END AS events, (SELECT count(*) FROM owners w WHERE ripe AND (s.scenario_key IS NULL OR w.scenario_key = s.scenario_key)) AS caught,
  (SELECT sum(epoch_us(w.ts) - epoch_us(w.sent)) / 1e6 FROM owners w WHERE ripe AND (s.scenario_key IS NULL OR w.scenario_key = s.scenario_key)) AS lead, (SELECT median((epoch_us(w.ts) - epoch_us(w.sent)) / 1e6) FROM owners w WHERE ripe AND (s.scenario_key IS NULL OR w.scenario_key = s.scenario_key)) AS middle,
  (SELECT count(*) FROM notes n WHERE (s.scenario_key IS NULL OR n.scenario_key = s.scenario_key) AND (s.rule_key IS NULL OR n.rule_key = s.rule_key)) AS notes,
  (SELECT count(*) FROM notes n WHERE (s.scenario_key IS NULL OR n.scenario_key = s.scenario_key) AND (s.rule_key IS NULL OR n.rule_key = s.rule_key) AND EXISTS (SELECT 1 FROM owners w WHERE w.user_id = n.user_id AND w.scenario_key = n.scenario_key AND w.rule_key = n.rule_key AND w.sent = n.ts)) AS matched,
  (SELECT count(DISTINCT event_id) FROM o JOIN best b USING (event_id) WHERE (s.scenario_key IS NULL OR b.scenario_key = s.scenario_key) AND (s.rule_key IS NULL OR b.rule_key = s.rule_key)) AS warned,
  (SELECT count(DISTINCT event_id) FROM o JOIN best b USING (event_id) WHERE held AND (s.scenario_key IS NULL OR b.scenario_key = s.scenario_key) AND (s.rule_key IS NULL OR b.rule_key = s.rule_key)) AS warned_event,
  CASE WHEN s.rule_key IS NULL THEN (SELECT count(*) FROM o WHERE NOT held) ELSE (SELECT count(*) FROM o JOIN best b USING (event_id) WHERE NOT held AND b.scenario_key = s.scenario_key AND b.rule_key = s.rule_key) END AS calm,
  CASE WHEN s.rule_key IS NULL THEN (SELECT count(DISTINCT o.event_id) FROM o JOIN notes n USING (event_id) WHERE NOT held AND (s.scenario_key IS NULL OR n.scenario_key = s.scenario_key))
    ELSE (SELECT count(DISTINCT o.event_id) FROM o JOIN best b USING (event_id) JOIN notes n ON n.event_id = o.event_id AND n.scenario_key = b.scenario_key AND n.rule_key = b.rule_key WHERE NOT held AND b.scenario_key = s.scenario_key AND b.rule_key = s.rule_key) END AS wrong FROM s) """


@query(
    _BACK_TEST
    + _tall(
        "scope, scenario_key, rule_key",
        "c",
        {
            "captured_event_count": ("caught", "events"), "event_recall": ("caught / nullif(events, 0)", "events"), "notification_precision": ("matched / nullif(notes, 0)", "notes"), "false_alert_share": ("(notes - matched) / nullif(notes, 0)", "notes"),
            "false_positive_rate": ("wrong / nullif(calm, 0)", "calm"), "lead_time_mean": ("lead / nullif(caught, 0)", "caught"), "lead_time_median": ("middle", "caught"), "warning_to_event_rate": ("warned_event / nullif(warned, 0)", "warned"),
        },
    )
)
def lifecycle_event_metrics(spark, sf_dir):
    return rounded(_monitored(spark, sf_dir).event_metrics.select("scope", "scenario_key", "rule_key", "metric", "value", "support"))


@query(
    f"""WITH h AS (SELECT DISTINCT scenario_key, event_id, (event_id % 11) / 11.0 AS p, (event_id % 101) * 10.0 AS x FROM ({_RULES}) WHERE truth), w AS (SELECT scenario_key, count(*) AS n, sum(x) AS sx, sum(p * x * 0.4) AS sel FROM h GROUP BY 1) """
    + _tall("scenario_key", "w", {"exposure_sum": ("sx", "n"), "expected_loss_sum": ("sel", "n"), "expected_loss_rate": ("sel / nullif(sx, 0)", "n"), "observed_loss_sum": ("NULL", "0"), "observed_loss_rate": ("NULL", "0")})
)
def lifecycle_loss_metrics(spark, sf_dir):
    return rounded(_monitored(spark, sf_dir, exposure="held", probability="chance", loss_fraction=0.4).loss_metrics.select("scenario_key", "metric", "value", "support"))


@query(
    f"""WITH h AS ({_HISTORY}), w AS (SELECT count(*) AS n, count(*) FILTER (transition_kind <> 'entry') AS moved, count(*) FILTER (transition_direction = 'roll_forward') AS forward, count(*) FILTER (transition_direction = 'roll_back') AS back, count(*) FILTER (transition_kind = 'entry') AS entry,
count(*) FILTER (from_state = 'top') AS adverse, count(*) FILTER (is_cure) AS cure FROM h) """
    + _tall("'all' AS rows", "w", {"observation_count": ("n", "n"), "roll_forward_rate": ("forward / moved", "moved"), "roll_back_rate": ("back / moved", "moved"), "cure_rate": ("cure / nullif(adverse, 0)", "adverse"), "entry_count": ("entry", "n"), "reentry_count": ("0", "n"), "invalid_transition_rate": ("0", "moved")})
)
def lifecycle_state_metrics(spark, sf_dir):
    rows, config = history(spark, sf_dir)
    return rounded(lifecycle.lifecycle_metrics(rows, config).select(F.lit("all").alias("rows"), "metric", "value", "support"))


@query(f"WITH s AS (SELECT scenario_key, evaluations, hits, hit_rate FROM ({_SUMMARY}) WHERE scope = 'scenario_key'), t AS (SELECT scenario_key, evaluations, 'hits' AS metric, CAST(hits AS DOUBLE) AS value FROM s UNION ALL SELECT scenario_key, evaluations, 'hit_rate', hit_rate FROM s), b AS (SELECT metric, value AS r, evaluations AS e FROM t WHERE scenario_key = 'base') SELECT scenario_key, metric, value, r AS reference_value, CASE WHEN evaluations = e THEN value - r END AS difference, CASE WHEN evaluations = e THEN 'available' ELSE 'not_verifiable' END AS status, CASE WHEN evaluations = e THEN 'computed' ELSE 'support_not_comparable' END AS reason FROM t JOIN b USING (metric) WHERE scenario_key <> 'base'")
def lifecycle_scenario_comparison(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    return rounded(lifecycle.scenario_comparison(lifecycle.monitoring_summary(rows, lifecycle.machines(rows, config), config), config), 6)


@query("SELECT CAST(date_trunc('month', o) AS DATE) AS cohort, CAST(floor((epoch_us(ts) - epoch_us(o)) / 604800000000.0) AS BIGINT) AS period_index, count(*) AS observations, count(DISTINCT user_id) AS entities, round(avg(value), 4) AS mean_value FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS o FROM events) GROUP BY 1, 2")
def lifecycle_vintage_cohort(spark, sf_dir):
    return rounded(lifecycle.vintages(event_panel(spark, sf_dir), lifecycle_config(period_unit="week")))


# ---- governance, models, plots ---------------------------------------------------------------------------


def _periods(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    return df.where("fold in ('0', '1')"), df.where("fold not in ('0', '1')")


@query(f"WITH b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) FILTER (fold IN ('0', '1')) AS a, count(*) FILTER (fold NOT IN ('0', '1')) AS b FROM {_SCORED} GROUP BY 1), t AS (SELECT sum(a) AS a, sum(b) AS b FROM b) SELECT CAST(t.a AS BIGINT) AS reference_rows, CAST(t.b AS BIGINT) AS current_rows, round(sum(abs(b.a / t.a - b.b / t.b)) / 2, 6) AS total_variation FROM b, t GROUP BY t.a, t.b")
def governance_prediction_tvd(spark, sf_dir):
    return rounded(governance.total_variation(*_periods(spark, sf_dir), "p"), 6)


_AUC = f"""WITH c AS (SELECT CASE WHEN fold IN ('0', '1') THEN 'reference' ELSE 'current' END AS period, p, sum(y) AS pos, sum(1 - y) AS neg FROM {_SCORED} GROUP BY 1, 2), u AS (SELECT *, sum(pos) OVER (PARTITION BY period ORDER BY p DESC) AS tp FROM c),
m AS (SELECT period, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, sum(neg * (tp - pos) + neg * pos / 2.0) / (sum(pos) * sum(neg)) AS auc FROM u GROUP BY 1)"""


@query(f"{_AUC} SELECT period, n_pos, n_neg, round(auc, 6) AS roc_auc, round(auc - (SELECT auc FROM m WHERE period = 'reference'), 6) AS change FROM m")
def governance_auc_stability(spark, sf_dir):
    return rounded(governance.auc_stability(*_periods(spark, sf_dir), F.col("y"), F.col("p")), 6)


@query(f"""WITH b AS (SELECT CASE WHEN fold IN ('0', '1') THEN 'reference' ELSE 'current' END AS period, (p - y) * (p - y) AS e FROM {_SCORED}), m AS (SELECT period, count(*) AS n, avg(e) AS s FROM b GROUP BY 1)
SELECT period, n, round(s, 6) AS brier_score, round(s - (SELECT s FROM m WHERE period = 'reference'), 6) AS change, round((SELECT stddev_pop(e) / sqrt(count(*)) FROM b WHERE period = 'reference'), 8) AS deviation FROM m""")
def governance_brier_stability(spark, sf_dir):
    periods = _periods(spark, sf_dir)
    out = governance.stability(*periods, F.col("y"), F.col("p")).crossJoin(governance.brier_deviation(periods[0], F.col("y"), F.col("p")).select("deviation"))
    return out.select("period", "n", F.round("brier_score", 6).alias("brier_score"), F.round("change", 6).alias("change"), F.round("deviation", 8).alias("deviation"))


@query(
    f"""WITH m AS (SELECT fold, count(*) AS n, avg((p - y) * (p - y)) AS brier_score FROM {_SCORED} GROUP BY fold)
SELECT 0 AS ordinal, 'champion' AS model, 1::BIGINT AS matches, round(brier_score, 6) AS value, n AS support, 'available' AS status, 'computed' AS reason FROM m WHERE fold = '0' UNION ALL SELECT 1, 'challenger', 1, round(brier_score, 6), n, 'available', 'computed' FROM m WHERE fold = '1'
UNION ALL SELECT 2, 'champion', 0, NULL, NULL, 'not_verifiable', 'source_not_found' UNION ALL SELECT 3, 'challenger', count(*), NULL, max(n), 'not_verifiable', 'source_not_unique' FROM m"""
)
def governance_evidence_resolution(spark, sf_dir):
    table_ = metrics.probability_metrics(scored_rows(spark, sf_dir)).withColumn("kind", F.lit("fold"))
    ref = lambda model, metric, *where: governance.EvidenceRef(model, metric, "metrics", where, "brier_score", support_column="n")
    refs = [ref("champion", "brier", ("fold", "0"), ("kind", "fold")), ref("challenger", "brier", ("fold", "1")), ref("champion", "other", ("fold", "none")), ref("challenger", "other", ("kind", "fold"))]
    return rounded(governance.resolve(refs, {"metrics": table_}).select("ordinal", "model", "matches", "value", "support", "status", "reason"), 6)


def _evidence(spark, sf_dir):
    df = scored_lines(spark, sf_dir)
    out = None
    for model, score in (("champion", F.col("p")), ("challenger", F.col("p") * F.col("p"))):
        one = metrics.probability_metrics(metrics.scored(df, F.col("y"), score, probability=score))
        part = governance.evidence_of(model, one, ["brier_score", "log_loss"])
        out = part if out is None else out.unionByName(part)
    return out


_POLICY = governance.GovernancePolicy("champion", "challenger", (governance.Criterion("brier", "brier_score"), governance.Criterion("loss", "log_loss", tolerance=0.001), governance.Criterion("range", "brier_score", "target_range", 0.2, 0.3), governance.Criterion("absent", "roc_auc")))
_MODELS = f"SELECT avg((p - y) * (p - y)) AS a, avg((p * p - y) * (p * p - y)) AS b, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS la, avg(-(y * ln(r) + (1 - y) * ln(1 - r))) AS lb FROM (SELECT *, least(greatest(p, 1e-15), 1 - 1e-15) AS q, least(greatest(p * p, 1e-15), 1 - 1e-15) AS r FROM {_SCORED})"
_GAINS = f"SELECT 0 AS position, a AS champion_value, b AS challenger_value, a - b AS gain, 0.0 AS t FROM m UNION ALL SELECT 1, la, lb, la - lb, 0.001 FROM m UNION ALL SELECT 2, a, b, greatest(0, 0.2 - a, a - 0.3) - greatest(0, 0.2 - b, b - 0.3), 0 FROM m UNION ALL SELECT 3, NULL, NULL, NULL, 0"


@query(f"WITH m AS ({_MODELS}), g AS ({_GAINS}) SELECT position, round(champion_value, 6) AS champion_value, round(challenger_value, 6) AS challenger_value, round(gain, 6) AS gain, CASE WHEN gain IS NULL THEN NULL WHEN abs(gain) <= t THEN 'tie' WHEN gain > 0 THEN 'challenger' ELSE 'champion' END AS winner FROM g")
def governance_comparison(spark, sf_dir):
    return rounded(governance.compare(_evidence(spark, sf_dir), _POLICY).select("position", "champion_value", "challenger_value", "gain", "winner"), 6)


@query("SELECT 'insufficient_evidence' AS recommendation, CAST(4 AS BIGINT) AS criteria, CAST(1 AS BIGINT) AS unverified, CAST(0 AS BIGINT) AS vetoes")
def governance_recommendation(spark, sf_dir):
    return governance.recommend(governance.compare(_evidence(spark, sf_dir), _POLICY)).select("recommendation", "criteria", "unverified", "vetoes")


@query()
def ml_classifier_eval(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", (F.col("o_totalprice") > 200_000).cast("int").alias("large"))
    return rounded(modeling.evaluate_model(modeling.train_classifier(df, "large", keys=["o_orderkey"])).metrics, 6)


@query()
def ml_regressor_eval(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return rounded(modeling.evaluate_model(modeling.train_regressor(df, "p_retailprice", keys=["p_partkey"])).metrics, 6)


@query(
    """WITH s AS (SELECT count(*) AS n, min(l_extendedprice) AS a, max(l_extendedprice) AS b, 2 * (quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)) * pow(count(*), -1.0 / 3) AS w FROM lineitem),
k AS (SELECT a, b, CAST(least(greatest(ceil(round((b - a) / w, 9)), 1), 50) AS INTEGER) AS k FROM s), c AS (SELECT CAST(least(floor((l_extendedprice - a) * k / (b - a)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM lineitem, k GROUP BY 1)
SELECT 'l_extendedprice' AS "column", CAST(i AS INTEGER) AS bin, round(a + i * (b - a) / k, 4) AS lower, round(a + (i + 1) * (b - a) / k, 4) AS upper, coalesce(n, 0) AS n FROM k CROSS JOIN range((SELECT k FROM k)) g(i) LEFT JOIN c ON bin = i"""
)
def plot_histogram_bins(spark, sf_dir):
    return rounded(plotdata.histogram(table(spark, sf_dir, "lineitem"), ["l_extendedprice"]))


@query(union([f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) / count(*), 6) AS rate FROM {LABELLED}" for c in _AUDITED]))
def plot_missing_rates(spark, sf_dir):
    return rounded(plotdata.missing_rates(labelled(spark, sf_dir).select(*_AUDITED)), 6)




# ---- further audit and monitoring --------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT source IN ('src0', 'src1', 'src2', 'src3') AS early, CASE WHEN quality IS NULL THEN '1' ELSE '0' END || CASE WHEN toxic IS NULL THEN '1' ELSE '0' END AS pattern FROM {LABELLED})
SELECT pattern, count(*) FILTER (early) AS reference_rows, count(*) FILTER (NOT early) AS current_rows, round(count(*) FILTER (NOT early) / (SELECT count(*) FROM s WHERE NOT early) - count(*) FILTER (early) / (SELECT count(*) FROM s WHERE early), 6) AS rate_change FROM s GROUP BY 1""")
def audit_missing_pattern_drift(spark, sf_dir):
    df = labelled(spark, sf_dir)
    early = F.col("source").isin("src0", "src1", "src2", "src3")
    return rounded(audit.pattern_drift(df.where(early), df.where(~early), ["quality", "toxic"]), 6)


@query("SELECT 'o_custkey' AS \"column\", 'numeric' AS reference_type, 'identifier' AS current_type")
def audit_logical_drift(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    once = orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("o_orderstatus"))
    return audit.logical_drift(orders, once)


@query("SELECT 'c_name' AS \"column\", 'audit_input_dtype_mismatch' AS reason, CAST(0 AS BIGINT) AS count UNION ALL SELECT 'c_mktsegment', 'datetime_role_mismatch', 0 UNION ALL SELECT 'c_acctbal', 'negative_exposure', count(*) FILTER (c_acctbal < 0) FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0")
def audit_role_findings(spark, sf_dir):
    return audit.role_findings(table(spark, sf_dir, "customer"), exposure="c_acctbal", times=["c_mktsegment"], numeric=["c_name", "c_nationkey"])


@query("SELECT event_id, 'base' AS scenario_key, 'high' AS rule_key, 1 AS alert_rank, CAST(1 AS BIGINT) AS hit_rules FROM events WHERE value >= 60 UNION ALL SELECT event_id, 'strict', CASE WHEN value >= 120 THEN 'higher' ELSE 'slow' END, CASE WHEN value >= 120 THEN 2 ELSE 1 END, CASE WHEN value >= 120 THEN 2 ELSE 1 END FROM events WHERE value >= 60")
def lifecycle_primary_warnings(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    return lifecycle.primary_warnings(rows, config)


@query("SELECT value, first, row_number() OVER (ORDER BY first) - 1 AS ordinal FROM (SELECT o_orderpriority AS value, min(o_orderkey) AS first FROM orders GROUP BY 1)")
def category_ordinals_orders(spark, sf_dir):
    return lifecycle.category_ordinals(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey")


@query("SELECT CAST(date_trunc('week', ts) AS DATE) AS week, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(date_trunc('quarter', ts) AS DATE) AS quarter, count(*) AS n FROM events GROUP BY 1, 2, 3")
def lifecycle_time_buckets(spark, sf_dir):
    t = F.col("ts")
    return event_panel(spark, sf_dir).groupBy(*[lifecycle.time_bucket(t, u).alias(u) for u in ("week", "month", "quarter")]).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-31'), o AS (SELECT * FROM events WHERE ts + INTERVAL 2 DAY <= TIMESTAMP '2024-01-31'),
t AS (SELECT count(*) AS events FROM p WHERE EXISTS (SELECT 1 FROM o WHERE o.user_id = p.user_id AND p.ts > o.ts AND p.ts < o.ts + INTERVAL 2 DAY)),
m AS (SELECT count(*) AS captured, avg((epoch_us(event_time) - epoch_us(notification_time)) / 1e6) AS lead FROM ({_MATCHED})),
h AS (SELECT count(*) AS mature_hits, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE p.user_id = o.user_id AND p.ts > o.ts AND p.ts < o.ts + INTERVAL 2 DAY)) AS good FROM o WHERE value >= 60)
SELECT 'base' AS scenario_key, events, captured, round(captured / events, 6) AS recall, round(lead, 3) AS mean_lead_seconds, mature_hits, round(good / mature_hits, 6) AS precision FROM t, m, h"""
)
def lifecycle_event_summary(spark, sf_dir):
    rows, config = matrix(spark, sf_dir)
    df, rows = event_panel(spark, sf_dir), rows.where("rule_key = 'high'")
    events = lifecycle.declared_events(df, config)
    notes = lifecycle.notifications(lifecycle.machines(rows, config), config)
    out = lifecycle.event_summary(events, lifecycle.event_matches(notes, events, config), lifecycle.observation_maturity(df, events, config), rows, config)
    return out.withColumns({"recall": F.round("recall", 6), "mean_lead_seconds": F.round("mean_lead_seconds", 3), "precision": F.round("precision", 6)})


@query("SELECT 'base' AS scenario_key, count(*) AS rows, round(sum(value), 2) AS exposure_sum, round(sum(0.25 * value * 0.4), 2) AS expected_loss_sum, round(sum(0.25 * value * 0.4) / sum(value), 6) AS expected_loss_rate FROM events WHERE value >= 60")
def lifecycle_loss_summary(spark, sf_dir):
    config = lifecycle_config()
    df = event_panel(spark, sf_dir).withColumn("pd", F.lit(0.25)).withColumn("ead", F.col("value"))
    rows = lifecycle.rule_matrix(df, config, ["pd", "ead"]).where("scenario_key = 'base'")
    out = lifecycle.loss_summary(rows, config, "ead", 0.4, "pd")
    return out.withColumns({"exposure_sum": F.round("exposure_sum", 2), "expected_loss_sum": F.round("expected_loss_sum", 2), "expected_loss_rate": F.round("expected_loss_rate", 6)})
