"""Closed condition trees compiled to columns: a nullable truth, a status and a reason.

Truth is Kleene's: null is unknown.  Types are known before any row is read, so mismatches are
constants of the plan; only missing and infinite operands depend on data.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_floating, present

# Operators and structural limits.
COMPARISONS = ("eq", "ne", "lt", "le", "gt", "ge")
OPERATORS = (*COMPARISONS, "in", "not_in", "between", "is_missing", "is_not_missing")
MAX_DEPTH, MAX_NODES, MAX_MEMBERS, MAX_STRING = 8, 128, 100, 1024


@dataclass(frozen=True)
class Condition:
    """An atomic comparison of a column with a literal or a column, or and / or / not over children."""

    kind: str = "atomic"
    operator: str | None = None
    left: str | None = None
    right: object = None
    right_kind: str | None = "literal"
    children: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Verdict:
    truth: Column
    reason: Column

    @property
    def status(self) -> Column:
        return F.when(self.truth.isNull(), F.when(self.reason == "outside_effective_window", "inactive").otherwise("not_verifiable")).otherwise("available")

    def struct(self) -> Column:
        return F.struct(self.truth.alias("truth"), self.status.alias("status"), self.reason.alias("reason"))


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType):
        return "string"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, T.TimestampNTZType):
        return "naive"
    if isinstance(kind, T.TimestampType):
        return "aware"
    return "other"


def literal_family(value: object) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        if len(value) > MAX_STRING:
            raise ValueError("literal_too_long")
        return "string"
    if isinstance(value, dt.datetime):
        return "aware" if value.tzinfo else "naive"
    if isinstance(value, dt.date):
        return "date"
    raise ValueError("invalid_literal")


def validate(condition: Condition, df: DataFrame) -> None:
    """Limits first, then shapes and columns."""
    nodes = 0

    def walk(node: Condition, depth: int) -> None:
        nonlocal nodes
        nodes += 1
        if depth > MAX_DEPTH:
            raise ValueError("condition_too_deep")
        if nodes > MAX_NODES:
            raise ValueError("too_many_condition_nodes")
        if node.kind == "atomic":
            if node.children or node.operator not in OPERATORS:
                raise ValueError("invalid_operator")
            if node.left not in df.columns:
                raise ValueError("unknown_column")
            if node.operator in ("is_missing", "is_not_missing"):
                return
            if node.operator in ("in", "not_in", "between"):
                members = tuple(node.right) if isinstance(node.right, (tuple, list)) else ()
                if not members or len(members) > MAX_MEMBERS or len({literal_family(m) for m in members}) != 1:
                    raise ValueError("invalid_literal_tuple")
                if node.operator == "between" and (len(members) != 2 or members[0] > members[1]):
                    raise ValueError("invalid_between")
            elif node.right_kind == "column":
                if node.right not in df.columns:
                    raise ValueError("unknown_column")
            else:
                literal_family(node.right)
            return
        if node.kind not in ("and", "or", "not") or (len(node.children) != 1 if node.kind == "not" else len(node.children) < 2):
            raise ValueError("invalid_condition_shape")
        for child in node.children:
            walk(child, depth + 1)

    walk(condition, 1)


def _literal(value: object) -> Column:
    if isinstance(value, dt.datetime) and not value.tzinfo:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def _compared(df: DataFrame, name: str, operator: str, right: object, right_kind: str | None) -> Verdict:
    kinds = {f.name: f.dataType for f in df.schema.fields}
    left_kind = kinds[name]
    a = present(name, left_kind)
    if right_kind == "column":
        b, other = present(str(right), kinds[str(right)]), family(kinds[str(right)])
        right_floating = is_floating(kinds[str(right)])
    else:
        b, other = _literal(right), literal_family(right)
        right_floating = isinstance(right, float)
    missing = a.isNull() | b.isNull() if right_kind == "column" else a.isNull()
    own = family(left_kind)
    if own != other:
        named = "timezone_mismatch" if {own, other} == {"naive", "aware"} else "type_mismatch"
        return Verdict(F.lit(None).cast("boolean"), F.when(missing, "missing_operand").otherwise(named))
    odd = F.lit(False)
    if is_floating(left_kind):
        odd = odd | (F.abs(a) == float("inf"))
    if right_floating:
        odd = odd | (F.abs(b) == float("inf"))
    outcome = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[operator]
    return Verdict(F.when(~missing & ~odd, outcome), F.when(missing, "missing_operand").when(odd, "nonfinite_operand").otherwise("computed"))


def _pair(a: Verdict, b: Verdict, kind: str) -> Verdict:
    truth = a.truth & b.truth if kind == "and" else a.truth | b.truth
    return Verdict(truth, F.when(truth.isNotNull(), "computed").otherwise(F.when(a.truth.isNull(), a.reason).otherwise(b.reason)))


def compile_condition(condition: Condition, df: DataFrame) -> Verdict:
    validate(condition, df)
    return _compile(condition, df)


def _compile(c: Condition, df: DataFrame) -> Verdict:
    if c.kind == "not":
        inner = _compile(c.children[0], df)
        return Verdict(~inner.truth, inner.reason)
    if c.kind in ("and", "or"):
        out = _compile(c.children[0], df)
        for child in c.children[1:]:
            out = _pair(out, _compile(child, df), c.kind)
        return out
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if c.operator in ("is_missing", "is_not_missing"):
        missing = present(c.left, kinds[c.left]).isNull()
        return Verdict(missing if c.operator == "is_missing" else ~missing, F.lit("computed"))
    if c.operator == "between":
        return _pair(_compared(df, c.left, "ge", c.right[0], "literal"), _compared(df, c.left, "le", c.right[1], "literal"), "and")
    if c.operator in ("in", "not_in"):
        one = _compared(df, c.left, "eq", c.right[0], "literal")
        if family(kinds[c.left]) != literal_family(c.right[0]):
            return one
        inside = present(c.left, kinds[c.left]).isin(list(c.right))
        return Verdict(F.when(one.truth.isNotNull(), inside if c.operator == "in" else ~inside), one.reason)
    return _compared(df, c.left, c.operator, c.right, c.right_kind)


def within_window(verdict: Verdict, time: Column, start: dt.datetime | None, end: dt.datetime | None) -> Verdict:
    """Unknown outside [start, end) of the row's time, and where that time is missing."""
    if start is None and end is None:
        return verdict
    inside = F.lit(True)
    if start is not None:
        inside = inside & (time >= _literal(start))
    if end is not None:
        inside = inside & (time < _literal(end))
    return Verdict(F.when(inside, verdict.truth), F.when(time.isNull(), "missing_evaluation_time").when(~inside, "outside_effective_window").otherwise(verdict.reason))
