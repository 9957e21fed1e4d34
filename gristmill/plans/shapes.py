"""Shapes of results: tall tables from one wide aggregate, and typed small tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_columns(df: DataFrame, wanted: list[str] | tuple[str, ...] | None = None) -> list[str]:
    """Names must be unique even without case; ``wanted`` must be there, in its own order."""
    names = df.columns
    if len({n.lower() for n in names}) != len(names):
        raise ValueError("column names must be unique")
    if wanted is None:
        return list(names)
    if len(set(wanted)) != len(wanted):
        raise ValueError("requested columns must be unique")
    for name in wanted:
        if name not in names:
            raise ValueError(f"unknown column: {name}")
    return list(wanted)


def tall(df: DataFrame, cells: Mapping[str, Mapping[str, Column]], label: str = "column", by: list[str] | None = None) -> DataFrame:
    """One scan and one aggregate for all of ``cells``, turned into a row for each of its keys.

    ``cells`` maps a row label to {output name: aggregate}; every row has the same outputs.
    """
    if not cells:
        raise ValueError("no columns to aggregate")
    grouped = df.groupBy(*(by or []))
    flat = {f"c{i}_{name}": column for i, row in enumerate(cells.values()) for name, column in row.items()}
    wide = grouped.agg(*[column.alias(name) for name, column in flat.items()])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(key).alias(label), *[F.col(f"c{i}_{name}").alias(name) for name in row]) for i, (key, row) in enumerate(cells.items())
    ]
    return wide.select(*(by or []), F.inline(F.array(*rows)))


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows made on the driver."""
    return spark.createDataFrame(rows, schema)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and spilled on executors, never gathered on the driver.

    Spark broadcasts a side whose files, by their pruned columns, look small; what is decoded, exploded or
    derived from them may be many times that.
    """
    return df.hint("merge")
