"""Removal of lines that spread over many sites, by HyperLogLog sketches with exact counts near the threshold.

Three passes over narrow rows.  (1) Occurrences by line hash, combined map-side: a line on k sites
occurs at least k times, so rarer lines are out for certain.  (2) For the rest one HyperLogLog
sketch of the sites by line hash; partial sketches merge by aggregation, so a line in a third of
all rows costs one sketch a task.  (3) Lines whose estimate lies within the error band of the
threshold get exact distinct counts.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, staged

MIN_SITES = 5
LOG2_REGISTERS = 12
#: Half width of the exact band in standard errors of the sketch.
SIGMAS = 4.0


def _line(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def wide_hash(*parts: Column) -> Column:
    """128 bits: two XXH64 of unrelated seeds.  Nulls are told from all values."""
    told = [x for p in parts for x in (p.isNull(), p)]
    return F.struct(F.xxhash64(*told).alias("a"), F.xxhash64(F.lit(0x5EED), *told).alias("b"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, log2_registers: int = LOG2_REGISTERS, sigmas: float = SIGMAS) -> DataFrame:
    """(h): hashes of lines that occur on at least ``min_sites`` distinct sites.

    ``lines`` has h (line hash) and site.  Null sites count as none.
    """
    often = staged(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("h"), "often")
    held = lines.where("site is not null").join(bounded(often), "h", "left_semi")
    sketched = staged(held.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log2_registers))).alias("sites")), "sketched")
    band = sigmas * 1.04 / math.sqrt(1 << log2_registers)
    low, high = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    near = sketched.where(F.col("sites").between(low, high)).select("h")
    exact = held.join(bounded(near), "h", "left_semi").select("h", "site").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    return sketched.where(F.col("sites") > high).select("h").union(exact.where(F.col("sites") >= min_sites).select("h"))


def remove_spread_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    site_column: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = 1,
    **sketch: float,
) -> DataFrame:
    """``docs`` with the columns n_lines, n_removed and clean_text added (or replaced).

    A line is what newlines separate; its key is the line without spaces around it.  Lines with a
    key under ``min_chars`` characters are never removed.  clean_text joins the remaining lines
    again.  Null and empty texts are one empty line, clean_text empty.  Null sites count as none.
    Null ids are ids of their own kind.  Repeated rows share their lines and come out alike.  A long
    text costs time in proportion to its lines.  An empty table gives no rows.  Lines and rows are
    known by 128-bit hashes, under which two of 10**13 meet with a chance of 10**-12.  Whole rows are
    exchanged once, to meet the places of their removed lines; tables of hashes are broadcast up to
    a checked bound, which changes the plan alone.
    """
    row = wide_hash(F.col(id_column).cast("string"), F.col(text_column))
    exploded = staged(
        docs.select(row.alias("row"), F.col(site_column).cast("string").alias("site"), F.posexplode(_line(F.col(text_column))).alias("at", "line"))
        .select("row", "site", "at", F.trim("line").alias("line"))
        .where(F.length("line") >= min_chars)
        .select("row", "site", "at", wide_hash(F.col("line")).alias("h")),
        "lines",
    )
    spread = staged(spread_lines(exploded.select("h", "site"), min_sites, **sketch), "spread")
    gone = staged(exploded.join(bounded(spread), "h", "left_semi").groupBy("row").agg(F.collect_set("at").alias("_gm_gone")), "gone")
    discard(exploded)
    marked = docs.withColumn("_gm_row", row).join(gone.withColumnRenamed("row", "_gm_row"), "_gm_row", "left")
    # places are looked up in a hash set: array_except is linear in the lines
    every = _line(F.col(text_column))
    kept = F.transform(F.array(every), lambda lines: F.transform(F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform("_gm_gone", lambda i: i + 1)), lambda i: F.element_at(lines, i)))
    return (
        marked.withColumn("n_lines", F.size(every).cast("long"))
        .withColumn("n_removed", F.when(F.col("_gm_gone").isNull(), 0).otherwise(F.size("_gm_gone")).cast("long"))
        .withColumn("clean_text", F.when(F.col("_gm_gone").isNull(), F.coalesce(F.col(text_column), F.lit(""))).otherwise(F.array_join(F.element_at(kept, 1), "\n")))
        .drop("_gm_row", "_gm_gone")
    )
