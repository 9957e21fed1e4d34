"""Mixing sources to target weights by temperature.  DataFrame functions only.

Source token shares p become weights in proportion to p**a.  The exponent a in [0, 1] is bisected:
the flattest mixture that keeps a repetition limit, or the one with a target entropy.  A round
evaluates 31 exponents in one aggregate over the source totals, which are five bisection steps at
once.  Weights become whole token budgets, and budgets become passes over a source: full ones, and
a last one that takes blocks of documents in the order of a keyed permutation until the budget is
spent, ending inside one block at a document.  So a source's part of the plan is a handful of
numbers, whatever its size, and applying the plan is a narrow join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: No document appears more often than this on average in its source.
REPETITION = 2.0
BLOCK_TOKENS, BLOCKS = 1 << 16, 1 << 16
#: At most so many sources are broadcast; above it the joins shuffle.
BROADCAST_SOURCES = 100_000
_STEPS = 5


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, one token at least."""
    return F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4)).cast("long")


def _source(column: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), column.cast("string")), F.lit("n"))


def _number(*parts: Column) -> Column:
    """A keyed permutation number: 60 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def exponent(totals: DataFrame, repetition: float | None = REPETITION, entropy: float | None = None, rounds: int = 6) -> float:
    """The exponent for the totals (tokens) by source, to six decimals.

    With ``entropy`` (nats): the largest exponent whose weights reach it, or 0 when none does.
    Otherwise the smallest one at which no source is repeated more than ``repetition`` times, when
    the most abundant source is used once.
    """
    whole = totals.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("high"), F.min("tokens").alias("low")).first()
    if not whole["t"]:
        return 1.0
    low, high = 0.0, 1.0

    def passing(values: list[float]) -> list[bool]:
        if entropy is None:
            ratio = math.log(whole["high"] / whole["low"])
            return [ratio * (1 - a) <= math.log(repetition or math.inf) + 1e-12 for a in values]
        p = F.col("tokens") / F.lit(float(whole["t"]))
        one = totals.agg(*[F.sum(F.pow(p, F.lit(a))) for a in values], *[F.sum(F.pow(p, F.lit(a)) * F.log(p)) for a in values]).first()
        n = len(values)
        return [math.log(one[i]) - a * one[n + i] / one[i] < entropy for i, a in enumerate(values)]

    # passing() is false below the exponent sought and true above it
    for _ in range(rounds):
        grid = [low + (high - low) * i / (1 << _STEPS) for i in range(1, 1 << _STEPS)]
        held = passing(grid)
        at = held.index(True) if True in held else len(grid)
        low, high = (grid[at - 1] if at else low), (grid[at] if at < len(grid) else high)
    found = high if entropy is None else low
    if entropy is None and passing([0.0])[0]:
        found = 0.0
    return math.ceil(found * 1e6 - 1e-4) / 1e6 if entropy is None else math.floor(found * 1e6 + 1e-4) / 1e6


def plan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", tokens: Column | None = None, repetition: float | None = REPETITION, entropy: float | None = None, budget: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row a source: key, tokens, weight, passes, blocks, and where the last pass ends.

    ``budget``: tokens of the whole mixture; by default the fewest with which the source that is
    used least is used once in full, so that nothing is lost.
    """
    count = estimated_tokens(F.col(text_column)) if tokens is None else tokens
    own = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"), _source(F.col(source_column)).alias("key"), count.alias("tokens"))
    # rebalanced, or each task that reads texts would write a tiny file of these narrow rows
    own = staged(own.hint("rebalance"), "tokens")
    totals = staged(own.groupBy("key").agg(F.sum("tokens").alias("tokens")), "totals")
    a = exponent(totals, repetition, entropy)
    whole = totals.agg(F.sum("tokens").alias("t"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(a))).alias("z"), F.max(F.pow(F.col("tokens").cast("double"), F.lit(1 - a))).alias("m")).first()
    z = whole["z"] or 1.0
    spend = float(budget) if budget else (whole["m"] or 0.0) * z
    budgeted = staged(
        totals.withColumn("weight", F.pow(F.col("tokens").cast("double"), F.lit(a)) / F.lit(z))
        .withColumn("budget", F.round(F.lit(spend) * F.col("weight"), 0).cast("long"))
        .withColumn("passes", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("blocks", F.least(F.lit(BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens)))).cast("long")),
        "budgets",
    )
    dealt = own.join(_bounded(budgeted.where("rest > 0").select("key", "passes", "rest", "blocks")), "key").withColumn("block", F.pmod(_number(F.col("id")), F.col("blocks")))
    blocks = dealt.groupBy("key", "block").agg(F.sum("tokens").alias("tokens"), F.max("passes").alias("passes"), F.max("rest").alias("rest"))
    # a source has at most BLOCKS blocks, so this window is bounded
    ordered = Window.partitionBy("key").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, 0)
    ranked = blocks.withColumn("place", block_place(F.col("key"), F.col("block"), F.col("passes"))).withColumn("upto", F.sum("tokens").over(ordered))
    last = staged(ranked.where("upto > rest and upto - tokens <= rest").select("key", "block", "place", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room")), "last")
    inside = dealt.join(_bounded(last.withColumnRenamed("block", "last_block")), "key").where("block = last_block")
    steps = Window.partitionBy("key").orderBy("spot", "id").rowsBetween(Window.unboundedPreceding, 0)
    stops = (
        inside.withColumn("spot", document_place(F.col("id"), F.col("passes")))
        .withColumn("upto", F.sum("tokens").over(steps))
        .where("upto > room")
        .groupBy("key")
        .agg(F.min("spot").alias("last_spot"))
    )
    return staged(
        budgeted.join(last.select("key", F.col("block").alias("last_block"), F.col("place").alias("last_place")), "key", "left").join(stops, "key", "left"),
        "plan",
    )


def block_place(key: Column, block: Column, number: Column) -> Column:
    """A block's place in the permutation of pass ``number`` over its source."""
    return _number(F.lit("block"), key, block.cast("string"), number.cast("string"))


def document_place(identity: Column, number: Column) -> Column:
    return _number(F.lit("document"), identity, number.cast("string"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else df


def mix(docs: DataFrame, plan: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """``docs`` with weight (of the source), copies and block added (or replaced).

    copies: how often the row is in the mixture.  Null sources are one source; null ids count as the
    empty id.  Rows of one id and source share their block and copies.  Empty tables give no rows.
    """
    own = docs.withColumn("_gm_key", _source(F.col(source_column))).withColumn("_gm_id", F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    terms = plan.select(F.col("key").alias("_gm_key"), F.col("weight").alias("_gm_weight"), F.col("passes").alias("_gm_passes"), F.col("blocks").alias("_gm_blocks"), F.col("last_block").alias("_gm_last_block"), F.col("last_place").alias("_gm_last_place"), F.col("last_spot").alias("_gm_last_spot"))
    block = F.pmod(_number(F.col("_gm_id")), F.col("_gm_blocks"))
    place = block_place(F.col("_gm_key"), F.col("_gm_block"), F.col("_gm_passes"))
    earlier = (place < F.col("_gm_last_place")) | ((place == F.col("_gm_last_place")) & (F.col("_gm_block") < F.col("_gm_last_block")))
    within = (F.col("_gm_block") == F.col("_gm_last_block")) & (document_place(F.col("_gm_id"), F.col("_gm_passes")) < F.col("_gm_last_spot"))
    extra = F.when(F.col("_gm_last_place").isNotNull() & (earlier | within), 1).otherwise(0)
    return (
        own.join(_bounded(terms), "_gm_key", "left")
        .withColumn("_gm_block", block)
        .withColumn("weight", F.col("_gm_weight"))
        .withColumn("copies", (F.col("_gm_passes") + extra).cast("long"))
        .withColumn("block", F.col("_gm_block"))
        .drop(*[c for c in ("_gm_key", "_gm_id", "_gm_weight", "_gm_passes", "_gm_blocks", "_gm_last_block", "_gm_last_place", "_gm_last_spot", "_gm_block")])
    )


def realised(docs: DataFrame, plan: DataFrame, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """``docs`` repeated as the plan says, columns unchanged, with mix_order added.

    Ordering by mix_order interleaves the sources: each pass over a source is a permutation of its
    blocks, and passes follow each other evenly over [0, 1).
    """
    mixed = mix(docs.drop("mix_order"), plan, id_column, source_column)
    each = mixed.where("copies > 0").withColumn("_gm_pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    place = block_place(_source(F.col(source_column)), F.col("block"), F.col("_gm_pass") - 1)
    order = (F.col("_gm_pass") - 1 + place / F.lit(float(1 << 60))) / F.col("copies")
    return each.withColumn("mix_order", order).select(*[c for c in docs.columns if c != "mix_order"], "mix_order")
