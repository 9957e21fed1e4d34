"""Shards of near-equal bytes by histogram sort.  DataFrame functions only.

Rows are ordered by a 64-bit key: 32 bits of the text's hash, then 32 bits of the id's hash, so
equal texts lie together and a large group of them can still be split anywhere.  Counting starts
with exact bytes and rows by the key's leading bits.  The cells in which a wanted boundary falls,
and cells with too many rows, are counted again by their next bits, until every boundary is within
tolerance.  Then cells have known shards and known first slots, and rows are exchanged once, by cell.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS = 24
#: Boundaries end within this share of a shard's bytes, or at the cell of a single key.
TOLERANCE = 0.001
#: Bits that a round of counting adds; rows of the driver's tables are bounded by 2**BITS a refined cell.
BITS = 10
#: Cells with more than this share of the rows, and four times an even cell's, are refined: fewer than 1/HEAVY.
HEAVY = 1 / 256


@dataclass(frozen=True)
class Cell:
    low: int
    bits: int  # how many leading bits it fixes
    bytes: int
    rows: int


def key(id_column: Column, text: Column) -> Column:
    upper = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 32), 32)
    return upper.bitwiseOR(F.shiftrightunsigned(F.xxhash64(id_column), 32))


def _counted(keys: DataFrame, bits: int) -> list[Cell]:
    low = F.shiftleft(F.shiftright("key", 64 - bits), 64 - bits).alias("low")
    rows = keys.groupBy(low).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).collect()
    return [Cell(r["low"], bits, r["bytes"], r["rows"]) for r in rows]


def split(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, bits: int = BITS, cell_bytes: int = 64 << 20) -> tuple[list[Cell], list[int]]:
    """Cells in key order and the shard of each; ``keys`` has key and size."""
    total = keys.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    size, rows = total["bytes"] or 0, total["rows"]
    if not rows:
        return [], []
    first = min(16, max(8, (size // cell_bytes).bit_length()))
    cells = sorted(_counted(keys, first), key=lambda c: c.low)
    allowed = max(1.0, tolerance * size / shards)
    while True:
        refine: dict[int, Cell] = {}
        before = 0
        for c in cells:
            # a wanted boundary inside, farther than allowed from both edges
            inside = [j * size / shards for j in range(before * shards // size + 1, (before + c.bytes) * shards // size + 1)]
            if c.bits < 64 and c.rows > 1 and (c.rows > max(64, HEAVY * rows, 4 * rows / 2**first) or any(min(t - before, before + c.bytes - t) > allowed for t in inside)):
                refine[c.low] = c
            before += c.bytes
        if not refine:
            break
        parts = []
        for depth in sorted({c.bits for c in refine.values()}):
            lows = [c.low for c in refine.values() if c.bits == depth]
            mine = keys.where(F.shiftleft(F.shiftright("key", 64 - depth), 64 - depth).isin(lows))
            parts += _counted(mine, min(64, depth + bits))
        cells = sorted([c for c in cells if c.low not in refine or refine[c.low] != c] + parts, key=lambda c: c.low)
    # each boundary at the nearer edge of the cell it falls in
    edges, before = [0], 0
    for c in cells:
        before += c.bytes
        edges.append(before)
    starts = []
    for j in range(1, shards):
        wanted = j * size / shards
        at = bisect_right(edges, wanted) - 1
        starts.append(at if at + 1 >= len(edges) or wanted - edges[at] <= edges[at + 1] - wanted else at + 1)
    return cells, [bisect_right(starts, i) for i in range(len(cells))]


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with the columns size, law, shard, slot and grown_shard added (or replaced).

    size: UTF-8 bytes of the text (null: none) plus 8.  law is ``bytes``: the shards' sizes are near
    equal.  Slots count from 0 without gaps in each shard; equal texts get neighbouring slots, or
    neighbouring shards where a boundary falls into their group.  Null ids and texts hash like
    values.  Rows repeated with id and text share a key and so a shard.  An empty table gives no
    rows.  grown_shard is null: this law moves boundaries when a shard is added.
    """
    spark = docs.sparkSession
    text = F.col(text_column)
    marked = docs.withColumn("_gm_key", key(F.col(id_column), text)).withColumn("size", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"))
    keys = staged(marked.select(F.col("_gm_key").alias("key"), "size"), "keys")
    cells, owners = split(keys, shards, tolerance)
    # by leading bits, the cells there: low keys ascending with shard and first slot
    head = min((c.bits for c in cells), default=8)
    slots = [0] * shards
    rows = []
    for c, s in zip(cells, owners, strict=True):
        rows.append((c.low >> (64 - head), c.low, s, slots[s]))
        slots[s] += c.rows
    table = (
        spark.createDataFrame(rows, "_gm_head long, low long, shard int, slot long")
        .groupBy("_gm_head")
        .agg(F.array_sort(F.collect_list(F.struct("low", "shard", "slot"))).alias("_gm_cells"))
    )
    # bounded: 2**head cells and 2**BITS more for each of the few refined ones
    placed = marked.withColumn("_gm_head", F.shiftright("_gm_key", 64 - head)).join(F.broadcast(table), "_gm_head", "left")
    placed = placed.withColumn("_gm_cell", F.element_at(F.filter("_gm_cells", lambda c: c["low"] <= F.col("_gm_key")), -1)).drop("_gm_cells", "_gm_head")
    order = Window.partitionBy("_gm_cell").orderBy("_gm_key", F.col(id_column), "size")
    return (
        placed.withColumn("slot", (F.row_number().over(order) - 1 + F.col("_gm_cell")["slot"]).cast("long"))
        .withColumn("shard", F.col("_gm_cell")["shard"])
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .drop("_gm_key", "_gm_cell")
    )
