"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Texts are normalised by byte tables: ASCII letters fall to lower case, every other ASCII character
but digits separates words, bytes from 0x80 up belong to words.  An item is cut into consecutive
blocks of words; every window of 2 * block - 1 words holds one of them in full, so the automaton's
keys are the blocks (and whole items that are shorter than a window), with a blank on both sides.
It reads each normalised text once.  A block that occurs is extended word by word along its item;
runs of at least a window are hits, mapped back to word numbers and to code points of the original.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, short_batches, staged

WINDOW = 13
#: Text of the benchmark that one automaton may hold (some 30 bytes each); a larger one is scanned in blocks.
BLOCK_BYTES = 2 << 20
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

Items = tuple[tuple[str, str | None], ...]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Machine(NamedTuple):
    """``owners``: by key number the (item number, first word) that have it."""

    automaton: ahocorasick.Automaton | None
    owners: list[list[tuple[int, int]]]
    names: list[str]
    texts: list[list[bytes]]


@lru_cache(maxsize=1)
def machine(items: Items, width: int = WINDOW) -> Machine:
    """The automaton of (item id, text) pairs; items without words have no window."""
    block = (width + 1) // 2
    owners: dict[str, list[tuple[int, int]]] = {}
    names, texts = [], []
    for item, text in items:
        found = words(text)
        if not found:
            continue
        names.append(item)
        texts.append(found)
        for at in range(0, len(found) - block + 1, block) if len(found) >= width else [0]:
            part = found[at : at + block] if len(found) >= width else found
            owners.setdefault(f" {b' '.join(part).decode('latin-1')} ", []).append((len(names) - 1, at))
    if not owners:
        return Machine(None, [], [], [])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for number, key in enumerate(owners):
        automaton.add_word(key, (number, key.count(" ") - 1))
    automaton.make_automaton()
    return Machine(automaton, list(owners.values()), names, texts)


def scan(text: str | None, items: Machine, width: int = WINDOW) -> tuple[int, list[tuple[int, int, str]]]:
    """Number of words and the runs as (first word, word after the last, item id)."""
    found = words(text)
    if not found or items.automaton is None:
        return len(found), []
    joined = b" " + b" ".join(found) + b" "
    seeds = [(end, *value) for end, value in items.automaton.iter(joined.decode("latin-1"))]
    if not seeds:
        return len(found), []
    blanks = np.nonzero(np.frombuffer(joined, np.uint8) == 0x20)[0]
    runs: list[tuple[int, int, str]] = []
    reached: dict[tuple[int, int], int] = {}  # by item and offset against it: where the last run ended
    for after, (_, number, size) in zip(np.searchsorted(blanks, [s[0] for s in seeds]).tolist(), seeds, strict=True):
        first = after - size
        for item, at in items.owners[number]:
            if reached.get((item, first - at), 0) > first:
                continue
            own = items.texts[item]
            a, b, i, j = first, after, at, at + size
            while a > 0 and i > 0 and found[a - 1] == own[i - 1]:
                a, i = a - 1, i - 1
            while b < len(found) and j < len(own) and found[b] == own[j]:
                b, j = b + 1, j + 1
            reached[item, first - at] = b
            if b - a >= min(width, len(own)):
                runs.append((a, b, items.names[item]))
    return len(found), runs


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of the original text for spans of word numbers."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.frombuffer(data.tobytes().translate(_TABLE), np.uint8) != 0x20
    edges = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(points[starts[a]]), int(points[ends[b - 1]])) for a, b in spans]


def _blocks(benchmark: DataFrame, item_column: str, text_column: str, block_bytes: int) -> Iterator[Items]:
    """The benchmark block by block; the driver holds a partition of it and a block."""
    block: list[tuple[str, str | None]] = []
    size = 0
    rows = benchmark.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("string"), F.col(text_column).cast("string"))
    for item, text in rows.toLocalIterator():
        held = len((text or "").encode("utf-8", "surrogatepass"))
        if block and size + held > block_bytes:
            yield tuple(block)
            block, size = [], 0
        block.append((item, text))
        size += held
    yield tuple(block)


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_SPAN_PA = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = [T.StructField("n_words", T.LongType()), T.StructField("hit", _SPAN), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", _SPAN)]


def _span_array(rows: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], _SPAN_PA)


def _scanned(rows: DataFrame, block: Items, width: int, every: bool) -> DataFrame:
    """``rows`` has key and text: key with what one block finds, of every row or of those with hits."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = machine(shared.value, width)
        for batch in batches:
            kept, counts, hits, names, where = [], [], [], [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                n, runs = scan(text, items, width)
                if not (runs or every):
                    continue
                hit = merged([r[:2] for r in runs])
                kept.append(at)
                counts.append(n)
                hits.append(hit)
                names.append(sorted({r[2] for r in runs}))
                where.append(original_spans(text, hit) if hit else [])
            columns = [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(counts, pa.int64()), _span_array(hits), pa.array(names, pa.list_(pa.string())), _span_array(where)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", *(f.name for f in _FOUND)])

    return rows.mapInArrow(run, T.StructType([T.StructField("key", rows.schema["key"].dataType), *_FOUND]))


def _combined(found: DataFrame) -> DataFrame:
    """One row a key of what several blocks have found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, where = ([merged([(s["start"], s["end"]) for s in r]) for r in batch.column(i).to_pylist()] for i in (2, 4))
            names = [sorted(set(r)) for r in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _span_array(hits), pa.array(names, pa.list_(pa.string())), _span_array(where)], names=batch.schema.names)

    together = found.groupBy("key").agg(F.max("n_words").alias("n_words"), *[F.flatten(F.collect_list(c)).alias(c) for c in ("hit", "items", "spans")])
    return together.mapInArrow(run, found.schema)


def _hit_words() -> Column:
    return F.coalesce(F.aggregate("hit", F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long")), F.lit(0).cast("long"))


def _by_block(rows: DataFrame, blocks: Iterator[Items], width: int, every: bool) -> tuple[DataFrame, DataFrame | None]:
    """What all blocks find by key, and with more than one block the written rows, whose key is new.

    ``rows`` has key and text.  One block is one narrow scan.  With more, the rows are written once,
    then known by file and row number, and each block is a scan over them that writes its hits.
    """
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return _scanned(rows, first, width, every), None
    written = staged(rows, "decontaminate")
    placed = written.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("key"), F.col("key").alias("own"), "text")
    parts = [staged(_scanned(placed.select("key", "text"), block, width, every and n == 0), "hits") for n, block in enumerate(chain([first, second], blocks))]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return _combined(found), placed


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted as strings), spans, contaminated.

    spans are merged code point ranges of the original text.  Null and empty texts have no words and
    are clean; long texts are read once as a whole; repeated rows come out alike, each by itself;
    null ids are kept; an empty table of documents gives no rows, an empty benchmark no hits.
    Columns other than id and text are not read.  Items without words have no windows; items without
    an id are left out; items of one id count once.  Any text with n_hit > 0 and
    20 * n_hit >= n_words is contaminated.  The benchmark reaches driver and executors in blocks of at
    most ``block_bytes`` of text (one longer item is a block); results do not depend on them.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    found, placed = _by_block(rows, _blocks(benchmark, item_column, item_text_column, block_bytes), width, every=True)
    if placed is not None:
        found = found.join(placed.select("key", "own"), "key").drop("key").withColumnRenamed("own", "key")
    return found.withColumn("n_hit", _hit_words()).select(
        F.col("key").alias(id_column), "n_words", "n_hit", "items", "spans", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def is_leaked(n_words: int, n_hit: int, width: int = WINDOW) -> bool:
    """Whether training data should go without it: a whole window of hit words, or a twentieth of all."""
    return n_hit >= width or (n_hit > 0 and 20 * n_hit >= n_words)


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, columns unchanged.

    A row goes when ``width`` of its words or a twentieth of them are hit: a leak inside a long
    document is a leak.  A hit of less, from an item shorter than a window, may be chance and stays.
    Each row is decided by itself, whatever its id and however many blocks the benchmark has; null
    and empty texts stay, repeated rows go or stay together, an empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_column, item_text_column, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)
        at = docs.columns.index(text_column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = machine(shared.value, width)
            for batch in batches:
                kept = []
                for text in batch.column(at).to_pylist():
                    n, runs = scan(text, items, width)
                    kept.append(not is_leaked(n, sum(b - a for a, b in merged([r[:2] for r in runs])), width))
                yield batch.filter(pa.array(kept, pa.bool_()))

        return docs.mapInArrow(run, docs.schema)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("key"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found, placed = _by_block(rows, chain([first, second], blocks), width, every=False)
    leaked = found.withColumn("n_hit", _hit_words()).where((F.col("n_hit") >= width) | ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))
    return placed.join(bounded(staged(leaked.select("key"), "leaked")), "key", "left_anti").select("own.*")
