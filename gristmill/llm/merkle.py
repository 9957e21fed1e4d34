"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

Leaves are short clauses: a leaf ends after punctuation, after a word with one of a few last
letters, at a newline, or after so many characters without any.  Paragraphs end at newlines;
sections end at blank lines or where a paragraph's own digest says so.  Every boundary depends on
the text around it alone, hence an edit moves none far from it.  A node's digest covers its
children's digests in order, and leaves cover every character, so equal roots mean equal texts.

The printed fingerprint is the tree: the root, then each section's digest, its paragraphs' digests
and their leaves' short digests with weights.  Two fingerprints are compared from the root down:
equal nodes are passed over, unequal ones are entered, and the leaves that differ locate the edits.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, short_batches

#: A leaf ends after so many characters when nothing else ends it.
LEAF_CHARS = 48
_LEAF = re.compile(r"[^\n]{0,%d}?(?:[.,;:!?。，；：！？、]+[^\S\n]*\n?|[dnst](?=\s)[^\S\n]*\n?|\n|\Z)|[^\n]{1,%d}" % (LEAF_CHARS, LEAF_CHARS))
_WEIGHTS = "0123456789abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digests of sections and paragraphs, and of leaves.
NODE, LEAF = 16, 6


class Paragraph(NamedTuple):
    digest: str
    #: (digest, weight)
    leaves: list[tuple[str, int]]


class Section(NamedTuple):
    digest: str
    paragraphs: list[Paragraph]


class Tree(NamedTuple):
    root: str
    sections: list[Section]


class Edit(NamedTuple):
    """Leaves ``first`` to before ``last`` of a paragraph that have no equal in the other tree."""

    section: int
    paragraph: int
    first: int
    last: int


def leaves(text: str) -> list[str]:
    return [x for x in _LEAF.findall(text) if x]


def tree(text: str | None, known: dict[str, tuple[bytes, tuple[str, int]]] | None = None) -> Tree:
    """The tree of one text; null counts as empty, which has no sections.

    ``known`` carries leaves over to a text that is likely to have them again.
    """
    if known is None:
        known = {}
    sections: list[Section] = []
    section: list[Paragraph] = []
    paragraph: list[tuple[str, int]] = []
    top, middle, bottom = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
    digest = xxhash.xxh3_128_digest

    def end_section() -> None:
        nonlocal section, middle
        if section:
            d = middle.digest()
            top.update(d)
            sections.append(Section(d.hex()[:NODE], section))
            section, middle = [], hashlib.sha256()

    def end_paragraph(blank: bool) -> None:
        nonlocal paragraph, bottom
        if paragraph:
            d = bottom.digest()
            middle.update(d)
            section.append(Paragraph(d.hex()[:NODE], paragraph))
            paragraph, bottom = [], hashlib.sha256()
            if blank or d[0] % 8 == 0:
                end_section()

    for leaf in leaves(text or ""):
        found = known.get(leaf)
        if found is None:
            d = digest(leaf.encode("utf-8", "surrogatepass"))
            found = known[leaf] = (d, (d[: LEAF // 2].hex(), min(35, 1 + len(leaf) // 4)))
        bottom.update(found[0])
        paragraph.append(found[1])
        if leaf[-1] == "\n":
            end_paragraph(leaf.isspace())
    end_paragraph(False)
    end_section()
    return Tree(top.hexdigest()[:32], sections)


def render(t: Tree) -> str:
    """root, then ``|`` and each section's digest, then ``/`` and each paragraph's, with its leaves and weights."""
    return t.root + "".join("|" + s.digest + "".join("/" + p.digest + "".join([d + _WEIGHTS[w] for d, w in p.leaves]) for p in s.paragraphs) for s in t.sections)


def parse(text: str) -> Tree:
    root, *sections = text.split("|")
    out = []
    for s in sections:
        digest, *paragraphs = s.split("/")
        out.append(Section(digest, [Paragraph(p[:NODE], [(p[i : i + LEAF], _WEIGHTS.index(p[i + LEAF])) for i in range(NODE, len(p), LEAF + 1)]) for p in paragraphs]))
    return Tree(root, out)


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """Nodes of ``a`` and of ``b`` that are left when equal digests are paired off."""
    left, right = Counter(x.digest for x in a), Counter(x.digest for x in b)
    both = left & right
    out = []
    for nodes in (a, b):
        spare = Counter(both)
        rest = []
        for x in nodes:
            if spare[x.digest] > 0:
                spare[x.digest] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def _weight(nodes: list[Paragraph]) -> int:
    return sum(w for p in nodes for _, w in p.leaves)


def likeness(a: Tree, b: Tree) -> float:
    """Share of leaf weight in common, of the heavier tree; 1 for equal roots.

    From the root down: equal sections and then equal paragraphs count in full, and only the leaves
    of what is left are compared.
    """
    if a.root == b.root:
        return 1.0
    whole = [sum(_weight(s.paragraphs) for s in t.sections) for t in (a, b)]
    if not max(whole):
        return 1.0
    sections = _unmatched(a.sections, b.sections)
    rest = _unmatched(*([p for s in part for p in s.paragraphs] for part in sections))
    shared = whole[0] - _weight(rest[0])
    own, other = (Counter(x for p in part for x in p.leaves) for part in rest)
    if len(own) > len(other):
        own, other = other, own
    return (shared + sum(min(n, other[x]) * x[1] for x, n in own.items() if x in other)) / max(whole)


def differing(a: Tree, b: Tree) -> list[Edit]:
    """Where ``a`` has what ``b`` hasn't, in order: equal branches are never entered."""
    if a.root == b.root:
        return []
    sections = _unmatched(a.sections, b.sections)
    mine, theirs = ([p for s in part for p in s.paragraphs] for part in sections)
    rest = _unmatched(mine, theirs)
    entered, spare = {id(p) for p in rest[0]}, Counter(x for p in rest[1] for x in p.leaves)
    out: list[Edit] = []
    for i, s in enumerate(a.sections):
        for j, p in enumerate(s.paragraphs):
            if id(p) not in entered:
                continue
            fresh = []
            for x in p.leaves:
                fresh.append(spare[x] <= 0)
                spare[x] -= 1
            if not any(fresh):  # the same leaves in another order, or cut otherwise
                out.append(Edit(i, j, 0, len(fresh)))
            at = 0
            while at < len(fresh):
                if fresh[at]:
                    end = at
                    while end < len(fresh) and fresh[end]:
                        end += 1
                    out.append(Edit(i, j, at, end))
                    at = end
                at += 1
    return out


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every row; null texts count as empty.  Narrow: no shuffle."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([render(tree(t)) for t in texts], pa.string())],
                names=[id_column, "n_chars", "fingerprint"],
            )

    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])
    return docs.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, schema)


def _bucket(value: Column, splits: list[int], width: int = 256) -> Column:
    """How many of the sorted ``splits`` are at most ``value``: a coarse look, then one among ``width``."""
    if not splits:
        return F.lit(0)
    parts = [splits[i : i + width] for i in range(0, len(splits), width)]
    coarse = F.array(*[F.lit(p[0]) for p in parts])
    fine = F.array(*[F.array(*[F.lit(x) for x in p]) for p in parts])
    at = F.size(F.filter(coarse, lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(at, F.lit(1))), lambda x: x <= value))
    return F.when(at == 0, 0).otherwise((at - 1) * width + inside)


def edit_probe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Compare every document with an edited copy of itself and with the next document.

    Documents are in descending order of their long id; after the last comes the first.  Rows of
    one id follow each other by text; null ids come last.  The edited text is the text with its
    last floor(n/3) code points replaced by as many of the next text's first ones (or all of it).

    The order is made without one global task: ids are dealt into ranges by quantiles, each range is
    sorted by itself, and a copy of the row that begins the following range (one row a range) closes
    it.  Whole texts are exchanged once.  A single row is its own next.  Null texts count as empty;
    repeated rows are neighbours; a long text is one tree.  An empty table gives no rows.  Columns
    other than id and text are not read.  n_edits and first_edit (section.paragraph.leaf, from 0)
    tell where the text has what its edited copy hasn't.
    """
    spark = docs.sparkSession
    short_batches(spark)
    key = F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("k"), F.col(id_column).isNull().alias("none"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.agg(F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]), 100 * n)).first()[0] if n > 1 else []
    splits = sorted(set(cuts or []))
    dealt = rows.withColumn("b", F.lit(len(splits)) - _bucket(F.col("k"), splits))  # range 0 has the largest ids
    heads = {r["b"]: r["k"] for r in dealt.groupBy("b").agg(F.max("k").alias("k")).collect()}  # one row a range
    order = sorted(heads)
    before = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    first = [F.when(F.col("k") == k, F.lit(b)) for k, b in before.items()]
    closing = (
        rows.where(F.col("k").isin(list(before)))
        .groupBy("k", "none")
        .agg(F.min("text").alias("text"))
        .withColumn("b", F.coalesce(*first) if first else F.lit(0))
        .withColumn("late", F.lit(True))
    )
    tagged = dealt.withColumn("late", F.lit(False)).unionByName(closing)
    width = max(1, len(splits) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, bool, str, Tree, dict] | None = None
        for batch in batches:
            out: list[tuple] = []
            for k, none, text, late in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = tree(text, known := {})
                if held is not None:
                    out.append(_compared(*held, text, own))
                held = None if late else (k, none, text, own, known)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return (
        tagged.repartitionById(width, F.col("b"))
        .sortWithinPartitions("late", F.desc("k"), "none", "text")
        .select("k", "none", "text", "late")
        .mapInArrow(run, f"`{_NAMES[0]}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_edits long, first_edit string")
        .withColumnRenamed(_NAMES[0], id_column)
    )


_NAMES = ["_gm_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_edits", "first_edit"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.string()]


def _compared(k: int, none: bool, text: str, own: Tree, known: dict, following: str, other: Tree) -> tuple:
    moved = len(text) // 3
    edited = text[: len(text) - moved] + following[:moved]
    changed = tree(edited, known)
    edits = differing(own, changed)
    return (
        None if none else k,
        len(text),
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        render(own),
        render(changed),
        likeness(own, changed),
        likeness(own, other),
        len(edits),
        f"{edits[0].section}.{edits[0].paragraph}.{edits[0].first}" if edits else None,
    )
