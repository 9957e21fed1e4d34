"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint is eight bytes at fixed positions.  Two fingerprints that differ in at most
three bits differ in at most three bytes, so they share at least five positional bytes: the
guaranteed minimum.  Of five shared positions three or more lie in one half of the fingerprint, so
the index posts each distinct fingerprint under every three positions of a half with the bytes there
(8 postings; single bytes would make postings of a 256th of the corpus, whose pairs grow with its
square).  Within a posting the shared positional bytes of each pair are tallied, pairs below the
minimum are dropped, and the rest are verified by their Hamming distance.

Postings over ``MATRIX`` members are split: their members are posted anew under every choice of the
whole minimum of positions, where 24 bits are free, so that a posting is bounded by 2**24 whatever
the corpus is; large ones are probed by flipped bits.  A posting emits a spanning forest of its
links, never all pairs; linked classes come from alternating large-star and small-star steps over
written tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, discard, partitions, short_batches, staged

SEED = 42
BITS = 3
#: Up to here the pairs of a posting are tallied in one matrix; beyond, the posting is split.
MATRIX = 1024
#: Up to so many edges (16 bytes each) one task joins components; beyond, star steps do.
JOINED_EDGES = 1 << 18
#: Words of a wide fingerprint, the similarity that it links at, and positions of its postings: three bytes
#: each, every byte in six of them.
WIDE, SIMILARITY = 4, 0.8
TRIPLES = [tuple((i + x) % (8 * WIDE) for x in step) for i in range(8 * WIDE) for step in ((0, 1, 3), (0, 5, 12))]
#: Members of a posting up to which postings are used.
BLOCK = 512
#: Members of a chunk at most, chunks of any but small tables, rows and columns of the tiles in which pairs are
#: compared, and links held until they are joined.
CHUNK, CHUNKS, TILE, JOINED_PAIRS = 1 << 18, 16, (32, 4096), 1 << 16
#: Standard deviations beyond the bits expected at a similarity up to which pairs are verified by their shingles, and
#: shingles of a family's chunk.
REACH, SHINGLES = 6, 1 << 22
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; of all words where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.empty_like(ends)
    starts[0] = 0
    starts[1:] = ends[:-1] + 1
    last = len(words) - width + 1
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:last].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, last)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """The bytes of the bits that are set in over half of the rows of ``hashes``, a table of uint64 words."""
    counts = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded scratch space for very long texts
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)]).view(np.uint8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The unsigned SimHash of one text; zero without words."""
    hashes = shingle_hashes(text, width, seed)
    return int(_majority(hashes[:, None]).view("<u8")[0]) if len(hashes) else 0


def wide_fingerprint(text: str | None, width: int = 5, seed: int = SEED) -> bytes:
    """A SimHash of ``WIDE`` words of 64 bits, mixed from each shingle's hash; zeros without words."""
    return _wide(shingle_hashes(text, width, seed))


def _wide(hashes: np.ndarray) -> bytes:
    if not len(hashes):
        return bytes(8 * WIDE)
    x = hashes[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return _majority(x ^ (x >> np.uint64(31))).tobytes()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed long; null and wordless texts get zero."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = pa.array(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, batch.num_rows).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["id", "fp"])

    kind = docs.schema[id_column].dataType
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    )


def set_fingerprints(docs: DataFrame, id_column: str, text_column: str, width: int = 5) -> DataFrame:
    """(id, fp, size): by the whole text's set of shingles, its wide SimHash with eight bytes more that tell sets apart, and its size."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            found = pa.array([_wide(x) + (x * x | np.uint64(1)).sum(dtype=np.uint64).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array([len(x) for x in sets], pa.int64())], names=["id", "fp", "size"])

    kind = docs.schema[id_column].dataType
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).mapInArrow(
        run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.BinaryType()), T.StructField("size", T.LongType())])
    )


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, width))


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two shingle sets is ``similarity`` or more."""
    if min(len(a), len(b)) + 1e-9 < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that join what ``pairs`` join, fewer than ``n``."""
    parent, out = list(range(n)), []
    label = np.arange(n)
    for left, right in pairs:
        fresh = label[left] != label[right]
        if not fresh.any():
            continue
        for i, j in zip(left[fresh].tolist(), right[fresh].tolist(), strict=True):
            a, b = _root(parent, i), _root(parent, j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        label = np.fromiter((_root(parent, i) for i in range(n)), np.int64, n)
    return out


def posting_links(values: np.ndarray, free: list[int], bits: int = BITS, matrix: int = MATRIX) -> list[tuple[int, int]]:
    """A spanning forest of the links among the distinct uint64 ``values`` of one posting.

    ``free``: the bit numbers in which members of the posting can differ.
    """
    if len(values) == 2:  # most postings with company
        other = int(values[0]) ^ int(values[1])
        shared = sum(not other >> (8 * p) & 0xFF for p in range(8))
        return [(0, 1)] if shared >= 8 - bits and other.bit_count() <= bits else []

    def compared() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        other = values[:, None] ^ values[None, :]
        tally = (other.view(np.uint8).reshape(len(values), len(values), 8) == 0).sum(axis=2)
        i, j = np.nonzero(np.triu(tally >= 8 - bits, 1))
        close = np.bitwise_count(other[i, j]) <= bits
        yield i[close], j[close]

    def probed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(values)
        ranked = values[order]
        for k in range(1, bits + 1):
            for flips in combinations(free, k):
                sought = values ^ np.uint64(sum(1 << b for b in flips))
                at = np.minimum(np.searchsorted(ranked, sought), len(ranked) - 1)
                hit = np.nonzero((ranked[at] == sought) & (values < sought))[0]
                if len(hit):
                    yield hit, order[at[hit]]

    return _forest(len(values), compared() if len(values) <= matrix else probed())


def positions(bits: int = BITS) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """The position sets of postings, and those of split ones.

    Pairs share 8 - ``bits`` positions, and so the larger half of them in one half of the fingerprint.
    """
    least = 8 - bits
    halves = [s for half in (range(4), range(4, 8)) for s in combinations(half, -(-least // 2))]
    return halves, list(combinations(range(8), least))


def _mask(kept: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in kept)
    return mask - (1 << 64) if mask >> 63 else mask


def _posted(distinct: DataFrame, sets: list[tuple[int, ...]], first: int = 0, within: str | None = None) -> DataFrame:
    """(p, bytes, fp): ``distinct`` under each of ``sets``; with ``within``, a bit mask of the sets wanted."""
    each = [F.struct(F.lit(first + i).cast("byte").alias("p"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("bytes")) for i, s in enumerate(sets)]
    if within:
        each = [F.when(F.col(within).bitwiseAND(F.lit(1 << i)) != 0, x) for i, x in enumerate(each)]
    return distinct.select("fp", F.explode(F.array_compact(F.array(*each))).alias("k")).select(F.col("k.p").alias("p"), F.col("k.bytes").alias("bytes"), "fp")


def links(distinct: DataFrame, bits: int = BITS, most: int = MATRIX) -> DataFrame:
    """(u, v), u > v: links among the distinct fingerprints in column ``fp``, a spanning forest by posting.

    ``distinct`` is read more than once, so it should be a written table.
    """
    halves, whole = positions(bits)
    frees = [[8 * p + b for p in range(8) if p not in s for b in range(8)] for s in halves + whole]
    posted = _posted(distinct, halves)
    hot = staged(posted.groupBy("p", "bytes").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("p", "bytes"), "hot", files=16)
    if hot.limit(1).count():
        # a member of several long postings is posted once under each set that completes one of them
        completing = [sum(1 << i for i, w in enumerate(whole) if set(h) <= set(w)) for h in halves]
        wanted = F.element_at(F.array(*[F.lit(m) for m in completing]), F.col("p").cast("int") + 1)
        known = bounded(hot)
        members = posted.join(known, ["p", "bytes"], "left_semi").groupBy("fp").agg(F.bit_or(wanted).alias("sets"))
        posted = posted.join(known, ["p", "bytes"], "left_anti").unionByName(_posted(members, whole, len(halves), "sets"))

    def emit(position: int, values: np.ndarray) -> Iterator[tuple[int, int]]:
        signed = values.view(np.int64)
        for i, j in posting_links(values, frees[position], bits, most):
            a, b = int(signed[i]), int(signed[j])
            yield max(a, b), min(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["u", "v"]
        open_key: tuple[int, int] | None = None
        open_values: list[np.ndarray] = []

        def closed() -> list[tuple[int, int]]:
            values = np.concatenate(open_values) if open_values else np.empty(0, np.uint64)
            return list(emit(open_key[0], values)) if len(values) > 1 else []

        for batch in batches:
            if not batch.num_rows:
                continue
            p, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            fp = np.ascontiguousarray(fp).view(np.uint64)
            cut = np.concatenate([[0], np.nonzero((p[1:] != p[:-1]) | (key[1:] != key[:-1]))[0] + 1, [len(p)]])
            found: list[tuple[int, int]] = []
            sizes = np.diff(cut)
            first = (int(p[0]), int(key[0]))
            at = 0
            if open_key is not None:
                if first == open_key:
                    open_values.append(fp[: cut[1]].copy())
                    at = 1
                if at < len(sizes):
                    found += closed()
                    open_key, open_values = None, []
            if at < len(sizes):
                inner = np.nonzero(sizes[at:-1] > 1)[0] + at
                for r in inner.tolist():
                    found += emit(int(p[cut[r]]), fp[cut[r] : cut[r + 1]])
                open_key, open_values = (int(p[cut[-2]]), int(key[cut[-2]])), [fp[cut[-2] :].copy()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=names)
        if open_key is not None and (found := closed()):
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=names)

    return posted.repartition("p", "bytes").sortWithinPartitions("p", "bytes").mapInArrow(run, "u long, v long").distinct()


def radius(similarity: float = SIMILARITY, bits: int = 64 * WIDE, deviations: float = 1) -> int:
    """Differing bits that texts of this Jaccard similarity have, and ``deviations`` standard deviations of the estimate more.

    Of two sets alike in size, similarity s is the cosine 2 s / (1 + s), of others it is less, and a bit
    differs with the angle's share of pi.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def wide_forest(points: np.ndarray, left: int, most: int, check: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links at up to ``most`` bits, that ``check`` confirms, among wide fingerprints, rows of ``points``.

    The first ``left`` are compared with all the others or, if there are no others, with each other.
    Some of the words settle most pairs, as pairs in reach differ in no more bits there; the rest are
    verified in full, unless they are joined already.
    """
    n, inner = len(points), left == len(points)
    first = next((k for k in range(1, WIDE) if 32 * k - 12 * math.sqrt(k) >= most), WIDE)  # unlike texts differ in half of the bits
    words = np.ascontiguousarray(points.T)
    shape = min(TILE[0], left), min(TILE[1], n)
    other, counts, apart = np.empty(shape, np.uint64), np.empty(shape, np.uint8), np.empty(shape, np.uint8)
    parent, label, out = list(range(n)), np.arange(n), []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def join() -> np.ndarray:
        for i, j in zip(*(np.concatenate(x).tolist() for x in zip(*held, strict=True)), strict=True):
            a, b = _root(parent, i), _root(parent, j)
            if a != b and (check is None or check(i, j)):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
        held.clear()
        roots = np.array(parent)
        while not np.array_equal(roots, above := roots[roots]):
            roots = above
        return roots

    for a in range(0, left, shape[0]):
        for b in range(a if inner else left, n, shape[1]):
            high, broad = min(a + shape[0], left) - a, min(b + shape[1], n) - b
            o, c, d = other[:high, :broad], counts[:high, :broad], apart[:high, :broad]
            d[:] = 0
            for w in words[:first]:
                np.bitwise_xor(w[a : a + high, None], w[None, b : b + broad], out=o)
                np.add(d, np.bitwise_count(o, out=c), out=d)
            i, j = np.divmod(np.flatnonzero(d <= most), broad)
            i, j = i + a, j + b
            fresh = (i < j) & (label[i] != label[j])
            i, j = i[fresh], j[fresh]
            close = np.bitwise_count(points[i] ^ points[j]).sum(axis=1, dtype=np.int64) <= most
            if close.any():
                held.append((i[close], j[close]))
                if sum(len(x) for x, _ in held) > JOINED_PAIRS:
                    label = join()
    if held:
        join()
    return out


def _points(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p[: 8 * WIDE] for p in prints), np.uint64).reshape(-1, WIDE)


def _named(prints: list[bytes], left: int, most: int, check: Callable[[int, int], bool] | None = None) -> list[tuple[bytes, bytes]]:
    found = wide_forest(_points(prints), left, most, check)
    return [(max(prints[i], prints[j]), min(prints[i], prints[j])) for i, j in found]


def _posted_wide(distinct: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint under every triple of positions with the bytes there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                prints = batch.column(0).slice(at, 1 << 12).to_pylist()
                raw = _points(prints).view(np.uint8).astype(np.int64)
                keys = np.stack([(n << 24) | (raw[:, a] << 16) | (raw[:, b] << 8) | raw[:, c] for n, (a, b, c) in enumerate(TRIPLES)], axis=1)
                held = pa.array(prints, pa.binary()).take(pa.array(np.repeat(np.arange(len(prints)), len(TRIPLES))))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), held], names=["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp binary")


def _linked(posted: DataFrame, most: int) -> DataFrame:
    """(u, v): links by posting."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: int | None = None
        members: list[bytes] = []
        for batch in batches:
            keys, prints, out = batch.column(0).to_numpy(), batch.column(1), []
            cut = np.concatenate([[0], np.nonzero(np.diff(keys))[0] + 1, [len(keys)]]).tolist() if len(keys) else []
            for a, b in zip(cut, cut[1:]):
                if int(keys[a]) != key:
                    out += _named(members, len(members), most) if len(members) > 1 else []
                    key, members = int(keys[a]), []
                if b - a > 1 or b == len(keys) or members:  # others are alone in their posting
                    members += prints.slice(a, b - a).to_pylist()
            yield _edges(out)
        yield _edges(_named(members, len(members), most) if len(members) > 1 else [])

    return posted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u binary, v binary")


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in range(2)], names=["u", "v"])


def _paired(rows: DataFrame, keys: list[str], tasks: int, left_and_right: Callable[[pa.Table, int], list[tuple[bytes, bytes]]]) -> DataFrame:
    """(u, v): what ``left_and_right`` finds, given a group's rows, the first so many of which are compared with the others or,
    where there are no others, with each other.

    ``rows`` have their chunk in ``mine``, those that it meets from ``low`` to ``high``, itself included.
    """
    met = rows.withColumn("yours", F.explode(F.sequence("low", "high")))
    dealt = met.withColumn("one", F.least("mine", "yours")).withColumn("two", F.greatest("mine", "yours")).drop("yours", "low", "high")

    def compare(group: pa.Table) -> pa.Table:
        second = group.column("mine").to_numpy() != group.column("one")[0].as_py()
        group = group.take(pa.array(np.argsort(second, kind="stable")))
        left = len(second) - int(second.sum())
        alone = group.column("one")[0].as_py() == group.column("two")[0].as_py()
        # of two chunks one may be empty
        return pa.Table.from_batches([_edges(left_and_right(group, left) if alone or 0 < left < len(second) else [])])

    keys = [*keys, "one", "two"]
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInArrow(compare, "u binary, v binary").distinct()


def wide_links(distinct: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, chunk: int = CHUNK, deviations: float = 1) -> DataFrame:
    """(u, v), u > v: links among the distinct wide fingerprints in column ``fp``, spanning forests that lose none.

    A byte is in six of the 64 ``TRIPLES``, so up to ten differing bits leave a triple that both have, and
    postings under the triples are complete; they are used if none is over ``block`` members.  At wider
    radii, 45 bits at similarity 0.8, nothing is sure to be shared: a complete index would need some 2,000
    keys of 16 bits a fingerprint.  There all pairs are compared, chunk by chunk: every two of the chunks, which have
    up to about ``chunk`` members, meet in one group, and links go by the distance of whole fingerprints.

    With a column ``size``, of the shingle sets, chunks are of bands of sizes, and only sets that can be as
    similar as that by their sizes are sure to be compared: those of one band and of its neighbours.
    ``distinct`` is read more than once, so it should be a written table.
    """
    most = radius(similarity, deviations=deviations)
    if 6 * most < len(TRIPLES):
        posted = _posted_wide(distinct)
        if not posted.groupBy("key").count().where(F.col("count") > block).limit(1).count():
            return _linked(posted, most).distinct()
    band = F.lit(0)
    if "size" in distinct.columns and similarity < 1:
        band = F.floor(F.log(F.greatest("size", F.lit(1))) / (1e-9 - math.log(similarity))).cast("int")
    banded = distinct.select("fp", band.alias("band"))
    counts = {r["band"]: r["count"] for r in banded.groupBy("band").count().collect()}
    each = min(chunk, max(1024, sum(counts.values()) // CHUNKS))
    first, chunks = {}, 0
    for k in range(max(counts, default=0) + 3):  # the first chunk of each band; a band's last is before the next one's first
        first[k], chunks = chunks, chunks + -(-counts.get(k, 0) // each)
    starts = F.array(*[F.lit(first[k]) for k in sorted(first)])
    at = lambda step: F.get(starts, F.col("band") + step)
    mine = at(0) + F.pmod(F.xxhash64("fp"), at(1) - at(0)).cast("int")
    rows = banded.select("fp", mine.alias("mine"), F.coalesce(at(-1), F.lit(0)).alias("low"), (at(2) - 1).alias("high"))
    tasks = sum((first[k + 1] - first[k]) * (first[k + 2] - first[k]) for k in counts)
    return _paired(rows, [], max(1, tasks), lambda group, left: _named(group.column("fp").to_pylist(), left, most))


def similar_links(texts: DataFrame, similarity: float = SIMILARITY, width: int = 5, shingles: int = SHINGLES) -> DataFrame:
    """(u, v), u > v: links of sets at ``similarity`` or more within families, a spanning forest by group.

    ``texts``: family, fp, size and text, as of ``set_fingerprints``, a row a set.  A family of over ``shingles``
    shingles is dealt out over chunks, every two of which meet.  Fingerprints say which pairs are verified by their
    sets, and what is joined already is not.
    """
    most = radius(similarity, deviations=REACH)
    parts = texts.groupBy("family").agg(F.ceil((F.sum("size") + 1) / shingles).cast("int").alias("parts"))
    n = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), n).cast("int").alias("mine")
    rows = texts.join(bounded(parts.where("parts > 1")), "family", "left").select("family", "fp", "text", mine, F.lit(0).alias("low"), (n - 1).alias("high"))

    def verified(group: pa.Table, left: int) -> list[tuple[bytes, bytes]]:
        sets = [shingle_set(t, width) for t in group.column("text").to_pylist()]
        return _named(group.column("fp").to_pylist(), left, most, lambda i, j: alike(sets[i], sets[j], similarity))

    return _paired(rows, ["family"], partitions(texts.sparkSession), verified)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(2)], names=["node", "root"])


def components(edges: DataFrame, one_task: int = JOINED_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; the root is the least node.

    Nodes are of any ordered type.  Up to ``one_task`` edges, counted first, one task joins them.  Beyond, large-star and small-star
    steps work on grouped minima and equi-joins; a step's edges go to the shared folder, so a lost
    executor costs one step.  The result is the same.  Empty edges give an empty table.
    """
    current = staged(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        seen = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state is None and seen["n"] <= one_task:
            kind = current.schema["u"].dataType
            return current.coalesce(1).mapInArrow(_joined, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
        now = (seen["n"], seen["h"])
        if now == state:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following = staged(small.distinct(), "edges", files=seen["n"] // 50_000 + 1)
        discard(current)
        current = following


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links of at most three differing bits reach, itself
    included.  Null, empty and wordless texts have fingerprint zero and link like any other.
    Exact copies share a fingerprint and meet only in grouped minima.  Rows of one id are linked
    only through their fingerprints.  Null ids never name a component.  An empty table gives an
    empty result; other columns are not read.
    """
    every = staged(fingerprints(docs, id_column, text_column, width), "fingerprints")
    classes = staged(every.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    joined = components(links(classes.select("fp")))
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return every.join(named, "fp").select(
        F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``docs`` for each group of texts linked at ``similarity`` on shingles of ``width`` words, columns unchanged.

    Texts are linked if the Jaccard similarity of their sets of shingles is ``similarity`` or more.  Fingerprints
    of the sets within ``REACH`` standard deviations of it, among all pairs whose sizes allow it, make families; within a
    family texts are compared by their shingles.

    The row with the smallest id stays, then the one with the smallest hash of its text, then of all
    its columns; rows without an id come last.  Repeated ids with unlike texts are rows of their own;
    null, empty and wordless texts are one group; of rows repeated in full one stays.  An empty table
    gives no rows.  Columns may have any names.

    Rows are known by two 64-bit hashes, of the text and of the whole row.  What goes is broadcast up
    to a checked number of rows, and texts then stay where they are read; beyond it they are
    exchanged by these hashes.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # a hash passes over nulls, so where they are is hashed too
    whole = F.xxhash64(*[x for c in columns for x in (c, c.isNull())])
    key = ["_gm_text", "_gm_whole"]
    keyed = docs.withColumn("_gm_text", F.xxhash64(F.col(f"`{text_column}`").cast("string"))).withColumn("_gm_whole", whole)
    identity = F.col(f"`{id_column}`")
    row = F.struct(identity.isNull().alias("none"), identity.alias("id"), *key)
    prints = set_fingerprints(keyed.select(row.alias("row"), F.col(f"`{text_column}`").alias("text")), "row", "text", width)
    every = staged(prints.groupBy("fp", "size", "id").agg(F.count(F.lit(1)).alias("n")), "rows")
    classes = staged(every.groupBy("fp", "size").agg(F.min("id").alias("least")), "classes")
    near = staged(components(wide_links(classes.select("fp", "size"), similarity, deviations=REACH)), "families")
    families = near.select(F.col("node").alias("fp"), F.col("root").alias("family")).unionByName(near.select(F.col("root").alias("fp"), F.col("root").alias("family")).distinct())
    # a class is read by one of its texts
    wanted = staged(classes.join(families, "fp").select(F.col("least._gm_text").alias("_gm_text"), F.col("least._gm_whole").alias("_gm_whole"), "family", "fp", "size"), "wanted")
    texts = keyed.join(bounded(wanted.select(*key)), key, "left_semi").select(*key, F.col(f"`{text_column}`").cast("string").alias("text")).dropDuplicates(key)
    texts = staged(wanted.join(texts, key).select("family", "fp", "size", "text"), "texts")
    joined = components(similar_links(texts, similarity, width))  # its edges are written
    discard(texts)
    rooted = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = rooted.groupBy("root").agg(F.min("least").alias("best"))
    named = every.join(rooted.join(best, "root").select("fp", "best"), "fp")
    judged = named.select(F.col("id._gm_text").alias("_gm_text"), F.col("id._gm_whole").alias("_gm_whole"), F.col("id").eqNullSafe(F.col("best")).alias("stays"), "n")
    gone = staged(judged.where("not stays").select(*key), "gone")
    twins = staged(judged.where("stays and n > 1").select(*key), "twins")
    known, double = bounded(gone), bounded(twins)
    left = keyed.join(known, key, "left_anti")
    single = left.join(double, key, "left_anti")
    return single.unionByName(left.join(double, key, "left_semi").dropDuplicates(key)).select(*columns)
