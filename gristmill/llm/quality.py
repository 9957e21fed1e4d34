"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's features are character shares and word repetition of the line
itself and of the lines before and after it.  The field is fitted with the document's label on each
of its lines, by gradient ascent on the conditional likelihood; forward-backward gives each line
its marginal, and the length-weighted mean of the marginals, through a logistic curve, is the
document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import logistic, short_batches, training_sample

#: Bound of the fit: labelled rows, with all of their lines.
SAMPLE_ROWS = 3000
THRESHOLD = 0.5
_LETTER, _UPPER, _DIGIT, _SPACE, _STOP, _BANG, _BAR, _SIGN = range(8)
_CLASSES = np.array(
    [
        _UPPER if 0x41 <= b <= 0x5A else _LETTER if b >= 0x80 or 0x61 <= b <= 0x7A else _DIGIT if 0x30 <= b <= 0x39 else _SPACE if b in b" \t\r\n" else _STOP if b in b".,;:'\"()-?" else _BANG if b == 0x21 else _BAR if b == 0x7C else _SIGN
        for b in range(256)
    ],
    np.int64,
)
OWN = 12
FEATURES = 3 * OWN + 3


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, lines by text) for all lines of ``texts``; a text has at least one line."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    per = np.array([d.count(b"\n") + 1 for d in data], np.int64)
    joined = b"\n".join(data) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    ends = np.nonzero(raw == 0x0A)[0]
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    n = len(ends)
    counts = np.zeros((n, 8))
    # lines in blocks, so that scratch space stays small
    block = np.concatenate([[0], np.nonzero(np.diff(ends >> 22))[0] + 1, [n]])
    for a, b in zip(block[:-1], block[1:], strict=True):
        if a == b:
            continue
        lengths = ends[a:b] + 1 - starts[a:b]
        at = np.repeat(np.arange(b - a, dtype=np.int64) * 8, lengths) + _CLASSES[raw[starts[a] : ends[b - 1] + 1]]
        counts[a:b] = np.bincount(at, minlength=8 * (b - a)).reshape(-1, 8)
    counts[:, _SPACE] -= 1  # the newline itself
    words, fresh, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i, line in enumerate(joined.split(b"\n")[:-1]):
        found = line.split()
        words[i] = len(found)
        fresh[i] = len(set(found))
        same[i] = sum(map(bytes.__eq__, found, found[1:]))
    w, s = np.maximum(words, 1), np.maximum(size, 1)
    letters = counts[:, _LETTER] + counts[:, _UPPER]
    own = np.column_stack(
        [
            counts[:, _UPPER] / np.maximum(letters, 1),
            counts[:, _DIGIT] / s,
            counts[:, _SPACE] / s,
            counts[:, _STOP] / s,
            np.minimum(counts[:, _BANG] / w, 2),
            np.minimum(counts[:, _BAR] / w, 2),
            np.minimum(counts[:, _SIGN] / w, 3),
            (1 - fresh / w) * (words > 0) * np.minimum(1, words / 20),
            same / w,
            np.minimum(s / w, 30) / 10,
            np.log1p(size) / 5,
            (size == 0).astype(float),
        ]
    )
    last = np.cumsum(per) - 1
    first = last - per + 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    before[first] = 0
    after[last] = 0
    edge = np.zeros((n, 3))
    edge[first, 0] = 1
    edge[last, 1] = 1
    edge[:, 2] = 1
    return np.column_stack([own, before, after, edge]), np.maximum(size, 1).astype(float), per


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    transitions: np.ndarray  # 2 x 2, bad first
    curve: tuple[float, float]
    #: what every document scores when there was nothing to learn from
    constant: float | None = None


def _passes(emission: np.ndarray, per: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once, longest first, one step a line number.

    ``emission`` is the score of good against bad by line.  Returns the marginals of good, the
    expected transition counts, the log-partition by chain and the lines' ordering by chain.
    """
    order = np.argsort(-per, kind="stable")
    lengths = per[order]
    start = (np.cumsum(per) - per)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    psi = np.column_stack([np.exp(-np.maximum(emission, 0)), np.exp(np.minimum(emission, 0))])  # scaled by exp(-max(e, 0))
    t = np.exp(transitions)
    alpha = np.empty_like(psi)
    scale = np.empty(len(psi))
    previous = np.empty((0, 2))
    for k in range(steps):
        rows = start[: active[k]] + k
        now = psi[rows] if k == 0 else (previous[: active[k]] @ t) * psi[rows]
        total = now.sum(axis=1)
        previous = now / total[:, None]
        alpha[rows], scale[rows] = previous, total
    beta = np.ones_like(psi)
    expected = np.zeros((2, 2))
    for k in range(steps - 2, -1, -1):
        rows = start[: active[k + 1]] + k
        following = psi[rows + 1] * beta[rows + 1] / scale[rows + 1][:, None]
        beta[rows] = following @ t.T
        expected += (alpha[rows].T @ following) * t
    partition = np.log(scale) + np.maximum(emission, 0)
    return alpha[:, 1] * beta[:, 1], expected, partition, order


def fit_field(x: np.ndarray, per: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of the field for chains whose lines all have the label ``y``; Adam."""
    lines = np.repeat(y, per).astype(float)
    pairs = np.maximum(per - 1, 0)
    observed = np.diag([pairs[y == 0].sum(), pairs[y == 1].sum()]).astype(float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = len(lines)
    for i in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        p, expected, _, _ = _passes(x @ w, per, t)
        gradient = np.concatenate([x.T @ (lines - p), (observed - expected).ravel()]) / n - l2 * theta / n
        # self-transitions are all that is observed; a strong pull keeps neighbours from deciding everything
        gradient[-4:] -= 0.05 * theta[-4:]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def document_marginals(texts: list[str], weights: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length-weighted good share by text, the lines' marginals and the lines by text."""
    x, size, per = line_features(texts)
    p, _, _, _ = _passes(x @ weights, per, transitions)
    first = np.cumsum(per) - per
    return np.add.reduceat(p * size, first) / np.add.reduceat(size, first), p, per


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most about ``sample_rows`` labelled rows outside the held-out fold.

    All lines of such a row are learnt from; the driver holds their features, 156 bytes a line.
    Without rows of both classes every document scores the one class there is, or one when there is
    none.
    """
    chosen = training_sample(labels, id_column, label, sample_rows, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, per = line_features(batch.column(0).to_pylist())
            at = np.cumsum(per) - per
            out = [x[a : a + n].astype("<f4").tobytes() for a, n in zip(at.tolist(), per.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["x", "y"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    # both the ids and what comes back are bounded by sample_rows
    rows = docs.select(F.col(id_column).alias("_id"), text).join(F.broadcast(chosen), "_id").select("text", "_y").mapInArrow(run, "x binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r["x"]), r["y"]))  # tasks end in any order
    y = np.array([r["y"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.zeros((2, 2)), (1.0, 0.0), float(y[0]) if len(y) else 1.0)
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, FEATURES).astype(float) for r in rows]
    per = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts)
    weights, transitions = fit_field(x, per, y)
    p, _, _, _ = _passes(x @ weights, per, transitions)
    size = np.expm1(5 * x[:, 10]).clip(1)
    first = np.cumsum(per) - per
    q = np.add.reduceat(p * size, first) / np.add.reduceat(size, first)
    a, b = logistic(_logit(q)[:, None], y.astype(float))
    return Model(weights, transitions, (float(a), float(b)))


def quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", lines: bool = False) -> DataFrame:
    """One row per input row: id, score, and with ``lines`` the marginal of good for every line.

    Null texts count as empty, one empty line.  Equal texts score alike, repeated rows each by
    themselves; null ids are kept; a long text is read with all its lines; an empty table gives no
    rows.  Columns other than id and text are not read.  Narrow: no shuffle.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    fields = [T.StructField("id", docs.schema[id_column].dataType), T.StructField("score", T.DoubleType())]
    if lines:
        fields.append(T.StructField("line_marginals", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, p, per = document_marginals([t or "" for t in batch.column(1).to_pylist()], m.weights, m.transitions)
            scores = np.full(len(q), m.constant) if m.constant is not None else 1 / (1 + np.exp(-np.clip(m.curve[0] * _logit(q) + m.curve[1], -30, 30)))
            columns = [batch.column(0), pa.array(scores)]
            if lines:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(p)))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    scored = docs.select(F.col(id_column), F.col(text_column).cast("string")).toDF("id", "text").mapInArrow(run, T.StructType(fields))
    return scored.withColumnRenamed("id", id_column)


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged; one narrow pass after the fit.

    Null and empty texts are one empty line and go or stay by its score; repeated rows go or stay
    together; an empty table gives no rows; without labels every row stays.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, id_column, text_column))
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows or (m.constant is not None and m.constant >= THRESHOLD):
                yield batch
                continue
            q, _, _ = document_marginals([t or "" for t in batch.column(at).to_pylist()], m.weights, m.transitions)
            good = m.curve[0] * _logit(q) + m.curve[1] >= 0 if m.constant is None else np.zeros(len(q), bool)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
