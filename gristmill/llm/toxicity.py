"""Toxic passages by maximum-scoring segments, with extreme-value calibration.

Token scores are log-odds with an informative Dirichlet prior: the pooled document frequencies of
the learning sample, scaled to a share ``prior`` of its mass, smooth both classes; a token counts
once a document.  Every log-odds, positive or negative, is drawn towards zero by ``shrink`` standard
errors, so what the sample doesn't establish has no say, and each token costs ``drift`` besides.
Stems (the first code points of a longer token) are weighted the same way, and a token that has no
score of its own takes that of its longest stem, since insults are inflected.

A linear scan (all maximal scoring subsequences, Ruzzo and Tompa 1999) finds the passages of a text.
For scores with negative drift the best segment of m clean tokens follows an extreme-value law, so a
passage of score s has the expectation K m exp(-lambda s): lambda solves the law's equation on the
scores of clean tokens, K is the maximum-likelihood value on clean documents.  Passages below
``level`` are significant.  A logistic curve over the document's best and summed evidence, fitted on
the learning folds, turns it into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, logistic, short_batches, staged, training_sample

#: Bound of the fit: labelled rows.  Everything learnt grows with their vocabulary only.
SAMPLE_ROWS = 12_000
THRESHOLD = 0.7
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Lengths of stems, longest first; how many tokens' scores a worker remembers; counts that a task holds.
STEMS, REMEMBERED, HELD = (7, 6, 5, 4), 100_000, 200_000
#: Scores of clean tokens are counted in steps of this size.
STEP = 0.01


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def stems(token: bytes) -> list[bytes]:
    """The token's stems, longest first, each with a star."""
    if len(token) <= STEMS[-1]:
        return []
    text = token.decode("utf-8", "surrogatepass")
    return [text[:k].encode("utf-8", "surrogatepass") + b"*" for k in STEMS if len(text) > k]


class Scores(dict):
    """Token scores by lookup; tokens seen first are resolved through their stems, within a bound."""

    def __init__(self, lexicon: dict[bytes, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: bytes) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        found = self.lexicon.get(token)
        if found is None:
            found = next((self.lexicon[x] for x in stems(token) if x in self.lexicon), 0.0)
        self[token] = found
        return found


@dataclass(frozen=True)
class Model:
    """What scoring needs; ``lexicon`` has the scores other than zero."""

    lexicon: dict[bytes, float]
    drift: float = 0.3
    rate: float = 1.0  # lambda
    k: float = 1.0
    level: float = 0.05
    weights: tuple[float, ...] = field(default=(0.0, 0.0, 0.0, 0.0))

    @cached_property
    def table(self) -> Scores:
        return Scores(self.lexicon)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)


def log_odds(counts: DataFrame, toxic: float, clean: float, prior: float, shrink: float) -> DataFrame:
    """``counts`` (w, toxic, clean) with d, the shrunk log-odds; ``toxic`` and ``clean`` are the columns' sums."""
    mass = prior * (toxic + clean)
    t, c = (F.col(x) + F.lit(prior) * (F.col("toxic") + F.col("clean")) for x in ("toxic", "clean"))
    odds = F.log(t / (F.lit(toxic + mass) - t)) - F.log(c / (F.lit(clean + mass) - c))
    return counts.withColumn("d", F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - F.lit(shrink) * F.sqrt(1 / t + 1 / c)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence: (first, after last, score) in order.

    Linear: only positive scores open a candidate, and the list of candidates is walked back through
    links to the nearest one with a smaller left sum.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    at = np.nonzero(scores > 0)[0]
    out: list[list] = []  # first, after last, left sum, right sum, link
    for position, left, right in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist(), strict=True):
        new = [position, position + 1, left, right, -1]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            new[4] = j
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3], -1]
            del out[j:]
    return [(a, b, right - left) for a, b, left, right, _ in out]


def token_scores(text: str | None, model: Model) -> np.ndarray:
    found = tokens(text)
    return np.fromiter(map(model.table.__getitem__, found), float, len(found)) - model.drift


def evidence(text: str | None, model: Model) -> tuple[tuple[float, float, float], list[tuple[int, int, float, float]]]:
    """Features of a document and its significant passages (first token, after last, score, expectation)."""
    scores = token_scores(text, model)
    passages = segments(scores)
    if not passages:
        return (-0.5, 0.0, 0.0), []
    scale = math.log(model.k * len(scores))
    best = max(model.rate * s - scale for _, _, s in passages)
    found = [(a, b, s, math.exp(min(700.0, scale - model.rate * s))) for a, b, s in passages]
    significant = [p for p in found if p[3] <= model.level]
    return (max(-5.0, min(50.0, best)) / 10, math.log1p(sum(model.rate * p[2] - scale for p in significant)), float(bool(significant))), significant


def _probability(features: tuple[float, ...], model: Model) -> float:
    z = sum(w * x for w, x in zip(model.weights, (*features, 1.0), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def score(text: str | None, model: Model) -> float:
    return _probability(evidence(text, model)[0], model)


def document_counts(sample: DataFrame) -> DataFrame:
    """(w, toxic, clean): documents of each class by token and stem; the empty token counts all documents.

    ``sample`` has text and _y.  A task holds ``HELD`` counts and a text's, then passes them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            columns = [pa.array(keys, pa.binary()), *(pa.array([held[y][w] for w in keys], pa.int64()) for y in (1, 0))]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["w", "toxic", "clean"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = set(tokens(text))
                held[int(y > 0)].update(own.union([b""], *map(stems, own)))
                if len(held[0]) + len(held[1]) > HELD:
                    yield flush()
        if held[0] or held[1]:
            yield flush()

    counted = sample.select("text", "_y").mapInArrow(run, "w binary, toxic long, clean long")
    return counted.groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def karlin(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection; 64 at most."""

    def excess(x: float) -> float:
        return float((shares * np.exp(np.minimum(700.0, x * scores))).sum()) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _calibrated(sample: DataFrame, draft: Model) -> Model:
    """``draft`` with lambda and K from the clean documents of the sample."""
    shared = sample.sparkSession.sparkContext.broadcast(draft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps: Counter = Counter()
        for batch in batches:
            sizes, best = [], []
            for text in batch.column(0).to_pylist():
                scores = token_scores(text, shared.value)
                if len(scores):
                    steps.update(np.rint(scores / STEP).astype(int).tolist())
                    sizes.append(len(scores))
                    best.append(max((s for _, _, s in segments(scores)), default=0.0))
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), pa.array(best, pa.float64())], names=["step", "n", "best"])
        yield pa.RecordBatch.from_arrays([pa.array(list(steps), pa.int64()), pa.array(list(steps.values()), pa.int64()), pa.nulls(len(steps), pa.float64())], names=["step", "n", "best"])

    # as many rows as the sample has, and the steps between the least and the largest score
    rows = sample.where("_y = 0").select("text").mapInArrow(run, "step long, n long, best double").groupBy("step", "best").agg(F.sum("n").alias("n")).collect()
    steps = {r["step"]: r["n"] for r in rows if r["step"] is not None}
    best = [(r["n"], r["best"]) for r in rows if r["step"] is None]
    if not best:
        return draft
    counts = np.array(list(steps.values()), float)
    rate = karlin(np.array(list(steps), float) * STEP, counts / counts.sum())
    documents = sample.where("_y = 0").count()
    k = documents / sum(n * math.exp(-rate * s) for n, s in best)
    return Model(draft.lexicon, draft.drift, rate, k, draft.level)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
    prior: float = 0.1,
    shrink: float = 1.5,
    drift: float = 0.3,
    level: float = 0.05,
) -> Model:
    """Learn from at most about ``sample_rows`` labelled rows outside the held-out fold.

    Copies of one text count once, as toxic if any is.  Null texts count as empty.  Without rows of
    both classes the lexicon is empty and every score is one half.
    """
    chosen = training_sample(labels, id_column, label, sample_rows, "toxicity")
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    # the sample is bounded by sample_rows, so its ids may be broadcast and few files hold it
    picked = docs.select(F.col(id_column).alias("_id"), text).join(F.broadcast(chosen), "_id").groupBy("text").agg(F.max("_y").alias("_y"))
    sample = staged(picked, "toxicity", files=24)
    counts = staged(document_counts(sample), "counts", files=24)
    own, one = F.length("w") > 0, F.length("w") == 0
    total = counts.agg(*[F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0)).cast("double") for which in (one, own) for c in ("toxic", "clean")]).first()
    if not total[0] or not total[1] or not total[2] + total[3]:
        discard(sample)
        discard(counts)
        return Model({})
    # bounded by the vocabulary of the sample
    rows = log_odds(counts.where(own), total[2], total[3], prior, shrink).where("d <> 0").select("w", "d").collect()
    lexicon = {bytes(r["w"]): r["d"] for r in rows}
    discard(counts)
    draft = _calibrated(sample, Model(lexicon, drift, level=level))
    shared = docs.sparkSession.sparkContext.broadcast(draft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [evidence(t, shared.value)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([f[i] for f in found], pa.float64()) for i in range(3)), batch.column(1)], names=["a", "b", "c", "y"])

    features = sample.mapInArrow(run, "a double, b double, c double, y int").groupBy("a", "b", "c", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("a", "b", "c", "y").collect()
    discard(sample)
    x = np.array([[r["a"], r["b"], r["c"]] for r in features])
    y = np.array([float(r["y"]) for r in features])
    n = np.array([r["n"] for r in features])
    weights = logistic(np.repeat(x, n, axis=0), np.repeat(y, n))
    return Model(lexicon, drift, draft.rate, draft.k, level, tuple(float(w) for w in weights))


def toxicity(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, score, passages.

    passages: significant ones as token ranges with score and expectation.  Null and empty texts
    have no evidence and get the curve's value there.  Equal texts score alike, repeated rows each
    by themselves; null ids are kept; a long text is read as a whole, in time that grows with its
    length; an empty table gives no rows.  Columns other than id and text are not read.  Narrow: no
    shuffle.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    passage = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())]))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                features, passages = evidence(text, model)
                scores.append(_probability(features, model))
                found.append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in passages])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=["id", "score", "passages"])

    schema = T.StructType([T.StructField("id", docs.schema[id_column].dataType), T.StructField("score", T.DoubleType()), T.StructField("passages", passage)])
    scored = docs.select(F.col(id_column), F.col(text_column).cast("string")).toDF("id", "text").mapInArrow(run, schema)
    return scored.withColumnRenamed("id", id_column)
