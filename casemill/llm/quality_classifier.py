"""A quality classifier: naive Bayes ratios under a linear hinge-loss model.

Features are indicators of n-grams: three-byte runs over 32 kinds of byte (letters,
capitals, digits, each common sign), single words and word pairs (hashed), and tenths of
the share of three-word runs that came before in the same text. Each feature is scaled
by the log of the ratio of its smoothed frequencies in the two classes; a linear model
with squared norm and hinge loss is fitted to the scaled, length-normalised rows by dual
coordinate descent, and a logistic curve through its margins gives the score.

The fit uses at most ``FIT_ROWS`` labelled documents, those with the smallest hashes of
their ids, each with all its features; where these are more than ``FIT_PAIRS`` together
(very long texts), as many whole documents as stay below. Both bounds are parameters. The
model is one array of ``2 ** BITS`` numbers, whatever the corpus.
Scoring reads every text whole, in one pass without a shuffle.

Null texts are empty texts; an empty text has no features and gets the score of the bare
intercept. Labels that are null are left out; ids labelled more than once take the
larger share (ties: 1). Without both classes every score is the share of ones (0.5
without labels). Extra columns are not read; rows that share an id are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import texts as X
from casemill.session import stored

FIT_ROWS = 6_000
FIT_PAIRS = 20_000_000
BITS = 17
SLAB = 500_000
#: Rows at a time; each takes 2 ** BITS bytes while its features are sorted out.
SLAB_ROWS = 400
EPOCHS = 30
COST = 1.0

_KINDS = 32
_RUNS = _KINDS**3
_SHARES = 11
_HASHED = 1 << 16


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, 1, np.uint32)
    kind[128:] = 2
    kind[97:123] = 3
    kind[65:91] = 4
    kind[48:58] = 5
    for i, signs in enumerate((b" ", b"\n", b"\t\r", b".", b",", b"!", b"?", b"|", b"#", b"*", b"$", b"%", b"&", b"<",
                               b">", b"'\"", b"-", b"_", b"/", b"@", b"=", b":;", b"()", b"[]{}")):
        kind[list(signs)] = 6 + i
    return kind


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted by row."""
    data, offsets = X.raw(texts)
    rows = len(offsets) - 1
    found = np.zeros(rows << BITS, bool)
    doc = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    if len(data) >= 3:
        kind = _byte_kinds()[data]
        run = (kind[:-2] * _KINDS + kind[1:-1]) * _KINDS + kind[2:]
        same = doc[:-2] == doc[2:]
        found[(doc[:-2][same] << BITS) + run[same]] = True
    w = X.words(texts)
    if len(w.hash):
        found[(w.doc << BITS) + _RUNS + (w.hash % np.uint64(_HASHED >> 1)).astype(np.int64)] = True
        pair = w.doc[1:] == w.doc[:-1]
        both = X.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:])[pair] % np.uint64(_HASHED >> 1)
        found[(w.doc[1:][pair] << BITS) + _RUNS + (_HASHED >> 1) + both.astype(np.int64)] = True
    at, run = X.windows(w, 3)
    there = np.bincount(at, minlength=rows)
    fresh = np.bincount(X.distinct(at, run)[0], minlength=rows)
    share = np.minimum(_SHARES - 1, (10 * (there - fresh) + there - 1) // np.maximum(there, 1))
    filled = np.flatnonzero(there)
    found[(filled << BITS) + _RUNS + _HASHED + share[filled]] = True
    flat = np.flatnonzero(found)
    return flat >> BITS, flat & ((1 << BITS) - 1)


def _ratios(rows: np.ndarray, cols: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the ratio of each feature's smoothed share among ones and among zeros."""
    size = 1 << BITS
    positive = 1.0 + np.bincount(cols[ones[rows]], minlength=size)
    negative = 1.0 + np.bincount(cols[~ones[rows]], minlength=size)
    return np.log(positive / (ones.sum() + 2)) - np.log(negative / ((~ones).sum() + 2))


def _descend(rows, cols, scaled, sign, cost, epochs) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; the bias is one more feature."""
    n = len(sign)
    first = np.searchsorted(rows, np.arange(n + 1))
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(n)
    norm = 1.0 + np.array([scaled[first[i] : first[i + 1]] @ scaled[first[i] : first[i + 1]] for i in range(n)])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(n):
            part = slice(first[i], first[i + 1])
            at, x = cols[part], scaled[part]
            gradient = sign[i] * (weights[at] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost)
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[at] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3 * cost:
            break
    return weights, bias


def _curve(margin: np.ndarray, ones: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton's method."""
    n1, n0 = ones.sum(), (~ones).sum()
    goal = np.where(ones, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - goal))
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _fit(rows: np.ndarray, cols: np.ndarray, ones: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """rows and cols: sorted (row, feature) pairs; ones: each row's class."""
    n = len(ones)
    if not n or ones.all() or not ones.any():
        share = 0.5 if not n else (ones.sum() + 1) / (n + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    ratio = _ratios(rows, cols, ones)
    length = np.sqrt(np.maximum(np.bincount(rows, weights=ratio[cols] ** 2, minlength=n), 1e-12))
    scaled = ratio[cols] / length[rows] * 4.0
    sign = np.where(ones, 1.0, -1.0)
    # Margins for the curve come from models that have not seen the rows.
    fold = np.arange(n) % 3
    margin = np.zeros(n)
    for f in range(3):
        mine = fold[rows] != f
        names = np.cumsum(fold != f) - 1
        weights, bias = _descend(names[rows[mine]], cols[mine], scaled[mine], sign[fold != f], cost, epochs // 3)
        other = ~mine
        margin += bias * (fold == f)
        margin += np.bincount(rows[other], weights=weights[cols[other]] * scaled[other], minlength=n)
    slope, shift = _curve(margin, ones)
    weights, bias = _descend(rows, cols, scaled, sign, cost, epochs)
    return Model(np.stack([weights * ratio * 4.0, ratio**2]).astype(np.float32), bias, slope, shift)


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    rows, cols = features(texts)
    if model.weights.ndim == 1:
        margin = np.zeros(len(texts))
    else:
        length = np.sqrt(np.maximum(np.bincount(rows, weights=model.weights[1][cols], minlength=len(texts)), 1e-12))
        margin = np.bincount(rows, weights=model.weights[0][cols], minlength=len(texts)) / length + model.bias
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))


def held_out(id_col: str, folds: int = 4, which: int = 2):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == which, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    fit_rows: int = FIT_ROWS, fit_pairs: int = FIT_PAIRS,
) -> Model:
    """The model of the labelled rows of ``labels`` (the caller leaves out those held out)."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("k")).agg((2 * F.avg(F.col(label_col)) >= 1).alias("y"))
    # The limit bounds what is broadcast; rows of one id and text count once.
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(fit_rows)
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    source = source.join(F.broadcast(chosen), "k").select("y", "t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in X.slabs(batch, "t", SLAB, SLAB_ROWS):
                rows, cols = features(slab.column("t"))
                parts = np.split(cols.astype(np.uint32), np.searchsorted(rows, np.arange(1, slab.num_rows)))
                yield pa.RecordBatch.from_arrays(
                    [slab.column("y"), pa.array([p.tobytes() for p in parts], pa.binary())],
                    names=["y", "f"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, cols = [], []
        for batch in batches:
            ones += batch.column("y").to_pylist()
            cols += [np.frombuffer(f, np.uint32) for f in batch.column("f").to_pylist()]
        order = sorted(range(len(cols)), key=lambda i: (cols[i].tobytes(), ones[i]))
        cols, ones = [cols[i] for i in order], [ones[i] for i in order]
        rows = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
        model = _fit(rows, np.concatenate([*cols, np.zeros(0, np.uint32)]).astype(np.int64), np.array(ones, bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([[model.bias, model.slope, model.shift]])],
            names=["weights", "rest"],
        )

    # One task fits the bounded sample; the limits hold where many rows share a chosen id, too.
    found = stored(source.mapInArrow(extract, "y boolean, f binary").withColumn("h", F.xxhash64("f", "y")), "features")
    sizes = found.select("h", (F.octet_length("f") / 4).cast("long").alias("n")).orderBy("h").limit(fit_rows).collect()
    upto = np.cumsum([r["n"] for r in sizes])
    last = int(np.searchsorted(upto, fit_pairs, side="right"))
    if last < len(sizes):
        found = found.filter(F.col("h") < sizes[last]["h"])
    found = found.orderBy("h").limit(fit_rows).select("y", "f")
    row = found.repartition(1).mapInArrow(learn, "weights binary, rest array<double>").first()
    if row is None:
        return _fit(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    weights = np.frombuffer(row["weights"], np.float32)
    return Model(weights if len(weights) == 1 << BITS else weights.reshape(2, -1), *row["rest"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*held.value)
        for batch in batches:
            for slab in X.slabs(batch, "t", SLAB, SLAB_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [slab.column("k"), pa.array(_scores(slab.column("t"), m))], names=["k", "score"]
                )

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, score double").withColumnRenamed("k", id_col)
