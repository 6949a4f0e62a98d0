"""Hard negatives of anchors, by exact integer scores.

``mine`` scores a set of anchors against every row and, for each anchor, takes its first
``positives`` rows of the same label; for each of these, the first ``negatives`` rows of
another label whose score lies in a window below the positive's. First means higher
score, then smaller id.

Vectors become integers (``floor(scale * x)``) and are multiplied in a residue number
system: modulo each of a few primes below 256 the balanced residues are multiplied as
float32 matrices, in which every sum of ``DEPTH`` products stays below 2**24 and so is
exact; the signed score is put together from its residues by the Chinese remainder
theorem, in balanced mixed-radix digits. As many primes are used as the longest vector
asks for: a score is at most the product of two lengths.

Anchors go to the tasks in blocks of at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``
bytes, so a broadcast has a fixed bound; each block is multiplied with every row, slab by
slab, and a task keeps ``positives`` rows per anchor (then ``negatives`` rows per window)
whatever it reads. So a label, or a vector, that a third of the rows share is no group
anywhere: it is read by all tasks. What the tasks kept meets in a window over at most
``positives`` rows per anchor and task.

Rows with a null label, a null vector, or a null or non-finite component take no part;
nor do rows whose integer vector is ``LONGEST`` or longer, as their scores would not fit
(for unit vectors and a scale of 256 the length is 256). Shorter vectors count as filled
up with zeros; an empty vector scores 0 with everything. Rows with a null id are
candidates, behind all others of their score. Repeated rows are rows each, and an
anchor's copies are other rows to it. Extra columns are not read. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.session import scratch_path, spread, stored

#: Primes below 256, largest first; the product of all is above 2**62.
PRIMES = (251, 241, 239, 233, 229, 227, 223, 211)
#: 1,024 products of balanced residues, 125 at most, stay below 2**24.
DEPTH = 1_024
#: Vectors of this length or more take no part: 100 times a score has to fit 63 bits.
LONGEST = 2.0**27.5

BLOCK_ROWS = 16_384
BLOCK_BYTES = 32 << 20
TILE, SLAB = 256, 2_048

_LEAST = np.iinfo(np.int64).min
_KEPT = "anchor long, slot int, score long, id long, row long"


# --- residues -------------------------------------------------------------------------


def primes_for(bound: float) -> tuple[int, ...]:
    """The first primes whose product tells all integers from -bound to bound apart."""
    product, count = 1, 0
    while product <= 2 * bound + 1:
        if count == len(PRIMES):
            raise ValueError(f"scores up to {bound} need more primes")
        product, count = product * PRIMES[count], count + 1
    return PRIMES[: max(count, 1)]


def _balanced(x: np.ndarray, p: int) -> np.ndarray:
    half = p // 2
    return (x + half) % p - half


def residues(whole: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    return [_balanced(whole, p).astype(np.float32) for p in primes]


def combine(rests: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed integers that leave ``rests``: each digit is balanced, so no sum overflows."""
    value, product = rests[0].astype(np.int64), primes[0]
    for rest, p in zip(rests[1:], primes[1:], strict=True):
        digit = _balanced((rest - value % p) * pow(product, -1, p), p)
        value += product * digit
        product *= p
    return value


def multiply(a: list[np.ndarray], b: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact inner products of the rows of two matrices given by their residues."""
    rests = []
    for x, y, p in zip(a, b, primes, strict=True):
        total = np.zeros((len(x), len(y)), np.int64)
        for k in range(0, x.shape[1], DEPTH):
            total += _balanced((x[:, k : k + DEPTH] @ y[:, k : k + DEPTH].T).astype(np.int64), p)
        rests.append(_balanced(total, p))
    return combine(rests, primes)


# --- first rows by score ------------------------------------------------------------------


def first(scores: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
    """Per line, the columns of the k highest scores where ``open_``, ties by smaller column.

    Columns that are not open come last; the caller looks them up in ``open_``.
    """
    n = scores.shape[1]
    k = min(k, n)
    if np.abs(scores).max(initial=0) < 1 << 50 and n <= SLAB:
        key = np.where(open_, scores * n + np.arange(n - 1, -1, -1), _LEAST)
        return np.argpartition(key, n - k, axis=1)[:, n - k :]
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), ~scores, ~open_), axis=1)[:, :k]


class _Best:
    """The first k rows so far for each of some lines: score, id (null or not) and row number."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.score = np.full((lines, k), _LEAST)
        self.none = np.ones((lines, k), bool)
        self.id, self.row = np.zeros((lines, k), np.int64), np.full((lines, k), -1)

    def add(self, at: slice, found: np.ndarray, scores: np.ndarray, open_: np.ndarray, slab: _Slab) -> None:
        lines = np.flatnonzero(open_.any(axis=1))
        if not len(lines):
            return
        found = found[lines]
        there = np.take_along_axis(open_[lines], found, 1)
        where = np.arange(at.start, at.stop)[lines]
        score = np.hstack([self.score[where], np.where(there, np.take_along_axis(scores[lines], found, 1), _LEAST)])
        none = np.hstack([self.none[where], slab.none[found]])
        id_ = np.hstack([self.id[where], slab.id[found]])
        row = np.hstack([self.row[where], np.where(there, slab.row[found], -1)])
        order = np.lexsort((row, id_, none, ~score, row < 0), axis=1)
        for name, value in (("score", score), ("none", none), ("id", id_), ("row", row)):
            getattr(self, name)[where] = np.take_along_axis(value, order, 1)[:, : self.k]

    def rows(self, names: np.ndarray, slots: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(names), 20_000):
            line, place = np.nonzero(self.row[i : i + 20_000] >= 0)
            line += i
            if len(line):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names[line]), pa.array(slots[line].astype(np.int32)),
                        pa.array(self.score[line, place]),
                        pa.array(self.id[line, place], mask=self.none[line, place]), pa.array(self.row[line, place]),
                    ],
                    names=["anchor", "slot", "score", "id", "row"],
                )


class _Slab:
    """Some rows in the order of their ids."""

    def __init__(self, batch: pa.RecordBatch, width: int):
        ids = batch.column("id")
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.row = batch.column("row").to_numpy(zero_copy_only=False)
        order = np.lexsort((self.row, self.id, self.none))
        self.none, self.id, self.row = self.none[order], self.id[order], self.row[order]
        self.label = batch.column("label").to_numpy(zero_copy_only=False)[order]
        self.whole = matrix(batch.column("whole"), width)[order]


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as lines of one matrix, filled up with zeros."""
    out = np.zeros((len(lists), width), np.int64)
    sizes = np.diff(lists.offsets.to_numpy())
    line = np.repeat(np.arange(len(lists)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[line, np.arange(len(line)) - begin] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _slabs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[_Slab]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLAB):
            yield _Slab(batch.slice(i, SLAB), width)


# --- the two passes -------------------------------------------------------------------------


def _block(anchors: DataFrame, b: int, width: int) -> dict[str, np.ndarray]:
    """Block ``b`` of the anchors, on the driver: as bounded as the block."""
    held = anchors.filter(F.col("block") == b).orderBy("row").select("row", "label", "whole").toArrow().combine_chunks()
    whole = held.column("whole").chunk(0) if held.num_rows else pa.array([], pa.list_(pa.int32()))
    return {
        "row": held.column("row").to_numpy(), "label": held.column("label").to_numpy(),
        "whole": matrix(whole, width).astype(np.int32),
    }


def _same_label(rows: DataFrame, block: dict[str, np.ndarray], width: int, primes, k: int) -> DataFrame:
    """Of every task, the first k other rows of each anchor's label."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        factors = residues(own["whole"].astype(np.int64), primes)
        best = _Best(len(own["row"]), k)
        for slab in _slabs(batches, width):
            there = residues(slab.whole, primes)
            for i in range(0, len(own["row"]), TILE):
                at = slice(i, min(i + TILE, len(own["row"])))
                scores = multiply([x[at] for x in factors], there, primes)
                open_ = (own["label"][at, None] == slab.label) & (own["row"][at, None] != slab.row)
                best.add(at, first(scores, open_, k), scores, open_, slab)
        yield from best.rows(own["row"], np.zeros(len(own["row"])))

    return rows.select("row", "id", "label", "whole").mapInArrow(run, _KEPT)


def _in_window(rows: DataFrame, block: dict[str, np.ndarray], width: int, primes, k: int) -> DataFrame:
    """Of every task, the first k rows of another label in each window of each anchor."""
    held = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        factors = residues(own["whole"].astype(np.int64), primes)
        slots = own["low"].shape[1]
        best = [_Best(len(own["row"]), k) for _ in range(slots)]
        for slab in _slabs(batches, width):
            there = residues(slab.whole, primes)
            for i in range(0, len(own["row"]), TILE):
                at = slice(i, min(i + TILE, len(own["row"])))
                scores = multiply([x[at] for x in factors], there, primes)
                other = own["label"][at, None] != slab.label
                for s in range(slots):
                    # What does not reach the last row kept so far is not looked at again.
                    low = np.maximum(own["low"][at, s], best[s].score[at, -1])
                    open_ = other & (scores >= low[:, None]) & (scores <= own["high"][at, s, None])
                    lines = np.flatnonzero(open_.any(axis=1))
                    if len(lines):
                        found = np.zeros((len(open_), min(k, len(slab.row))), np.int64)
                        found[lines] = first(scores[lines], open_[lines], k)
                        best[s].add(at, found, scores, open_, slab)
        for s in range(slots):
            yield from best[s].rows(own["row"], np.full(len(own["row"]), s))

    return rows.select("row", "id", "label", "whole").mapInArrow(run, _KEPT)


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def whole_vectors(
    vectors: DataFrame, anchor: Column, id_col: str, label: Column, vector_col: str, scale: int
) -> DataFrame:
    """The rows that take part: row number, id, label, integer vector, its length squared, anchor or not."""
    taken = vectors.select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    taken = taken.filter(F.col("label").isNotNull() & F.col("x").isNotNull()).filter(~bad)
    square = F.aggregate(
        F.transform("x", lambda v: F.floor(v * scale).cast("double")), F.lit(0.0), lambda s, v: s + v * v
    )
    # floor() gives longs, so longer vectors are told by their doubles first.
    rough = F.aggregate("x", F.lit(0.0), lambda s, v: s + (v * scale) * (v * scale))
    taken = taken.filter(rough < 4 * LONGEST**2).withColumn("square", square).filter(F.col("square") < LONGEST**2)
    whole = F.transform("x", lambda v: F.floor(v * scale).cast("int"))
    return taken.select(F.monotonically_increasing_id().alias("row"), "id", "label", whole.alias("whole"), "square", "anchor")


def mine(
    vectors: DataFrame,
    anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Hard negatives of the rows that are an ``anchor`` (a condition; null is no).

    A negative's score is at least ``low`` and at most ``high`` hundredths of the
    positive's. ``label`` replaces the label column. Gives anchor_id, positive_id, rank,
    negative_id, positive_score and negative_score.
    """
    spark = vectors.sparkSession
    name = F.col(label_col) if label is None else label
    rows = stored(whole_vectors(vectors, anchor, id_col, name, vector_col, scale), "vectors")
    top = rows.agg(F.max("square"), F.max(F.size("whole"))).head()
    primes, width = primes_for(top[0] or 0), max(top[1] or 0, 1)

    chosen = rows.filter("anchor").select("row", "id", "label", "whole")
    size = max(1, min(block_rows, BLOCK_BYTES // (8 * width)))
    blocks = max(1, -(-chosen.count() // size))
    block_of = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    path = scratch_path(spark, "anchors")
    chosen.withColumn("block", block_of).write.partitionBy("block").parquet(path)
    anchors = spark.read.schema("row long, id long, label long, whole array<int>, block int").parquet(path)
    dealt = spread(rows)

    near, far = scratch_path(spark, "same-label"), scratch_path(spark, "in-window")
    for b in range(blocks):
        _same_label(dealt, _block(anchors, b, width), width, primes, positives).write.mode("append").parquet(near)
    found = _ranked(spark.read.schema(_KEPT).parquet(near), positives)
    found = found.select(
        "anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    found = stored(found.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")), "positives")

    for b in range(blocks):
        block = _block(anchors, b, width)
        held = found.filter(F.col("block") == b).select("anchor", "slot", "positive_score").toArrow()
        line, slot = np.searchsorted(block["row"], held.column(0).to_numpy()), held.column(1).to_numpy()
        score = held.column(2).to_numpy()
        block["low"] = np.ones((len(block["row"]), positives), np.int64)
        block["high"] = np.zeros((len(block["row"]), positives), np.int64)
        block["low"][line, slot], block["high"][line, slot] = -((-low * score) // 100), (high * score) // 100
        _in_window(dealt, block, width, primes, negatives).write.mode("append").parquet(far)
    last = _ranked(spark.read.schema(_KEPT).parquet(far), negatives)
    ids = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        last.join(found.drop("block"), ["anchor", "slot"])
        .join(ids, "anchor")
        .select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score"),
        )
    )
