"""Vectors reduced to the slow axes of their neighbour graph.

Every landmark is linked to its ``neighbours`` nearest by cosine similarity; the links are
made symmetric (the mean of both directions) and weighed by similarity. The axes are the
leading eigenvectors of the normalised graph beyond the constant one: along them linked
points stay together, so bent groups, which no linear projection can straighten, come
apart. They are found by block power iteration, sharpened by Chebyshev polynomials and
Rayleigh-Ritz steps, until every axis leaves a residual below ``RESIDUAL``.

Landmarks are the vectors with the smallest hashes of their ids, at most ``LANDMARKS`` and
``LANDMARK_BYTES``; up to that many vectors all are landmarks and the axes are those of
all. The bound makes the graph, what is broadcast and the iteration on the driver small
whatever the input. All other vectors are placed in one pass without a shuffle, each by
the weighted mean of its nearest landmarks (Nystrom's extension). Tasks multiply blocks of
rows with the landmarks and keep the nearest only; no table of pairs exists.

A zero vector has no direction; it stands at the origin. Null vectors, and vectors of
another length than the first landmark, get no point. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions import vectors as V
from casemill.operators import similar
from casemill.session import spread, stored

NEIGHBOURS = 15
DIM = 5
LANDMARKS = 8_000
LANDMARK_BYTES = 64 << 20
RESIDUAL = 1e-9
ROUNDS, DEGREE, SPARE = 200, 10, 8
# Similarities equal to this many decimals are ties, which go to the smaller id.
TIE_DECIMALS = 9
LEAST = 1e-6

ROWS = 1_024


class Graph(NamedTuple):
    """Landmarks (id, unit vector) and their symmetric links (a, b, weight), sorted by a and b."""

    ids: list
    units: np.ndarray
    a: np.ndarray
    b: np.ndarray
    weight: np.ndarray


# --- the graph --------------------------------------------------------------------------


def _units(vectors: DataFrame) -> DataFrame:
    unit = V.unit(F.col("embedding"), "double")
    return vectors.select("case_id", unit.alias("v")).filter("v IS NOT NULL AND size(v) > 0")


def _nearest(rows: np.ndarray, units: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row its k most similar landmarks, itself left out where ``own`` names it, and the weights."""
    scores = np.round(rows @ units.T, TIE_DECIMALS)
    if own is not None:
        scores[np.arange(len(rows)), own] = -np.inf
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    # All above the k-th, then ties by place until there are k.
    over, tied = scores > edge, scores == edge
    chosen = over | (tied & (np.cumsum(tied, axis=1) <= k - over.sum(axis=1, keepdims=True)))
    near = np.nonzero(chosen)[1].reshape(len(rows), k)
    return near, np.maximum(np.take_along_axis(scores, near, 1), LEAST)


def landmark_graph(vectors: DataFrame, neighbours: int = NEIGHBOURS, landmarks: int = LANDMARKS) -> Graph:
    spark, units = vectors.sparkSession, _units(vectors)
    first = units.orderBy(F.xxhash64("case_id"), "case_id").limit(1).head()
    if first is None:
        return Graph([], np.zeros((0, 0)), *[np.zeros(0, np.int64)] * 2, np.zeros(0))
    dim = len(first["v"])
    most = max(2, min(landmarks, LANDMARK_BYTES // (8 * dim)))
    there = units.filter((F.size("v") == dim) & F.exists("v", lambda x: x != 0))
    held = there.orderBy(F.xxhash64("case_id"), "case_id").limit(most).orderBy("case_id").toPandas()
    matrix = np.array(held["v"].tolist()).reshape(len(held), dim)
    k = min(neighbours, len(held) - 1)
    if k < 1:
        return Graph(held["case_id"].tolist(), matrix, *[np.zeros(0, np.int64)] * 2, np.zeros(0))
    sent = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                own = batch["id"].to_numpy()[i : i + ROWS]
                near, weight = _nearest(sent.value[own], sent.value, k, own)
                yield pd.DataFrame({"a": np.repeat(own, k), "b": near.ravel(), "w": weight.ravel()})

    links = _numbers(spark, len(held)).mapInPandas(run, "a long, b long, w double").toPandas()
    both = pd.concat([links, links.rename(columns={"a": "b", "b": "a"})])
    whole = both.groupby(["a", "b"], as_index=False)["w"].sum().sort_values(["a", "b"])
    return Graph(held["case_id"].tolist(), matrix, whole["a"].to_numpy(), whole["b"].to_numpy(), whole["w"].to_numpy() / 2)


def neighbour_links(vectors: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Links (a, b, weight) of every vector, not of landmarks only, by exact search; both directions."""
    units = _units(vectors).filter(F.exists("v", lambda x: x != 0))
    first = units.orderBy(F.xxhash64("case_id"), "case_id").limit(1).head()
    dim = len(first["v"]) if first else 0
    there = stored(units.filter(F.size("v") == dim).select("case_id", F.col("v").alias("embedding")), "units")
    # One more than wanted, as a vector may be among its own nearest.
    found = similar.nearest(there, there.withColumnRenamed("case_id", "query_id"), neighbours + 1)
    others = found.filter(F.col("query_id") != F.col("case_id"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    weight = F.greatest("similarity", F.lit(LEAST)).alias("w")
    near = stored(
        others.withColumn("place", place).filter(F.col("place") <= neighbours)
        .select(F.col("query_id").alias("a"), F.col("case_id").alias("b"), weight),
        "near",
    )
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    return both.groupBy("a", "b").agg((F.sum("w") / 2).alias("weight"))


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(0, n, 1, max(1, min(2 * spark.sparkContext.defaultParallelism, n // 512)))


# --- its axes ---------------------------------------------------------------------------


class Axes(NamedTuple):
    """Leading eigenvalues and vectors of the normalised graph, and each landmark's degree."""

    value: np.ndarray
    vector: np.ndarray
    degree: np.ndarray


def axes(graph: Graph, dim: int = DIM, seed: int = 42) -> Axes:
    """The ``dim`` leading axes beyond the one that is constant up to degrees."""
    n = len(graph.ids)
    degree = np.bincount(graph.a, graph.weight, n)
    scale = 1 / np.sqrt(degree)
    weight = graph.weight * scale[graph.a] * scale[graph.b]
    first = np.searchsorted(graph.a, np.arange(n))
    constant = np.sqrt(degree / degree.sum())[:, None]

    def times(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[:, None] * x[graph.b], first, axis=0)

    def sharpened(x: np.ndarray, edge: float) -> np.ndarray:
        """A Chebyshev polynomial that is small on [-1, edge] and grows fast above it."""
        middle, half = (edge - 1) / 2, (edge + 1) / 2
        before, now = x, (times(x) - middle * x) / half
        for _ in range(DEGREE - 1):
            before, now = now, 2 * (times(now) - middle * now) / half - before
            size = np.linalg.norm(now, axis=0).max()
            if size > 1e100:
                before, now = before / size, now / size
        return now

    wanted = min(dim, n - 1)
    size = min(wanted + SPARE, n - 1)
    block = np.random.default_rng(seed).normal(size=(n, size))
    edge = -0.5
    for _ in range(ROUNDS):
        block -= constant @ (constant.T @ block)
        block = np.linalg.qr(block)[0]
        after = times(block)
        value, turn = np.linalg.eigh(block.T @ after)
        value, turn = value[::-1], turn[:, ::-1]
        block, after = block @ turn, after @ turn
        rest = np.linalg.norm(after - value * block, axis=0)[:wanted]
        if rest.max(initial=0) < RESIDUAL or size == n - 1 and rest.max(initial=0) < 10 * RESIDUAL:
            break
        edge = min(max(edge, value[-1]), 1 - 1e-9)
        block = sharpened(block, edge)
    vector = block[:, :wanted]
    sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(wanted)])
    return Axes(value[:wanted], vector * sign, degree)


def places(found: Axes) -> np.ndarray:
    """Coordinates of the landmarks: eigenvectors of the random walk on the graph, of size about one."""
    return found.vector * np.sqrt(found.degree.sum() / found.degree)[:, None]


def reduce_graph(
    vectors: DataFrame, dim: int = DIM, neighbours: int = NEIGHBOURS, landmarks: int = LANDMARKS
) -> DataFrame:
    """(case_id, point) for (case_id, embedding): its place along the axes of the neighbour graph."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["case_id"]
    graph = landmark_graph(vectors, neighbours, landmarks)
    width = graph.units.shape[1]
    if len(graph.ids) < 3:
        there = _units(vectors).filter(F.size("v") == width) if width else _units(vectors).limit(0)
        return there.select("case_id", F.array_repeat(F.lit(0.0), dim).alias("point"))
    found = axes(graph, dim)
    place = np.zeros((len(graph.ids), dim))
    place[:, : found.vector.shape[1]] = places(found)
    value = np.ones(dim)
    value[: len(found.value)] = np.where(np.abs(found.value) > 1e-3, found.value, 1.0)
    k = min(neighbours, len(graph.ids))
    held = spark.sparkContext.broadcast((graph.units, place, value, {c: i for i, c in enumerate(graph.ids)}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, own, values, at = held.value
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                rows = np.array(part["v"].tolist()).reshape(len(part), -1)
                near, weight = _nearest(rows, units, k)
                point = (weight[:, :, None] * own[near]).sum(axis=1) / weight.sum(axis=1)[:, None] / values
                point[~rows.any(axis=1)] = 0
                mark = np.array([at.get(c, -1) for c in part["case_id"]])
                point[mark >= 0] = own[mark[mark >= 0]]
                yield pd.DataFrame({"case_id": part["case_id"], "point": list(point)})

    rows = _units(spread(vectors, "case_id")).filter(F.size("v") == width)
    return rows.mapInPandas(run, f"case_id {kind}, point array<double>")


def links(spark: SparkSession, graph: Graph, id_type: str = "string") -> DataFrame:
    """The graph's links as rows (a, b, weight) of ids, both directions."""
    rows = [(graph.ids[a], graph.ids[b], float(w)) for a, b, w in zip(graph.a, graph.b, graph.weight, strict=True)]
    return spark.createDataFrame(rows, f"a {id_type}, b {id_type}, weight double")


def residuals(joined: DataFrame, points: DataFrame, value: np.ndarray) -> DataFrame:
    """(axis, residual): how far each axis is from the random walk's eigenvector, by joins over
    links (a, b, weight) and points (case_id, point): the largest |sum(w p) / sum(w) - value * p|."""
    there = points.select(F.col("case_id").alias("b"), F.col("point").alias("to"))
    steps = joined.join(there, "b").groupBy("a").agg(
        F.sum("weight").alias("w"), *[F.sum(F.col("weight") * F.col("to")[i]).alias(f"s{i}") for i in range(len(value))]
    )
    both = steps.join(points.withColumnRenamed("case_id", "a"), "a")
    far = [F.max(F.abs(F.col(f"s{i}") / F.col("w") - float(v) * F.col("point")[i])).alias(f"r{i}") for i, v in enumerate(value)]
    pairs = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"r{i}").alias("residual")) for i in range(len(value))])
    return both.agg(*far).select(F.inline(pairs))
