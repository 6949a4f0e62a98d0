"""Exact nearest-vector search that skips blocks by the triangle inequality.

``build`` writes an index of unit vectors: a bounded number of them serve as pivots, every
vector belongs to its nearest pivot and stands in a block of vectors of one pivot and of
neighbouring distances to it. A block knows that range, so the distance of a query to the
pivot bounds its distance to everything in the block from both sides. Range partitions
over (pivot, distance, hash) split a pivot that holds a third of the vectors like any other.

``search`` takes queries in blocks of bounded size. Only summaries (pivot, range, number)
are read to find each query's most promising block; these blocks alone are multiplied to
give each query a similarity that its k-th answer reaches; then all blocks are passed, and
one is multiplied only with the queries whose bound it can still beat. Nothing is copied
per query, and a task hands on k rows per query. How many pairs of query and block there
were, and how many were multiplied, comes back beside the answers.

Similarities are rounded to ``TIE_DECIMALS`` and ties go to the smaller id, so answers are
those of comparing all pairs. A zero vector has similarity 0 to everything: zero vectors
are a pivot of their own and are never skipped, nor is a zero query's block. Rows whose id
or vector is null, or whose vector is of another length than the pivots, take no part. An
empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions import vectors as V
from casemill.session import scratch_path, spread, stored

PIVOTS = 256
BLOCK_ROWS = 1_024
QUERY_ROWS = 4_096
TIE_DECIMALS = 9
# Bounds allow for rounding: of distances, which are roots, and of similarities.
FAR_SLACK, SLACK = 1e-6, 1e-8

_ZERO = -1


class Index(NamedTuple):
    """Blocks (pivot, low, high, n, block, ids, rows) and the pivots, one matrix of bounded size."""

    blocks: DataFrame
    pivots: np.ndarray
    id_type: str


def _units(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.select(F.col(key).alias("id"), V.unit(F.col("embedding"), "double").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate([np.asarray(v, float) for v in vectors]).reshape(len(vectors), dim)


def _order(hash_: bool = True) -> list:
    return ["pivot", "distance", *([F.xxhash64("id")] if hash_ else []), "id"]


def build(corpus: DataFrame, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of (case_id, embedding), written to the shared folder."""
    spark, kind = corpus.sparkSession, dict(corpus.dtypes)["case_id"]
    units = _units(spread(corpus, "case_id"), "case_id")
    # The ids with the smallest hashes, at most that many.
    some = units.orderBy(F.xxhash64("id"), "id").limit(pivots).toPandas()["v"].tolist()
    dim = len(some[0]) if some else 0
    centres = [c for c in some if len(c) == dim and any(c)]
    centre = np.array(centres).reshape(len(centres), dim)
    held = spark.sparkContext.broadcast(centre)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[np.array([len(v) == dim for v in batch["v"]], bool)]
            for i in range(0, len(batch), block_rows):
                part = batch.iloc[i : i + block_rows]
                far, zero = _far(_matrix(part["v"], dim), held.value)
                near = far.argmin(axis=1) if far.shape[1] else np.full(len(part), _ZERO)
                distance = far[np.arange(len(part)), near] if far.shape[1] else np.zeros(len(part))
                yield pd.DataFrame({
                    "id": part["id"], "v": part["v"], "pivot": np.where(zero, _ZERO, near),
                    "distance": np.where(zero, 0.0, distance),
                })

    placed = units.mapInPandas(place, f"id {kind}, v array<double>, pivot int, distance double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, made, rest = TaskContext.get().partitionId(), 0, None

        def block(rows: pd.DataFrame) -> dict:
            nonlocal made
            made += 1
            return {
                "pivot": rows["pivot"].iloc[0], "low": rows["distance"].min(), "high": rows["distance"].max(),
                "n": len(rows), "block": (task << 32) + made, "ids": rows["id"].tolist(),
                "rows": _matrix(rows["v"], dim).tobytes(),
            }

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            out = []
            while len(rest):
                same = int((rest["pivot"] != rest["pivot"].iloc[0]).to_numpy().argmax()) or len(rest)
                if same == len(rest) and same < block_rows:
                    break
                size = min(same, block_rows)
                out.append(block(rest.iloc[:size]))
                rest = rest.iloc[size:]
            if out:
                yield pd.DataFrame(out)
        if rest is not None and len(rest):
            yield pd.DataFrame([block(rest)])

    schema = f"pivot int, low double, high double, n int, block long, ids array<{kind}>, rows binary"
    return Index(stored(dealt.mapInPandas(cut, schema), "index"), centre, kind)


def _far(rows: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of unit vectors to the pivots, and which of the vectors are zero."""
    square = (rows * rows).sum(axis=1)
    close = 2 - 2 * (rows @ centre.T)
    return np.sqrt(np.maximum(close, 0)), square == 0


def _most_similar(far: np.ndarray, zero: np.ndarray, pivot: int, low: float, high: float) -> np.ndarray:
    """No vector of the block is more similar to the queries than this."""
    if pivot == _ZERO:
        return np.zeros(len(far))
    least = np.maximum(np.maximum(far[:, pivot] - high, low - far[:, pivot]) - FAR_SLACK, 0)
    return np.where(zero, 0.0, 1 - least * least / 2)


def _first_k(found: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = found.sort_values(["query", "similarity", "id"], ascending=[True, False, True])
    return ordered.groupby("query", sort=False).head(k)


def _best(scores: np.ndarray, asked: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query asked; ties of the last are sorted out."""
    last = max(0, scores.shape[1] - k)
    edge = np.partition(scores, last, axis=1)[:, last]
    q, row = np.nonzero(scores >= edge[:, None])
    return _first_k(pd.DataFrame({"query": asked[q], "id": ids[row], "similarity": scores[q, row]}), k)


def _at_least(
    queries: np.ndarray, rows: bytes, asked: np.ndarray, ids: np.ndarray, edge: np.ndarray, k: int
) -> pd.DataFrame:
    """The rows of a block that reach each query's edge; of many, the k best of each."""
    scores = _products(queries, rows)
    # Only what may reach it once rounded is looked at.
    q, row = np.nonzero(scores >= (edge - SLACK)[:, None])
    if len(q) > 4 * k * len(asked):
        return _best(np.round(scores, TIE_DECIMALS), asked, ids, k)
    found = np.round(scores[q, row], TIE_DECIMALS)
    there = found >= edge[q]
    return pd.DataFrame({"query": asked[q[there]], "id": ids[row[there]], "similarity": found[there]})


def _promising(index: Index, held: Broadcast) -> np.ndarray:
    """Per query the block whose farthest vector may be nearest; read from summaries only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _, far, zero, _, k = held.value
        best = np.full(len(far), np.inf)
        block = np.full(len(far), -1, np.int64)
        for batch in batches:
            for pivot, high, n, name in batch[["pivot", "high", "n", "block"]].itertuples(index=False):
                reach = far[:, pivot] + high if pivot != _ZERO else np.full(len(far), 2.0)
                better = (reach < best) & (n >= k)
                best[better], block[better] = reach[better], name
        there = np.flatnonzero(block >= 0)
        yield pd.DataFrame({"query": there, "reach": best[there], "block": block[there]})

    rows = index.blocks.select("pivot", "high", "n", "block").mapInPandas(run, "query int, reach double, block long")
    found = rows.groupBy("query").agg(F.min(F.struct("reach", "block"))["block"].alias("block")).toPandas()
    out = np.full(len(held.value[1]), -1, np.int64)
    out[found["query"]] = found["block"]
    return out


def _reached(index: Index, held: Broadcast, block: np.ndarray) -> np.ndarray:
    """Per query the k-th similarity within its promising block, or the least there is."""
    spark = index.blocks.sparkSession
    asked = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, _, _, _, k = held.value
        for batch in batches:
            for name, rows in batch.itertuples(index=False):
                mine = np.flatnonzero(asked.value == name)
                scores = _scores(matrix[mine], rows)
                yield pd.DataFrame({"query": mine, "similarity": np.sort(scores, axis=1)[:, -k]})

    out = np.full(len(block), -2.0)
    names = np.unique(block[block >= 0]).tolist()
    if names:
        wanted = spark.createDataFrame([(n,) for n in names], "block long")  # at most one per query
        some = index.blocks.select("block", "rows").join(F.broadcast(wanted), "block", "left_semi")
        found = some.mapInPandas(run, "query int, similarity double").toPandas()
        out[found["query"]] = found["similarity"]
    return out


def _products(queries: np.ndarray, rows: bytes) -> np.ndarray:
    return queries @ np.frombuffer(rows).reshape(-1, queries.shape[1]).T


def _scores(queries: np.ndarray, rows: bytes) -> np.ndarray:
    return np.round(_products(queries, rows), TIE_DECIMALS)


def _answers(index: Index, held: Broadcast, reached: np.ndarray, schema: str) -> DataFrame:
    """Of every task the k best rows per query, and one row of counts."""
    sent = index.blocks.sparkSession.sparkContext.broadcast(reached)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, far, zero, names, k = held.value
        edge, best, pairs, done = sent.value.copy(), None, 0, 0
        fresh: list[pd.DataFrame] = []

        def merge() -> None:
            nonlocal best
            if not fresh:
                return
            best = _first_k(pd.concat([*([] if best is None else [best]), *fresh], ignore_index=True), k)
            fresh.clear()
            full = best.groupby("query")["similarity"].agg(["size", "min"])
            full = full[full["size"] >= k]
            edge[full.index] = np.maximum(edge[full.index], full["min"])

        for batch in batches:
            for pivot, low, high, ids, rows in batch.itertuples(index=False):
                able = np.flatnonzero(_most_similar(far, zero, pivot, low, high) >= edge - SLACK)
                pairs, done = pairs + len(far), done + len(able)
                if not len(able):
                    continue
                new = _at_least(matrix[able], rows, able, np.asarray(ids), edge[able], k)
                if len(new):
                    fresh.append(new)
                # Edges rise where answers are merged, so it is done once they are as many as the answers.
                if sum(map(len, fresh)) >= k * len(far):
                    merge()
        merge()
        if best is not None:
            yield pd.DataFrame({
                "query_id": names[best["query"].to_numpy()], "case_id": best["id"].to_numpy(),
                "similarity": best["similarity"].to_numpy(), "pairs": None, "multiplied": None,
            })
        yield pd.DataFrame({"query_id": [None], "case_id": [None], "similarity": [None], "pairs": [pairs], "multiplied": [done]})

    return index.blocks.select("pivot", "low", "high", "ids", "rows").mapInPandas(run, schema)


def search(index: Index, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS) -> tuple[DataFrame, DataFrame]:
    """Exact top ``k`` per query (query_id, case_id, similarity, rank), and the counts
    (pairs of a query and a block, those multiplied)."""
    spark, dim = queries.sparkSession, index.pivots.shape[1]
    kind = dict(queries.dtypes)["query_id"]
    schema = f"query_id {kind}, case_id {index.id_type}, similarity double, pairs long, multiplied long"
    asked = stored(_units(queries, "query_id").filter(F.size("v") == dim), "queries")
    blocks = max(1, -(-asked.count() // query_rows))
    path = scratch_path(spark, "answers")
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if own.empty:
            continue
        matrix = _matrix(own["v"], dim)
        far, zero = _far(matrix, index.pivots)
        held = spark.sparkContext.broadcast((matrix, far, zero, own["id"].to_numpy(), k))
        reached = _reached(index, held, _promising(index, held))
        _answers(index, held, reached, schema).write.mode("append").parquet(path)
    every = spark.read.schema(schema).parquet(path)
    by_query = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("case_id"))
    hits = every.filter("pairs IS NULL").drop("pairs", "multiplied")
    hits = hits.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    counts = every.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("multiplied"), F.lit(0)).alias("multiplied"))
    return hits, counts
