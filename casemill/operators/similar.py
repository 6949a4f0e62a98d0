"""Keyed joins to vectors and exact nearest-vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions import vectors as V
from casemill.operators import skipping
from casemill.session import fits, spread

# Up to this many query vectors are sent to every executor as one matrix.
BROADCAST_QUERIES = 4_096

# Rows scored at a time, which bounds the score matrix of a task.
BLOCK_ROWS = 4_096

# Scores equal to this many decimals count as ties and go to the smaller id.
TIE_DECIMALS = 9


def join_vectors(tickets: DataFrame, vectors: DataFrame, how: str = "inner") -> DataFrame:
    """Attach vectors by ``case_id``, never by position."""
    return tickets.join(vectors.select("case_id", "embedding"), "case_id", how)


def unmatched(tickets: DataFrame, vectors: DataFrame) -> int:
    """Tickets without a vector."""
    return tickets.select("case_id").join(vectors.select("case_id"), "case_id", "left_anti").count()


def normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.withColumn(column, V.unit(F.col(column)))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def _first_k(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query, ties to the smaller id."""
    ordered = found.sort_values(["query_id", "similarity", "case_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of one block for every query; all ties of the last are sorted out."""
    scores = np.round(queries @ rows.T, TIE_DECIMALS)
    last = max(0, scores.shape[1] - k)
    edge = np.partition(scores, last, axis=1)[:, last]
    asked, found = np.nonzero(scores >= edge[:, None])
    return _first_k(
        pd.DataFrame(
            {"query_id": query_ids[asked], "case_id": ids[found], "similarity": scores[asked, found]}
        ),
        k,
    )


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    max_broadcast: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Exact top ``k`` corpus rows per query by cosine similarity.

    ``corpus`` has (case_id, embedding), ``queries`` has (query_id, embedding). Each
    task multiplies blocks of unit vectors and hands on k rows per query, so no
    table of all pairs exists. A short query set is sent to all tasks, which read the
    corpus where it lies. For a long one the corpus is indexed once (``skipping``), and
    blocks that cannot hold an answer are not multiplied.
    """
    id_type = dict(corpus.dtypes)["case_id"]
    query_type = dict(queries.dtypes)["query_id"]
    out_schema = f"query_id {query_type}, case_id {id_type}, similarity double"
    unit_corpus = spread(corpus, "case_id").select("case_id", V.unit(F.col("embedding"), "double").alias("embedding"))
    unit_queries = queries.select("query_id", V.unit(F.col("embedding"), "double").alias("embedding"))
    if fits(queries, max_broadcast):
        found = _against_all_queries(unit_corpus, unit_queries, k, block_rows, out_schema)
    else:
        return skipping.search(skipping.build(corpus, block_rows=min(block_rows, skipping.BLOCK_ROWS)), queries, k)[0]
    by_query = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("case_id"))
    return found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)


def _against_all_queries(
    corpus: DataFrame, queries: DataFrame, k: int, block_rows: int, out_schema: str
) -> DataFrame:
    held = queries.toPandas()
    if held.empty:
        return corpus.sparkSession.createDataFrame([], out_schema)
    shared = corpus.sparkSession.sparkContext.broadcast(
        (held["query_id"].to_numpy(), _matrix(held["embedding"]))
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        best = None
        for batch in batches:
            for start in range(0, len(batch), block_rows):
                block = batch.iloc[start : start + block_rows]
                new = _best(query_ids, matrix, block["case_id"].to_numpy(), _matrix(block["embedding"]), k)
                best = new if best is None else _first_k(pd.concat([best, new], ignore_index=True), k)
        if best is not None:
            yield best

    return corpus.mapInPandas(score, out_schema)
