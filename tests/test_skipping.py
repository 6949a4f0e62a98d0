import numpy as np
import pytest

from casemill.operators import similar
from casemill.operators import skipping as S


def frame(spark, matrix, key="case_id", name=int):
    rows = [(name(i), [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} {'string' if name is str else 'bigint'}, embedding array<float>")


def clusters(n, seed=0, dim=16, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return (centre[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))).astype("float32")


def brute_force(corpus, queries, k, name=int):
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    scores = np.round(unit(queries.astype(float)) @ unit(corpus.astype(float)).T, S.TIE_DECIMALS)
    ids = np.array([name(i) for i in range(len(corpus))])
    return {
        (name(q), ids[i]): r + 1 for q in range(len(queries)) for r, i in enumerate(np.lexsort((ids, -scores[q]))[:k])
    }


def ranks(hits):
    return {(r["query_id"], r["case_id"]): r["rank"] for r in hits.collect()}


@pytest.mark.parametrize(("pivots", "block_rows", "query_rows"), [(16, 32, 4096), (3, 7, 20), (1, 4096, 4096), (64, 1, 50)])
def test_equals_all_pairs(spark, pivots, block_rows, query_rows):
    corpus = clusters(260)
    corpus[40:120] = corpus[40]  # copies fill blocks of their own
    corpus[200:204] = 0
    queries = np.vstack([corpus[30:60], clusters(20, 1), np.zeros((2, 16), "float32")])
    index = S.build(frame(spark, corpus), pivots, block_rows)
    assert index.blocks.selectExpr("sum(n)").head()[0] == 260
    assert index.blocks.selectExpr("max(n)").head()[0] <= block_rows
    hits, counts = S.search(index, frame(spark, queries, "query_id"), 4, query_rows)
    assert ranks(hits) == brute_force(corpus, queries, 4)
    assert counts.head()["pairs"] == index.blocks.count() * len(queries)


def test_most_blocks_are_skipped_where_vectors_form_groups(spark):
    corpus = clusters(2000, seed=2)
    index = S.build(frame(spark, corpus), 32, 64)
    hits, counts = S.search(index, frame(spark, corpus[:100], "query_id"), 3)
    assert ranks(hits) == brute_force(corpus, corpus[:100], 3)
    row = counts.head()
    assert row["multiplied"] < 0.25 * row["pairs"]


def test_nothing_is_lost_where_nothing_can_be_skipped(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(300, 40)).astype("float32")
    index = S.build(frame(spark, corpus), 20, 16)
    assert ranks(S.search(index, frame(spark, corpus[:60], "query_id"), 5)[0]) == brute_force(corpus, corpus[:60], 5)


def test_text_ids_more_answers_than_rows_and_ties(spark):
    corpus = np.repeat(np.eye(4, dtype="float32"), 3, axis=0)
    index = S.build(frame(spark, corpus, name=str), 4, 2)
    queries = np.eye(4, dtype="float32")
    for k in (2, 50):
        hits, _ = S.search(index, frame(spark, queries, "query_id", str), k)
        assert ranks(hits) == brute_force(corpus, queries, k, str)


def test_odd_rows_and_empty_sides(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [0.0, 1.0])]
    corpus = spark.createDataFrame(rows, "case_id bigint, embedding array<float>")
    index = S.build(corpus, 8, 8)
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, [1.0]), (9, None)], "query_id bigint, embedding array<float>")
    assert ranks(S.search(index, asked, 5)[0]) == {(7, 1): 1, (7, 3): 2}
    assert S.search(index, asked.limit(0), 5)[0].count() == 0
    empty = S.build(corpus.limit(0))
    assert S.search(empty, asked, 5)[0].count() == 0


def test_a_pivot_is_cut_by_distance_over_several_partitions(spark):
    corpus = clusters(500, seed=4, groups=1, spread=0.3)
    index = S.build(frame(spark, corpus).repartition(4), 1, 20)
    rows = index.blocks.select("pivot", "low", "high", "block").orderBy("low").collect()
    assert len({r["block"] >> 32 for r in rows}) > 1 and {r["pivot"] for r in rows} == {0}
    assert all(a["high"] <= b["low"] for a, b in zip(rows, rows[1:]))


def test_long_query_sets_go_through_the_index(spark):
    corpus = clusters(120, seed=5)
    found = similar.nearest(frame(spark, corpus), frame(spark, corpus, "query_id"), 3, max_broadcast=10)
    assert ranks(found) == brute_force(corpus, corpus, 3)


def test_a_block_below_the_edge_is_not_sorted(monkeypatch):
    rng = np.random.default_rng(1)
    rows, queries = rng.normal(size=(50, 4)), rng.normal(size=(6, 4))
    scores = np.round(queries @ rows.T, S.TIE_DECIMALS)
    edge = np.sort(scores, axis=1)[:, -3]

    def no_sort(*_):
        raise AssertionError("sorted")

    monkeypatch.setattr(S, "_best", no_sort)
    monkeypatch.setattr(S, "_first_k", no_sort)
    ids, asked = np.arange(100, 150), np.arange(10, 16)
    found = S._at_least(queries, rows.tobytes(), asked, ids, edge, 3)
    wanted = {(10 + q, 100 + r) for q, r in zip(*np.nonzero(scores >= edge[:, None]))}
    assert set(zip(found["query"], found["id"])) == wanted and len(wanted) == 18
