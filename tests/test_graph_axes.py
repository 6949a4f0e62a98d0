import numpy as np
import pytest

from casemill.operators import clusters, graph_axes as G


def frame(spark, matrix):
    return spark.createDataFrame([(f"c{i:04d}", [float(x) for x in v]) for i, v in enumerate(matrix)], "case_id string, embedding array<float>")


def bent(n=240, seed=0, dim=24):
    """A closed curve that winds through all dimensions, so that no five lines show it."""
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    waves = np.concatenate([[np.cos(k * t), np.sin(k * t)] for k in range(1, dim // 2 + 1)]).T
    return (waves + 0.02 * rng.normal(size=(n, dim))).astype("float32")


def dense(graph):
    m = np.zeros((len(graph.ids),) * 2)
    m[graph.a, graph.b] = graph.weight
    return m


def plain_graph(matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit.astype(float) @ unit.T.astype(float), G.TIE_DECIMALS)
    out = np.zeros_like(scores)
    for i in range(len(matrix)):
        order = [j for j in sorted(range(len(matrix)), key=lambda j: (-scores[i, j], j)) if j != i][:k]
        out[i, order] = np.maximum(scores[i, order], G.LEAST)
    return (out + out.T) / 2


def test_graph_equals_all_pairs(spark):
    matrix = bent(90)
    matrix[20:40] = matrix[20]
    found = dense(G.landmark_graph(frame(spark, matrix).repartition(3), 7))
    assert np.allclose(found, plain_graph(matrix.astype(float), 7), atol=1e-6) and (found == found.T).all()


def test_axes_equal_those_of_the_whole_matrix(spark):
    graph = G.landmark_graph(frame(spark, bent(150)), 10)
    found = G.axes(graph, 5)
    m = dense(graph)
    scale = 1 / np.sqrt(m.sum(axis=1))
    value, vector = np.linalg.eigh(m * scale[:, None] * scale)
    assert np.allclose(found.value, value[::-1][1:6], atol=1e-9)
    for i in range(5):
        assert np.linalg.norm(m * scale[:, None] * scale @ found.vector[:, i] - found.value[i] * found.vector[:, i]) < 1e-6


def kept(matrix, points, k=10):
    """Share of each row's nearest that stay among its nearest."""
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    before = np.argsort(-(unit @ unit.T), axis=1)[:, 1 : k + 1]
    far = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    after = np.argsort(far, axis=1)[:, 1 : k + 1]
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(before, after)])


def points_of(df):
    return np.array([r["point"] for r in df.orderBy("case_id").collect()])


def test_neighbours_are_kept_better_than_by_a_projection(spark):
    matrix = bent(240)
    df = frame(spark, matrix)
    graph, plain = kept(matrix, points_of(G.reduce_graph(df))), kept(matrix, points_of(clusters.reduce_pca(df)))
    assert graph > 0.7 and graph > plain + 0.1


def test_residuals_by_joins_and_the_same_in_every_run(spark):
    df = frame(spark, bent(200, 3))
    graph = G.landmark_graph(df)
    found = G.axes(graph)
    points = G.reduce_graph(df)
    left = G.residuals(G.links(spark, graph), points, found.value).collect()
    assert [r["axis"] for r in left] == list(range(5)) and max(r["residual"] for r in left) < 1e-5
    assert np.array_equal(points_of(points), points_of(G.reduce_graph(df.repartition(5))))


def test_vectors_beyond_the_landmarks_are_placed_among_them(spark):
    matrix = bent(300, 4)
    df = frame(spark, matrix)
    some = G.reduce_graph(df, landmarks=100)
    points = points_of(some)
    assert len(points) == 300 and np.isfinite(points).all() and kept(matrix, points) > 0.5
    own = set(G.landmark_graph(df, landmarks=100).ids)
    assert len(own) == 100


def test_groups_without_links_between_them(spark):
    rng = np.random.default_rng(5)
    matrix = np.repeat(np.eye(3, 12), 40, axis=0) + 0.01 * rng.normal(size=(120, 12))
    points = points_of(G.reduce_graph(frame(spark, matrix)))
    centre = np.array([points[i * 40 : i * 40 + 40].mean(axis=0) for i in range(3)])
    wide = max(points[i * 40 : i * 40 + 40, :2].std(axis=0).max() for i in range(3))
    assert min(np.linalg.norm(centre[i, :2] - centre[j, :2]) for i, j in ((0, 1), (0, 2), (1, 2))) > 10 * wide


@pytest.mark.parametrize("n", [0, 1, 2, 3, 6])
def test_few_vectors(spark, n):
    rows = G.reduce_graph(frame(spark, bent(n + 1)[:n])).collect()
    assert len(rows) == n and all(len(r["point"]) == 5 and np.isfinite(r["point"]).all() for r in rows)


def test_odd_vectors(spark):
    rows = [(f"c{i}", [float(x) for x in v]) for i, v in enumerate(bent(30))] + [("zero", [0.0] * 24), ("null", None), ("short", [1.0]), ("empty", [])]
    found = {r["case_id"]: r["point"] for r in G.reduce_graph(spark.createDataFrame(rows, "case_id string, embedding array<float>")).collect()}
    assert found["zero"] == [0.0] * 5 and not {"null", "short", "empty"} & set(found) and len(found) == 31


def test_links_of_every_vector_whatever_the_number_of_landmarks(spark, monkeypatch):
    from casemill.plans import registry_scale as Q

    matrix = bent(90)
    matrix[20:40] = matrix[20]
    rows = frame(spark, np.vstack([matrix, 0 * matrix[:1]])).repartition(3)
    monkeypatch.setattr(Q.A, "vectors", lambda *_: rows)
    monkeypatch.setattr(G.landmark_graph, "__defaults__", (G.NEIGHBOURS, 30))
    wanted = plain_graph(matrix.astype(float), G.NEIGHBOURS)
    found = np.zeros_like(wanted)
    for r in Q.neighbour_graph(spark, "").collect():
        found[int(r["a"][1:]), int(r["b"][1:])] = r["weight"]
    assert np.allclose(found, wanted, atol=2e-6)
