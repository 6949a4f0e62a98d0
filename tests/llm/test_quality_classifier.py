import random

import numpy as np
import pyarrow as pa

from casemill.llm import quality_classifier as C

GOOD = "the quick brown fox jumps over a lazy dog while rivers run towards distant hills and towns".split()


def texts(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(GOOD) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 200))]
        kind = i % 4
        if kind == 1:
            words = [w + "***" for w in words]
        elif kind == 2:
            words = [w.upper() + "!!" for w in words]
        elif kind == 3 and i % 8 == 3:
            words = words[:6] * 20
        rows.append((i, " ".join(words), int(kind == 0 or (kind == 3 and i % 8 != 3))))
    return rows


def test_held_out_accuracy(spark):
    rows = texts(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = C.fit(docs, labels.filter(~C.held_out("doc_id")))
    held = [r["doc_id"] for r in docs.filter(C.held_out("doc_id")).collect()]
    score = {r["doc_id"]: r["score"] for r in C.score(docs, model).collect()}
    truth = {r[0]: r[2] for r in rows}
    right = sum((score[i] >= 0.5) == bool(truth[i]) for i in held)
    assert len(held) > 50 and right / len(held) > 0.95
    again = C.fit(docs.repartition(5), labels.filter(~C.held_out("doc_id")).repartition(3))
    assert np.array_equal(again.weights, model.weights)


def test_features_equal_a_plain_version():
    text = "Ab, ab AB\nx  é x x x y x x x y"
    rows, cols = C.features(pa.array([text, None, "", "a"]))
    assert (cols[rows == 1].size, cols[rows == 2].size) == (0, 0)
    kind = C._byte_kinds()[np.frombuffer(text.encode(), np.uint8)].astype(int)
    runs = {(a * 32 + b) * 32 + c for a, b, c in zip(kind, kind[1:], kind[2:], strict=False)}
    mine = set(cols[rows == 0].tolist())
    assert {c for c in mine if c < C._RUNS} == runs
    # Words ab, ab, ab, x, e, x ...: "ab," differs; distinct words and pairs, and one share.
    w = [t.lower() for t in text.split()]
    assert len([c for c in mine if C._RUNS <= c < C._RUNS + (C._HASHED >> 1)]) == len(set(w))
    assert len([c for c in mine if C._RUNS + (C._HASHED >> 1) <= c < C._RUNS + C._HASHED]) == len(set(zip(w, w[1:], strict=False)))
    assert len([c for c in mine if c >= C._RUNS + C._HASHED]) == 1


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ np.array([1.0, -2, 0.5, 0, 0]) + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    rows, cols = np.repeat(np.arange(60), 5), np.tile(np.arange(5), 60)
    w, b = C._descend(rows, cols, x.ravel(), y, 1.0, 400)

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w[:5], b)
    for _ in range(300):
        assert loss(w[:5] + 0.02 * rng.normal(size=5), b + 0.02 * rng.normal()) >= best - 1e-3


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame(
        [(None, "x y", 9.0), (1, None, 9.0), (1, "", 9.0), (2, "z" * 5000, 9.0)], "doc_id long, text string, score double"
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = C.score(docs, C.fit(docs, none)).collect()
    assert [r["score"] for r in rows] == [0.5] * 4
    one = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert all(0.5 < r["score"] < 1 for r in C.score(docs, C.fit(docs, one)).collect())
    assert C.score(docs.limit(0), C.fit(docs.limit(0), one)).count() == 0


def plain_scores(rows, learning):
    """The whole way from texts to scores by dictionaries: ratios, scaling, margins, curve."""
    feature_of = lambda t: set(C.features(pa.array([t]))[1].tolist())
    learnt = sorted((sorted(feature_of(t)), y) for i, t, y in rows if i in learning)
    # The order of the fit is that of the features' bytes.
    learnt.sort(key=lambda r: (np.array(r[0], np.uint32).tobytes(), r[1]))
    n1, n0 = sum(y for _, y in learnt), sum(1 - y for _, y in learnt)
    ratio = {}
    for f in range(1 << C.BITS):
        ratio[f] = -np.log(1 / (n0 + 2)) + np.log(1 / (n1 + 2))
    seen = {f for fs, _ in learnt for f in fs}
    held = [(set(fs), y) for fs, y in learnt]
    for f in seen:
        one, zero = sum(f in fs for fs, y in held if y), sum(f in fs for fs, y in held if not y)
        ratio[f] = np.log((one + 1) / (n1 + 2)) - np.log((zero + 1) / (n0 + 2))

    def scaled(fs):
        x = {f: ratio[f] for f in fs}
        length = np.sqrt(max(sum(v * v for v in x.values()), 1e-12))
        return {f: 4.0 * v / length for f, v in x.items()}

    def descend(some, epochs):
        w, b, alpha, order = {}, 0.0, [0.0] * len(some), np.random.default_rng(0)
        for _ in range(epochs):
            moved = 0.0
            for i in order.permutation(len(some)):
                x, s = some[i]
                g = s * (sum(w.get(f, 0.0) * v for f, v in x.items()) + b) - 1
                new = min(max(alpha[i] - g / (1 + sum(v * v for v in x.values())), 0.0), C.COST)
                step = (new - alpha[i]) * s
                for f, v in x.items():
                    w[f] = w.get(f, 0.0) + step * v
                b += step
                moved, alpha[i] = max(moved, abs(new - alpha[i])), new
            if moved < 1e-3 * C.COST:
                break
        return w, b

    margin = lambda m, x: sum(m[0].get(f, 0.0) * v for f, v in x.items()) + m[1]
    whole = [(scaled(fs), 1.0 if y else -1.0) for fs, y in learnt]
    folds = [descend([r for i, r in enumerate(whole) if i % 3 != f], C.EPOCHS // 3) for f in range(3)]
    slope, shift = C._curve(
        np.array([margin(folds[i % 3], x) for i, (x, _) in enumerate(whole)]), np.array([y > 0 for _, y in whole])
    )
    model = descend(whole, C.EPOCHS)
    return {i: 1 / (1 + np.exp(-(slope * margin(model, scaled(feature_of(t))) + shift))) for i, t, _ in rows}


def test_scores_equal_a_plain_version(spark):
    rows = texts(40, seed=3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 3], "doc_id long, quality int")
    found = {r["doc_id"]: r["score"] for r in C.score(docs, C.fit(docs, labels)).collect()}
    wanted = plain_scores(rows, {r[0] for r in rows if r[0] % 3})
    assert max(abs(found[i] - wanted[i]) for i in wanted) < 1e-4


def test_bounds_keep_whole_documents(spark):
    rows = texts(60, seed=5)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    pairs = len(C.features(pa.array([r[1] for r in rows]))[0])
    some = C.fit(docs, labels, fit_pairs=pairs // 2)
    assert some.weights.ndim == 2 and not np.array_equal(some.weights, C.fit(docs, labels).weights)
    assert C.fit(docs, labels, fit_pairs=0).weights.ndim == 1


def test_many_short_texts_need_little_memory():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(["a short text of some forty-five characters "] * 10_000)], names=["t"])
    tracemalloc.start()
    done = sum(len(C.features(slab.column("t"))[0]) > 0 for slab in C.X.slabs(batch, "t", C.SLAB, C.SLAB_ROWS))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert done == 25 and peak < 300e6
