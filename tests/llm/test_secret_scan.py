import random

from pyspark.sql import functions as F

from casemill.llm import secret_scan as S
from casemill.session import stored


def corpus(seed=2):
    rng = random.Random(seed)
    rows, truth = [], {}
    words = ["river", "stone", "lamp", "walk", "under", "green", "house", "night"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for i in range(240):
        begin = say(6)
        if i % 3 == 0:
            lead, value, secret = 'token = "', "".join(rng.choice("0123456789abcdef") for _ in range(40)), 1
        elif i % 3 == 1:
            lead, value, secret = "see http://site.org/", "/".join(rng.choice(words) for _ in range(5)), 0
        else:
            lead, value, secret = "", "".join(rng.choice(words) for _ in range(5)), 0
        start = len(begin) + 1 + len(lead)
        rows.append((i, f"{begin} {lead}{value}\" {say(5)}"))
        truth[i, start] = secret
    return rows, truth


def test_held_out_findings(spark):
    rows, truth = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    found = stored(S.candidates(docs))
    assert {(r["k"], r["start"]) for r in found.collect()} >= {k for k, s in truth.items() if s}
    labels = spark.createDataFrame([(k, s, y) for (k, s), y in truth.items() if k % 4], "k long, start long, secret int")
    scored = {(r["k"], r["start"]): r["score"] for r in S.score(found, labels).collect()}
    held = [(scored[key], y) for key, y in truth.items() if key[0] % 4 == 0 and key in scored]
    assert len(held) > 30 and all((s >= 0.5) == bool(y) for s, y in held)
    assert "text" not in found.columns and found.filter(F.length("value") != 64).isEmpty()


def test_features_of_the_place():
    import numpy as np

    pairs, known = np.zeros((27, 27)), frozenset({"river", "stone"})
    value = "riverstone/0123456789"
    one = S.describe(f"see http://x/{value}", 13, value, pairs, known)
    assert one[0] == len(value) and one[8] == 10 / len(value)
    assert S._covered("xxriverx", known) == 5 / 8
    assert len(one) == len(S.describe(value, 0, value, pairs, known)) == 19 + 2 * S.HASHED


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(None, "k " + "a1" * 20), (1, None), (1, ""), (2, "b2" * 4000)], "doc_id long, text string")
    found = stored(S.candidates(docs))
    assert sorted(r["length"] for r in found.collect()) == [40, 8000]
    none = spark.createDataFrame([], "k long, start long, secret int")
    assert {r["score"] for r in S.score(found, none).collect()} == {0.0}
    one = spark.createDataFrame([(2, 0, 1), (2, 0, 0)], "k long, start long, secret int")
    assert {r["score"] for r in S.score(found, one).collect()} == {1.0}
    assert S.candidates(docs.limit(0)).count() == 0
