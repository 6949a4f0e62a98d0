import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.functions import vectors as V
from casemill.operators import embed, similar
from casemill.sources import readers, writers


def frame(spark, matrix, key="case_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{key} bigint, embedding array<float>")


def test_unit_vectors_and_zero(spark):
    df = frame(spark, [[3, 4], [0, 0], [-2, 0]])
    found = [r["embedding"] for r in similar.normalize(df).orderBy("case_id").collect()]
    assert found[0] == pytest.approx([0.6, 0.8])
    assert found[1] == [0.0, 0.0] and found[2] == [-1.0, 0.0]
    again = [r["embedding"] for r in similar.normalize(similar.normalize(df)).orderBy("case_id").collect()]
    assert again[0] == pytest.approx(found[0], abs=1e-6)


def test_norm_is_computed_once_per_row(spark):
    plan = similar.normalize(frame(spark, [[1, 2]]))._jdf.queryExecution().optimizedPlan().toString()
    # Once in the test for zero and once as the divisor, never inside the element lambda.
    assert plan.count("aggregate(") <= 2


def brute_force(corpus, queries, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n == 0, 1, n)

    scores = np.round(unit(queries) @ unit(corpus).T, similar.TIE_DECIMALS)
    return {
        (q, int(i)): r + 1
        for q in range(len(queries))
        for r, i in enumerate(np.lexsort((np.arange(len(corpus)), -scores[q]))[:k])
    }


@pytest.mark.parametrize("max_broadcast,block_rows", [(1000, 4096), (1000, 7), (0, 16)])
def test_nearest_equals_brute_force(spark, max_broadcast, block_rows):
    rng = np.random.default_rng(5)
    corpus = rng.normal(size=(90, 6)).astype("float32")
    corpus[10:40] = corpus[10]  # a third of the rows are copies
    corpus[50] = 0
    queries = np.vstack([corpus[8:14], rng.normal(size=(20, 6))]).astype("float32")
    found = similar.nearest(
        frame(spark, corpus), frame(spark, queries, "query_id"), 4, block_rows, max_broadcast
    ).collect()
    assert {(r["query_id"], r["case_id"]): r["rank"] for r in found} == brute_force(
        corpus.astype("float64"), queries.astype("float64"), 4
    )
    assert all(-1 <= r["similarity"] <= 1 for r in found)


def test_nearest_without_rows(spark):
    some = frame(spark, [[1.0, 0.0]])
    none = frame(spark, [], "query_id")
    assert similar.nearest(some, none).count() == 0
    assert similar.nearest(frame(spark, []), frame(spark, [[1.0]], "query_id")).count() == 0


def test_join_by_key(spark):
    vectors = frame(spark, [[1.0], [2.0]])
    tickets = spark.createDataFrame([(1,), (5,)], "case_id bigint")
    joined = similar.join_vectors(tickets, vectors).collect()
    assert [(r["case_id"], r["embedding"]) for r in joined] == [(1, [2.0])]
    assert similar.unmatched(tickets, vectors) == 1


def test_vector_files(spark, tmp_path):
    path = str(tmp_path / "v.parquet")
    writers.write_vectors(frame(spark, [[3, 4], [1, 0]]), path)
    held = readers.read_vectors(spark, path, 2)
    assert held.dtypes == [("case_id", "string"), ("embedding", "array<float>")]
    assert held.filter("case_id = '0'").head()["embedding"] == pytest.approx([0.6, 0.8])
    with pytest.raises(Exception, match="3 elements"):
        readers.read_vectors(spark, path, 3).collect()


def test_tfidf_vectors(spark):
    docs = spark.createDataFrame(
        [("1", "radio drops radio"), ("2", "screen dark"), ("3", "Radio DROPS radio!"), ("4", "")],
        "case_id string, text string",
    )
    vectors = embed.embed_tfidf(docs, embed.fit_tfidf(docs, 64))
    found = {r["case_id"]: np.array(r["embedding"]) for r in vectors.collect()}
    assert vectors.dtypes[1] == ("embedding", "array<float>")
    assert len(found["1"]) == 64
    assert found["1"] == pytest.approx(found["3"]) and np.linalg.norm(found["1"]) == pytest.approx(1)
    assert abs(found["1"] @ found["2"]) < 1 and not found["4"].any()


def test_model_hook(spark):
    def make():
        def predict(texts):
            return np.array([[len(t), t.count("a")] for t in texts], dtype="float32")

        return predict

    docs = spark.createDataFrame([("1", "banana"), ("2", "x")], "case_id string, text string")
    found = {r["case_id"]: r["embedding"] for r in embed.embed_with(docs, make).collect()}
    assert found == {"1": [6.0, 3.0], "2": [1.0, 0.0]}


def test_composite_text_prefers_the_masked_column(spark):
    df = spark.createDataFrame(
        [("1", None, "raw", " d \n")], "case_id string, subject_redacted string, subject string, description string"
    )
    assert embed.texts(df).head()["text"] == "d"
    assert embed.texts(df.drop("subject_redacted")).head()["text"] == "raw\n d"


def test_inner_product(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<float>, b array<float>")
    assert df.select(V.inner_product(F.col("a"), F.col("b")).alias("d")).head()["d"] == 11.0


def test_workers_need_no_copy_of_the_package(tmp_path):
    """From another working folder, with the package known to the driver alone."""
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    script = f"""
import sys
sys.path.insert(0, {str(repo)!r})
from casemill.operators import similar
from casemill.session import build_session
spark = build_session("away", "local[2]", **{{"spark.ui.enabled": "false", "spark.checkpoint.dir": {str(tmp_path)!r}}})
rows = [(f"c{{i}}", [float(i == j) for j in range(4)]) for i in range(4)]
held = spark.createDataFrame(rows, "case_id string, embedding array<float>")
asked = held.withColumnRenamed("case_id", "query_id")
assert similar.nearest(held, asked, 1).count() == 4
"""
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
