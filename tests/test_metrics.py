import math
import random
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casemill.operators import metrics
from casemill.plans import reports

SCHEMA = "current_category string, predicted_code string, model_strategy string, confidence double"
ROWS = [
    ("a", "a", "rules", 0.9),
    ("a", "a", "rules", 0.7),
    ("a", "b", "ml_model", 0.8),
    ("b", "b", "ml_model", 0.75),
    ("b", "c", "rules", 0.2),
    ("c", None, "none", 0.0),
    ("", "a", "rules", 0.5),
    (None, "a", "rules", 1.0),
]


@pytest.fixture(scope="module")
def classified(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_counts_fall_and_nulls_drop(classified):
    assert [tuple(r) for r in metrics.strategy_counts(classified).collect()] == [
        ("rules", 5), ("ml_model", 2), ("none", 1),
    ]
    assert [tuple(r) for r in metrics.category_counts(classified).collect()] == [("a", 4), ("b", 2), ("c", 1)]


def test_top_categories_tell_how_many_more(classified):
    rows = metrics.top_categories(classified, 2).collect()
    assert [(r["value"], r["rank"], r["more"]) for r in rows] == [("a", 1, 1), ("b", 2, 1)]


def test_shares(classified):
    found = {r["value"]: r["share"] for r in metrics.shares(metrics.strategy_counts(classified)).collect()}
    assert found == {"rules": 62.5, "ml_model": 25.0, "none": 12.5}


def test_coverage(classified):
    row = metrics.coverage_by_strategy(classified).head()
    assert tuple(row) == (8, 7, 87.5)
    row = metrics.coverage_by_code(classified).head()
    assert tuple(row) == (8, 7, 1, 87.5)
    assert tuple(metrics.high_confidence(classified).head()) == (8, 5, 62.5)
    assert tuple(metrics.outcome_counts(classified).head()) == (8, 5, 2, 1)


def test_empty_table_has_zero_coverage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(metrics.coverage_by_strategy(empty).head()) == (0, 0, 0.0)
    assert metrics.describe(empty).head()["count"] == 0
    assert metrics.quantiles(empty, "confidence", max_rows=0).head()["n"] == 0
    assert metrics.confusion_dense(metrics.confusion(empty)).count() == 0


def test_describe_matches_arithmetic(classified):
    values = [r[3] for r in ROWS]
    row = metrics.describe(classified).head()
    quartiles = statistics.quantiles(values, n=4, method="inclusive")
    assert row["count"] == 8
    assert row["mean"] == pytest.approx(statistics.mean(values))
    assert row["std"] == pytest.approx(statistics.stdev(values))
    assert [row["p25"], row["p50"], row["p75"]] == pytest.approx(quartiles)
    assert (row["min"], row["max"]) == (0.0, 1.0)


def test_one_row_has_no_deviation(spark):
    row = metrics.describe(spark.createDataFrame([(0.5,)], "confidence double")).head()
    assert row["std"] is None and row["p25"] == row["max"] == 0.5


def test_published_sample_arithmetic(spark):
    values = [0.92] * 8 + [0.90] * 3 + [0.88] * 3 + [0.86] + [0.0] * 15
    row = metrics.describe(spark.createDataFrame([(v,) for v in values], "confidence double")).head()
    assert row["count"] == 30
    assert round(row["mean"], 3) == 0.452 and round(row["std"], 3) == 0.46


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.one_of(st.sampled_from([0.0, 0.5, 1.0]), st.floats(-5, 5, allow_nan=False)), min_size=1, max_size=60)
)
def test_two_pass_quantiles_are_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "confidence double")
    row = metrics.quantiles(df, "confidence", max_rows=0).head()
    wanted = statistics.quantiles(values, n=4, method="inclusive") if len(values) > 1 else values * 3
    assert [row["q0"], row["q1"], row["q2"]] == pytest.approx(wanted, abs=1e-12)


def test_two_pass_quantiles_on_many_rows_with_a_hot_value(spark):
    df = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, 0.99).otherwise(F.rand(7)).alias("confidence")
    )
    df = df.withColumn("confidence", F.round("confidence", 9))
    short = metrics.quantiles(df, "confidence", probs=(0.01, 0.25, 0.5, 0.75, 0.999)).head()
    long = metrics.quantiles(df, "confidence", probs=(0.01, 0.25, 0.5, 0.75, 0.999), max_rows=0).head()
    assert tuple(short) == pytest.approx(tuple(long), abs=1e-12)


def test_histogram_puts_one_in_the_last_bin(classified):
    bins = {r["bin"]: r["n"] for r in metrics.histogram(classified).collect()}
    assert bins == {0: 1, 2: 1, 5: 1, 7: 2, 8: 1, 9: 2}


def test_confusion_and_scores(classified):
    cells = metrics.confusion(classified)
    assert {tuple(r) for r in cells.collect()} == {("a", "a", 2), ("a", "b", 1), ("b", "b", 1), ("b", "c", 1)}
    assert [r["label"] for r in metrics.confusion_labels(cells).collect()] == ["a", "b", "c"]
    dense = metrics.confusion_dense(cells).collect()
    assert len(dense) == 9 and sum(r["n"] for r in dense) == 5
    wide = {r["y_true"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_wide(cells).collect()}
    assert wide == {"a": (2, 1, 0), "b": (0, 1, 1), "c": (0, 0, 0)}
    assert tuple(metrics.accuracy(cells).head()) == (0.6, 5)
    scores = {r["label"]: r for r in metrics.per_label(cells).collect()}
    assert (scores["a"]["precision"], scores["a"]["support"]) == (1.0, 3)
    assert scores["a"]["recall"] == pytest.approx(2 / 3) and scores["a"]["f1"] == pytest.approx(0.8)
    assert (scores["c"]["precision"], scores["c"]["recall"], scores["c"]["f1"], scores["c"]["support"]) == (0, 0, 0, 0)
    weighted = metrics.weighted_scores(cells).head()
    assert tuple(weighted) == pytest.approx((0.8, 0.6, 0.68))
    report = {r["label"]: r for r in metrics.class_report(cells).collect()}
    assert report["accuracy"]["f1"] == pytest.approx(0.6)
    assert report["macro avg"]["precision"] == pytest.approx(0.5)
    assert report["weighted avg"]["recall"] == pytest.approx(0.6)
    assert report["macro avg"]["support"] == 5


labels = st.sampled_from(["x", "y", "z", "", None])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(labels, labels), min_size=1, max_size=40))
def test_confusion_sums_to_the_evaluable_rows(spark, pairs):
    df = spark.createDataFrame([(t, p, "rules", 0.5) for t, p in pairs], SCHEMA)
    wanted = sum(1 for t, p in pairs if t and p is not None)
    cells = metrics.confusion(df)
    assert sum(r["n"] for r in metrics.confusion_dense(cells).collect()) == wanted
    assert sum(r["support"] for r in metrics.per_label(cells).collect()) == wanted


def test_summary_and_evaluation_reports(spark, classified):
    summary = reports.summary_report(classified).head()
    assert summary["metadata"].asDict() | {"generated_at": ""} == {
        "generated_at": "", "total_tickets": 8, "classified_tickets": 7, "coverage_percentage": 87.5,
        "high_confidence_predictions": 5, "high_confidence_percentage": 62.5,
    }
    written = reports.summary_report(classified).select(
        F.to_json("strategy_breakdown").alias("s"), F.map_keys("confidence_statistics").alias("k")
    ).head()
    assert written["s"] == '{"rules":5,"ml_model":2,"none":1}'
    assert written["k"] == ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    assert math.isclose(summary["confidence_statistics"]["max"], 1.0)
    evaluation = reports.evaluation_report(classified).head()
    assert evaluation["metadata"]["evaluation_type"] == "confusion_matrix"
    assert evaluation["coverage_metrics"]["unclassified_tickets"] == 1
    quality = evaluation["confusion_metrics"]
    assert (quality["accuracy"], quality["f1_score"], quality["support"]) == (0.6, 0.68, 5)
    assert quality["labels"] == ["a", "b", "c"]
    assert quality["confusion_matrix"] == [[2, 1, 0], [0, 1, 1], [0, 0, 0]]
    assert quality["classification_report"]["macro avg"]["support"] == 5
    bare = reports.evaluation_report(classified.drop("current_category")).head()
    assert bare["metadata"]["evaluation_type"] == "coverage_only"
    untrue = classified.withColumn("current_category", F.lit(None).cast("string"))
    assert reports.evaluation_report(untrue).head()["metadata"]["evaluation_type"] == "coverage_only"


def test_no_window_over_raw_rows(classified):
    physical = metrics.top_categories(classified)._jdf.queryExecution().executedPlan().toString()
    assert physical.index("HashAggregate") > physical.index("Window")
    assert "partial_count" in physical


def plain_quantile(values, p):
    ordered = sorted(values)
    place = p * (len(ordered) - 1)
    a, b = ordered[int(place)], ordered[min(int(place) + 1, len(ordered) - 1)]
    return a if a == b else a + (b - a) * (place - int(place))


@pytest.mark.parametrize("k", [8, 200])
def test_quantiles_of_groups_are_exact_whatever_the_sketch(spark, k):
    """Hot values, a hot group, a null group, a group of nulls, groups of one row."""
    rng = random.Random(k)
    groups = {"hot": 4000, "small": 30, "one": 1, None: 500}
    rows = [(g, rng.choice([7.0, rng.gauss(0, 100), float(rng.randrange(5))])) for g, n in groups.items() for _ in range(n)]
    rows += [("none", None)] * 3 + [("hot", None)] * 5
    probs = (0.0, 0.1, 0.5, 0.5001, 0.99, 1.0)
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "g string, v double, n double, key string").repartition(7)
    found = {r["g"]: r for r in metrics.grouped_quantiles(df, "v", probs, ["g"], k).collect()}
    for g in {r[0] for r in rows}:
        own = [v for h, v in rows if h == g and v is not None]
        got = [found[g][f"q{i}"] for i in range(len(probs))]
        assert found[g]["n"] == len(own)
        assert got == [None] * 6 if not own else got == pytest.approx([plain_quantile(own, p) for p in probs], abs=1e-9)
    whole = metrics.grouped_quantiles(df, "v", probs, k=k).collect()
    every = [v for _, v in rows if v is not None]
    assert len(whole) == 1 and [whole[0][f"q{i}"] for i in range(6)] == pytest.approx([plain_quantile(every, p) for p in probs])


def test_quantiles_by_two_columns_with_infinite_values(spark):
    inf = float("inf")
    rows = [("a", 1, inf), ("a", 1, -inf), ("a", 1, 2.0), ("a", None, float("nan")), ("b", 1, 5.0), ("b", 1, 5.0)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    found = {(r["a"], r["b"]): r["q0"] for r in metrics.grouped_quantiles(df, "v", (0.5,), ["a", "b"]).collect()}
    assert found == {("a", 1): 2.0, ("a", None): inf, ("b", 1): 5.0}
    assert metrics.grouped_quantiles(df.limit(0), "v", (0.5,), ["a"]).count() == 0
    empty = metrics.grouped_quantiles(df.limit(0), "v", (0.5,)).collect()
    assert [(r["n"], r["q0"]) for r in empty] == [(0, None)]
