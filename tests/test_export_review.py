import re

import pytest
from pyspark.sql import functions as F

from casemill.operators import export, review
from casemill.schema import LABEL_COLUMNS

LABEL_SCHEMA = ", ".join(f"{c} {t}" for c, t in LABEL_COLUMNS.items())
STAMP = "2024-05-06T07:08:09.5"
DEFECTS = [
    ("1", "A", "Aye", -0.2, "rules", "1.0", "x", STAMP),
    ("2", "", "Bee", 1.3, "rules", "2.0", None, "2024-05-06"),
    ("3", None, None, None, "none", None, "x", "yesterday"),
    (None, "C", "Cee", 7.0, "rules", None, None, STAMP),
    ("5", "D", "Dee", 0.4, "ml_model", "1.0", "x", None),
]


@pytest.fixture(scope="module")
def defective(spark):
    return spark.createDataFrame(DEFECTS, LABEL_SCHEMA)


def test_cleaning(defective):
    out = export.clean_labels(defective)
    assert out.columns == list(LABEL_COLUMNS)
    rows = {r["case_id"]: r for r in out.collect()}
    assert set(rows) == {"1", "2", "3", "5"}
    assert [rows[i]["confidence"] for i in ("1", "2", "3", "5")] == [0.0, 1.0, None, 0.4]
    assert rows["2"]["predicted_code"] is None
    assert (rows["2"]["decided_by"], rows["3"]["version"]) == ("system", "1.0")
    assert rows["1"]["decided_at_utc"] == "2024-05-06T07:08:09.500000Z"
    assert rows["2"]["decided_at_utc"] == "2024-05-06T00:00:00.000000Z"
    assert rows["3"]["decided_at_utc"] == "yesterday"
    assert rows["5"]["decided_at_utc"] is None


def test_quality_counts(defective):
    row = export.quality_counts(defective).head().asDict()
    assert row == {
        "null_case_ids": 1, "invalid_confidence": 2, "empty_codes": 1,
        "missing_decided_by": 1, "missing_version": 1, "exported": 4,
    }


def test_absent_columns_become_null(spark):
    out = export.labels_projection(spark.createDataFrame([("1", 0.5)], "case_id string, confidence float"))
    assert [f"{n} {t}" for n, t in out.dtypes] == LABEL_SCHEMA.split(", ")
    assert out.head()["predicted_code"] is None


def test_audit_columns(spark):
    row = export.with_audit(spark.range(1)).head()
    assert (row["version"], row["decided_by"]) == ("1.0", "ensemble_classifier")
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", row["decided_at_utc"])


SCHEMA = (
    "ingest_seq bigint, case_id string, subject_redacted string, subject string, description string, "
    "predicted_code string, predicted_name string, confidence double, model_strategy string"
)
ROWS = [
    (3, "t3", "r" * 81, "raw", "d" * 301, "A", "Second name", 0.71, "rules"),
    (1, "t1", "short", "raw", "d" * 300, "A", "First name", 0.7, "rules"),
    (2, "t2", "s", "raw", "d", "B", "Bee", 0.4, "ml_model"),
    (4, "t4", "s", "raw", "d", None, None, 0.0, "none"),
]


@pytest.fixture(scope="module")
def decided(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def taxonomy(spark):
    return spark.createDataFrame(
        [("B", "Bee (official)", ""), ("Z", "Unused", "")], "code string, name string, description string"
    )


def test_queue_follows_input_order(decided):
    def ids(**kw):
        return [r["case_id"] for r in review.review_queue(decided, **kw).collect()]

    assert ids() == ["t1", "t2", "t3", "t4"]
    assert ids(limit=2) == ["t1", "t2"]
    assert ids(strategy="rules") == ["t1", "t3"]
    assert ids(strategy="All", min_confidence=0.4) == ["t1", "t2", "t3"]
    with pytest.raises(ValueError):
        review.review_queue(decided, limit=101)


def test_queue_is_a_top_n_not_a_sort(decided):
    physical = review.review_queue(decided)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in physical


def test_cards(decided):
    cards = {r["case_id"]: r for r in review.review_cards(decided).collect()}
    assert cards["t3"]["subject_line"] == "r" * 80 + "..."
    assert cards["t3"]["description_line"] == "d" * 300 + "..."
    assert cards["t1"]["description_line"] == "d" * 300
    assert [cards[t]["band"] for t in ("t3", "t1", "t2", "t4")] == ["green", "orange", "red", "red"]
    assert cards["t4"]["predicted_name"] == "N/A"


def test_options_take_first_name_then_taxonomy(spark, decided, taxonomy):
    found = {r["code"]: r["name"] for r in review.category_options(decided, taxonomy).collect()}
    assert found == {"A": "First name", "B": "Bee (official)", "Z": "Unused", "UNCLASSIFIED": "Unclassified"}
    none_left = decided.filter("predicted_code is not null")
    assert review.category_options(none_left, taxonomy).filter("code = 'UNCLASSIFIED'").count() == 1


def test_corrections(spark, decided, taxonomy):
    corrections = spark.createDataFrame(
        [("t2", "A", 1), ("t2", "Z", 2), ("t4", "NEW", 1), ("gone", "A", 1)],
        "case_id string, corrected_code string, at int",
    )
    options = review.category_options(decided, taxonomy)
    out = review.apply_corrections(decided, corrections, options, "at")
    assert out.columns == decided.columns
    rows = {r["case_id"]: (r["predicted_code"], r["predicted_name"], r["model_strategy"]) for r in out.collect()}
    assert rows == {
        "t1": ("A", "First name", "rules"),
        "t2": ("Z", "Unused", "ui_corrected"),
        "t3": ("A", "Second name", "rules"),
        "t4": ("NEW", "NEW", "ui_corrected"),
    }
    labels = review.training_labels(out)
    assert labels.columns == list(LABEL_COLUMNS)
    assert {r["decided_by"] for r in labels.collect()} == {"ui_review"}
    tickets = decided.select("case_id").withColumn("current_category", F.lit("old"))
    back = {r["case_id"]: r["current_category"] for r in review.as_categories(tickets, labels).collect()}
    assert back == {"t1": "old", "t2": "Z", "t3": "old", "t4": "NEW"}
    fresh = review.as_categories(decided.select("case_id"), labels.filter("case_id = 't1'"))
    assert {r["case_id"]: r["current_category"] for r in fresh.collect()}["t4"] is None


def test_long_lookup_side_is_salted_not_broadcast(spark, decided):
    from casemill.session import lookup

    names = spark.createDataFrame([("A", "x"), ("B", "y")], "predicted_code string, extra string")
    out = lookup(decided, names, ["predicted_code"], max_rows=1, salts=4)
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["case_id"], r["extra"]) for r in out.collect()} == {
        ("t1", "x"), ("t2", "y"), ("t3", "x"), ("t4", None),
    }


def test_sample_tickets(spark, decided):
    topics = spark.createDataFrame([(0, ["t1", "t2", "t3", "t4"])], "topic int, exemplar_case_ids array<string>")
    assert {r["case_id"] for r in review.sample_tickets(decided, topics).collect()} == {"t1", "t2", "t3"}


def test_what_is_not_a_number_is_no_confidence(spark):
    rows = spark.createDataFrame([("1", float("nan")), ("2", 0.9), ("3", 7.0)], "case_id string, confidence double")
    cleaned = {r["case_id"]: r["confidence"] for r in export.clean_labels(rows).collect()}
    assert cleaned == {"1": None, "2": 0.9, "3": 1.0}
    assert {r["case_id"] for r in review.review_filter(rows, None, 0.5).collect()} == {"2", "3"}


def test_two_codes_without_an_order_fail(spark):
    rows = spark.createDataFrame([("1", "A"), ("1", "B"), ("2", "C"), ("2", "C")], "case_id string, corrected_code string")
    fine = review.latest_corrections(rows.filter("case_id = '2'")).head()
    assert fine["corrected_code"] == "C"
    with pytest.raises(Exception, match="without an order"):
        review.latest_corrections(rows).collect()


def test_only_corrected_rows_become_truth(spark):
    tickets = spark.createDataFrame([("1", "old"), ("2", "old")], "case_id string, current_category string")
    labels = spark.createDataFrame(
        [("1", "new", "ui_corrected"), ("2", "guess", "rules")], "case_id string, predicted_code string, model_strategy string"
    )
    back = {r["case_id"]: r["current_category"] for r in review.as_categories(tickets, labels).collect()}
    assert back == {"1": "new", "2": "old"}
    every = {r["case_id"]: r["current_category"] for r in review.as_categories(tickets, labels, None).collect()}
    assert every == {"1": "new", "2": "guess"}
