import json

import pytest
from pyspark.sql import functions as F

from casemill import schema
from casemill.config import Config
from casemill.operators import clusters
from casemill.operators import rules as R
from casemill.plans import pipeline
from casemill.sources import readers
from casemill.streaming import stateless

RULES = [
    R.Rule("R1", "radio", "AUDIO", "Audio", 0.9, rule_order=0),
    R.Rule("R2", "screen|display", "DISPLAY", "Display", 0.85, rule_order=1),
]

SUBJECTS = ["Radio noise", "Dark screen", "Slow boot", "Door rattles"]


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    """Sixty free-form rows without ids, one a repeat, one with personal data."""
    path = tmp_path_factory.mktemp("in") / "cases.csv"
    lines = ["Issue,Detail,current_category"]
    for i in range(60):
        kind = i % 4
        lines.append(f'{SUBJECTS[kind]},"{SUBJECTS[kind].lower()} number {"x" * (i + 1)}",cat{kind}')
    lines.append('RADIO NOISE,"radio noise number x",cat0')
    lines.append('Other display,"call 555-123-4567 or a@b.org\nsoon",')
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture(scope="module")
def finished(spark, source, tmp_path_factory):
    config = Config(min_cluster_size=2).under(str(tmp_path_factory.mktemp("out")))
    return pipeline.run_pipeline(
        spark, source, "cases", config, RULES, clusterer=lambda v: clusters.kmeans_topics(v, (3, 4), 2)
    )


def test_every_stage_is_written(spark, finished):
    assert None not in finished.values()
    warehouse = spark.read.parquet(finished["warehouse"])
    assert warehouse.count() == 61
    assert set(schema.ESSENTIAL_COLUMNS + schema.OPTIONAL_COLUMNS) <= set(warehouse.columns)
    assert dict(warehouse.dtypes)["created_at"] == "timestamp"
    first = warehouse.orderBy("ingest_seq").head()
    assert (first["case_id"], first["description"]) == ("TICKET_00000", "Radio noise | radio noise number x")
    assert warehouse.filter("case_id = 'TICKET_00060'").count() == 0


def test_text_is_masked(spark, finished):
    row = spark.read.parquet(finished["with_rules"]).filter("subject = 'Other display'").head()
    assert row["description_redacted"] == "Other display | call [PHONE] or [EMAIL]\nsoon"


def test_labels_and_strategies(spark, finished):
    labels = spark.read.parquet(finished["parquet_path"])
    assert labels.columns == list(schema.LABEL_COLUMNS)
    assert labels.count() == 61
    counts = {r["model_strategy"]: r["count"] for r in labels.groupBy("model_strategy").count().collect()}
    assert counts["rules"] == 31
    assert sum(counts.values()) == 61
    assert labels.filter("confidence >= 0.7").count() / 61 >= 0.5
    as_csv = readers.read_tickets_csv(spark, finished["csv_path"])
    assert as_csv.count() == 61 and as_csv.columns == labels.columns


def test_vectors_are_unit_and_keyed(spark, finished):
    vectors = readers.read_vectors(spark, finished["embeddings"], 384)
    assert vectors.select("case_id").distinct().count() == 61


def test_reports(spark, finished):
    topics = spark.read.json(finished["topics"]).head()
    assert topics["metadata"]["total_tickets"] == 61
    assert len(topics["topics"]) == topics["metadata"]["num_topics"] >= 1
    sizes = [t["size"] for t in topics["topics"]]
    assert sizes == sorted(sizes, reverse=True)
    summary = json.loads("\n".join(r["value"] for r in spark.read.text(finished["summary_json_path"]).collect()))
    assert summary["metadata"]["total_tickets"] == 61
    evaluation = spark.read.json(finished["evaluation_json_path"]).head()
    assert evaluation["metadata"]["evaluation_type"] == "confusion_matrix"


def test_switching_masking_off_uses_raw_text(spark, source, tmp_path):
    config = Config(redact_pii=False).under(str(tmp_path))
    paths = pipeline.run_pipeline(spark, source, "cases", config, RULES, embedder=None)
    table = spark.read.parquet(paths["with_rules"])
    assert "subject_redacted" not in table.columns
    assert "topics" not in paths and "model" not in paths
    kinds = {r["model_strategy"] for r in spark.read.parquet(paths["classified"]).select("model_strategy").collect()}
    assert kinds == {"rules", "none"}


def test_failed_evaluation_keeps_the_labels(spark, finished, tmp_path, monkeypatch):
    def broken(*_):
        raise RuntimeError("no metrics today")

    monkeypatch.setattr(pipeline.reports, "evaluation_report", broken)
    classified = spark.read.parquet(finished["classified"])
    paths = pipeline.export_with_evaluation(classified, "again", Config().under(str(tmp_path)))
    assert paths["evaluation_json_path"] is None
    assert spark.read.parquet(paths["parquet_path"]).count() == 61


def test_missing_essential_column_fails(spark, tmp_path):
    raw = spark.createDataFrame([("1", "s")], "case_id string, note string")
    with pytest.raises(ValueError, match="subject.*description"):
        pipeline.run_pipeline(spark, raw, "bad", Config().under(str(tmp_path)), RULES)


def test_extra_columns_pass_through(spark, tmp_path):
    raw = spark.createDataFrame([("1", "s", "d", "kept")], "case_id string, subject string, description string, `Main Category` string")
    staged = pipeline.ingest(raw, str(tmp_path / "staged.parquet"))
    row = staged.head()
    assert row["Main Category"] == "kept" and row["product_line"] == "kept"


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(300).select(
        F.col("id").cast("string").alias("case_id"),
        F.concat(F.lit("radio "), F.col("id")).alias("subject"),
        F.lit("mail a@b.org").alias("description"),
    )
    df.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    query = stateless.label_stream(stream, RULES, sink, str(tmp_path / "check"))
    query.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 300
    assert out.filter("predicted_code = 'AUDIO' and description_redacted = 'mail [EMAIL]'").count() == 300
