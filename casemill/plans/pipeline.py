"""The whole job, from a raw table to labels and reports."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.config import Config
from casemill.operators import calibrate, cascade, dedup, embed, export, hierarchy, learn, prepare, review, topics
from casemill.operators import redact as redaction
from casemill.operators import rules as R
from casemill.plans import reports
from casemill.session import spread, stored
from casemill.sources import readers, writers

log = logging.getLogger(__name__)

Embedder = Callable[[DataFrame], DataFrame]
Clusterer = Callable[[DataFrame], DataFrame]


def ingest(
    raw: DataFrame, staged_path: str, strict: bool = True, fields: Iterable[str] = prepare.RUN_FIELDS
) -> DataFrame:
    """Prepared, typed and deduplicated tickets from a raw table.

    The typed rows are stored once with their positions and hashes, so positions are
    fixed and the dedup pass reads two narrow columns. Only rows without an id need
    dense positions, which cost one more write.
    """
    spark = raw.sparkSession
    if "ingest_seq" in raw.columns:
        numbered = raw
    elif "case_id" in raw.columns:
        numbered = readers.with_ingest_seq(raw)
    else:
        numbered = prepare.row_positions(stored(raw, "raw"))
    prepared = prepare.prepare_tickets(numbered, fields=tuple(fields), position=F.col("ingest_seq"))
    prepare.require_essential(prepared)
    prepare.missing_optional(prepared)
    typed = dedup.with_content_hash(prepare.cast_types(prepared, strict))
    writers.write_parquet(typed, staged_path)
    return dedup.keep_first(spark.read.parquet(staged_path))


def redact_and_label(
    tickets: DataFrame,
    rules: Iterable[R.Rule],
    redact_pii: bool = True,
    tagger: redaction.Tagger | None = None,
) -> DataFrame:
    """Masked text and rule verdicts in one pass over the rows."""
    masked = redaction.redact(tickets, tagger=tagger) if redact_pii else tickets
    return R.apply_rules(masked, rules)


def tfidf_embedder(texts: DataFrame) -> DataFrame:
    return embed.embed_tfidf(texts, embed.fit_tfidf(texts))


def discover(
    tickets: DataFrame,
    vectors: DataFrame,
    config: Config,
    clusterer: Clusterer | None = None,
    order: str = "ingest_seq",
) -> tuple[DataFrame, DataFrame]:
    """Topic assignment and the one-row topic report."""
    cluster = clusterer or (
        lambda v: hierarchy.topics_by_hierarchy(v, config.min_cluster_size)
    )
    # Every table of the report reads the assignment, so the model runs once.
    assigned = stored(cluster(vectors).join(tickets.select("case_id", order), "case_id"), "topics")
    corpus = topics.corpus_texts(assigned, embed.texts(tickets), order=order)
    table = topics.topic_table(
        topics.topic_sizes(assigned),
        topics.topic_keywords(corpus, extra_stop_words=config.extra_stop_words),
        topics.topic_exemplars(assigned, order=order),
    )
    method = "density" if clusterer is None else getattr(clusterer, "__name__", "custom")
    return assigned, topics.topic_report(assigned, table, config.min_cluster_size, method)


def export_with_evaluation(classified: DataFrame, name: str, config: Config) -> dict[str, str | None]:
    """Labels as CSV and Parquet, the summary, then the evaluation.

    A failing evaluation is named under ``failed_stage``; the labels stay.
    """
    base = f"{config.reports_dir}/{name}"
    labels = export.clean_labels(classified)
    paths: dict[str, str | None] = {
        "csv_path": writers.write_csv(labels, f"{base}.csv"),
        "parquet_path": writers.write_parquet(labels, f"{base}.parquet"),
        "summary_json_path": writers.write_json_report(
            reports.summary_report(classified), f"{base}_summary.json"
        ),
        "evaluation_json_path": None,
    }
    try:
        paths["evaluation_json_path"] = writers.write_json_report(
            reports.evaluation_report(classified), f"{base}_evaluation.json"
        )
    except Exception as error:  # the labels are already written
        log.warning("Evaluation failed: %s", error)
        paths["failed_stage"] = "evaluation"
    return paths


def close_review(
    classified: DataFrame, corrections: DataFrame, taxonomy: DataFrame, config: Config, order: str | None = None
) -> dict[str, str]:
    """Apply a reviewer's corrections and store the result as training labels."""
    options = review.category_options(classified, taxonomy)
    corrected = review.apply_corrections(classified, corrections, options, order)
    return writers.write_training_labels(review.training_labels(corrected), config.reports_dir)


def run_pipeline(
    spark: SparkSession,
    raw: DataFrame | str,
    name: str,
    config: Config,
    rules: Iterable[R.Rule] = (),
    tagger: redaction.Tagger | None = None,
    embedder: Embedder | None = tfidf_embedder,
    clusterer: Clusterer | None = None,
    strict: bool = True,
    multiline: bool = True,
    calibrated: bool = False,
) -> dict[str, str | None]:
    """Prepare, ingest, redact, label, embed, discover, classify, export.

    ``raw`` is a table or a CSV path. Without an embedder there are no vectors, so
    topics and the trained model are left out and the rules decide alone. Turn
    ``multiline`` off to read large CSV files in parts; their fields then hold no line break.
    ``calibrated`` holds the threshold against confidence that out-of-fold scores have
    calibrated, at the price of a fit per fold.
    """
    if isinstance(raw, str):
        raw = readers.read_tickets_csv(spark, raw, multiline)
    paths: dict[str, str | None] = {}

    staged = f"{config.warehouse_dir}/{name}_staged.parquet"
    paths["warehouse"] = writers.write_parquet(
        ingest(raw, staged, strict), f"{config.warehouse_dir}/{name}.parquet"
    )
    warehouse = spread(spark.read.parquet(paths["warehouse"]), "case_id")

    labelled = redact_and_label(warehouse, rules, config.redact_pii, tagger)
    paths["with_rules"] = writers.write_parquet(
        labelled, f"{config.redacted_dir}/{name}_with_rules.parquet"
    )
    tickets = spark.read.parquet(paths["with_rules"])

    vectors = model = curve = None
    if embedder is not None:
        paths["embeddings"] = writers.write_vectors(
            embedder(embed.texts(tickets)), f"{config.models_dir}/{name}_embeddings.parquet"
        )
        vectors = readers.read_vectors(spark, paths["embeddings"])
        _, report = discover(tickets, vectors, config, clusterer)
        paths["topics"] = writers.write_json_report(report, f"{config.reports_dir}/{name}_topics.json")
        if learn.enough_labels(tickets):
            training = learn.training_set(tickets, vectors)
            training = stored(training, "training") if calibrated else training
            trained = learn.train(training)
            if trained is not None:
                curve = calibrate.fit_model(training) if calibrated else None
                paths["model"] = f"{config.models_dir}/{name}_classifier"
                trained.save(paths["model"])
                model = trained.model

    classified = cascade.classify(tickets, vectors, model, config.confidence_threshold, curve)
    paths["classified"] = writers.write_parquet(
        export.with_audit(classified), f"{config.redacted_dir}/{name}_classified.parquet"
    )
    written = spark.read.parquet(paths["classified"])
    paths.update(export_with_evaluation(written, name, config))
    return paths
