"""Review of predictions and the way corrections come back as labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import scores, text
from casemill.operators import export
from casemill.session import lookup, settle

SUBJECT_CHARS = 80
DESCRIPTION_CHARS = 300
REVIEW_LIMIT = 20


def review_filter(df: DataFrame, strategy: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    kept = df if strategy in (None, "All") else df.filter(F.col("model_strategy") == strategy)
    return kept.filter(scores.at_least(F.col("confidence"), min_confidence))


def review_queue(
    df: DataFrame,
    strategy: str | None = None,
    min_confidence: float = 0.0,
    limit: int = REVIEW_LIMIT,
    order: str = "ingest_seq",
) -> DataFrame:
    """The first tickets, in input order, that pass the filters."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    return review_filter(df, strategy, min_confidence).orderBy(order).limit(limit)


def review_cards(df: DataFrame) -> DataFrame:
    """What a reviewer sees of each ticket."""
    return df.select(
        "case_id",
        text.truncate(text.preferred(df, "subject"), SUBJECT_CHARS).alias("subject_line"),
        text.truncate(text.preferred(df, "description"), DESCRIPTION_CHARS).alias("description_line"),
        F.coalesce("predicted_name", F.lit("N/A")).alias("predicted_name"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        scores.confidence_band(F.col("confidence")).alias("band"),
        "model_strategy",
    )


def category_options(df: DataFrame, taxonomy: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Codes to choose from: those in use under their first name, then the taxonomy.

    The taxonomy's name wins; an unclassified option is always there.
    """
    used = df.groupBy(scores.code_or_unclassified(F.col("predicted_code")).alias("code")).agg(
        F.min_by(scores.name_or_unclassified(F.col("predicted_name")), order).alias("used_name")
    )
    known = taxonomy.groupBy("code").agg(F.max("name").alias("known_name"))
    always = df.sparkSession.range(1).select(
        F.lit(scores.UNCLASSIFIED_CODE).alias("code"),
        F.lit(scores.UNCLASSIFIED_NAME).alias("fallback_name"),
    )
    merged = used.join(known, "code", "full").join(always, "code", "full")
    return merged.select("code", F.coalesce("known_name", "used_name", "fallback_name").alias("name"))


def latest_corrections(corrections: DataFrame, order: str | None = None) -> DataFrame:
    """One code per ticket: the last one in the given order.

    Without an order a ticket with two different codes fails the job.
    """
    if order:
        chosen = F.max_by("corrected_code", order)
    else:
        two = F.raise_error(F.concat(F.lit("corrections without an order name two codes for "), F.first("case_id")))
        chosen = F.when(F.min("corrected_code") == F.max("corrected_code"), F.max("corrected_code")).when(
            F.count("corrected_code") > 0, two.cast("string")
        )
    return corrections.groupBy("case_id").agg(chosen.alias("corrected_code"))


def apply_corrections(
    df: DataFrame, corrections: DataFrame, options: DataFrame, order: str | None = None
) -> DataFrame:
    """Overwrite code, name and strategy of corrected tickets; others are unchanged.

    A code without a name stands for itself. Names are looked up on the corrections,
    so the tickets are joined once.
    """
    names = settle(options.withColumnRenamed("code", "corrected_code"))
    last = lookup(latest_corrections(corrections, order), names, ["corrected_code"])
    # Written once: the size check and the join then read it back.
    named = settle(last.select("case_id", "corrected_code", F.coalesce("name", "corrected_code").alias("_name")))
    joined = lookup(df, named, ["case_id"])
    hit = F.col("corrected_code").isNotNull()

    def swap(new: Column, old: str) -> Column:
        return F.when(hit, new).otherwise(F.col(old))

    changed = joined.withColumns(
        {
            "predicted_code": swap(F.col("corrected_code"), "predicted_code"),
            "predicted_name": swap(F.col("_name"), "predicted_name"),
            "model_strategy": swap(F.lit("ui_corrected"), "model_strategy"),
        }
    )
    return changed.select(df.columns)


def training_labels(df: DataFrame, decided_at: Column | None = None) -> DataFrame:
    """Labels to train on, marked as reviewed."""
    kept = df.select("case_id", "predicted_code", "predicted_name", "confidence", "model_strategy")
    return export.with_audit(kept, "ui_review", decided_at)


def as_categories(
    tickets: DataFrame, labels: DataFrame, strategies: Sequence[str] | None = ("ui_corrected",)
) -> DataFrame:
    """Feed reviewed labels back as ``current_category`` for the next training.

    Only rows a reviewer corrected count as truth unless other strategies are named;
    None takes all.
    """
    chosen = F.lit(True) if strategies is None else F.col("model_strategy").isin(*strategies)
    reviewed = labels.filter(F.col("predicted_code").isNotNull() & chosen).select(
        "case_id", F.col("predicted_code").alias("_reviewed")
    )
    had = F.col("current_category") if "current_category" in tickets.columns else F.lit(None)
    joined = tickets.join(reviewed, "case_id", "left")
    return joined.withColumn("current_category", F.coalesce("_reviewed", had.cast("string"))).drop("_reviewed")


def sample_tickets(df: DataFrame, topics: DataFrame, per_topic: int = 3) -> DataFrame:
    """Tickets named by the first exemplars of each topic."""
    wanted = topics.select(
        F.explode(F.slice("exemplar_case_ids", 1, per_topic)).alias("case_id")
    ).distinct()
    return lookup(df, wanted, ["case_id"], "left_semi")
