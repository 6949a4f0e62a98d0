"""Rules first, then a confident model, else nothing."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions import scores as S
from casemill.operators import calibrate, learn
from casemill.session import lookup, stored

THRESHOLD = 0.70


def decide(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Prediction columns from rule columns and, where present, model columns.

    A rule's verdict stands. A model's counts from the threshold on, and its name is
    its code. What neither labels has confidence 0.
    """
    by_rule = F.col("rule_code").isNotNull()
    has_model = {"ml_code", "ml_confidence"} <= set(df.columns)
    by_model = S.at_least(F.col("ml_confidence"), threshold) if has_model else F.lit(False)

    def choose(rule: Column, model: str | Column, none: Column) -> Column:
        chosen = F.when(by_rule, rule)
        if has_model:
            chosen = chosen.when(by_model, F.col(model) if isinstance(model, str) else model)
        return chosen.otherwise(none)

    nothing = F.lit(None).cast("string")
    decided = df.withColumns(
        {
            "predicted_code": choose(F.col("rule_code"), "ml_code", nothing),
            "predicted_name": choose(F.col("rule_name"), "ml_code", nothing),
            "confidence": choose(F.col("rule_confidence"), "ml_confidence", F.lit(0.0)),
            "model_strategy": choose(F.lit("rules"), F.lit("ml_model"), F.lit("none")),
        }
    )
    return decided.drop("ml_code", "ml_confidence")


def cascade(df: DataFrame, scores: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``decide`` with scores (case_id, ml_code, ml_confidence) computed elsewhere."""
    if scores is None:
        return decide(df, threshold)
    return decide(lookup(df, scores, ["case_id"], "left", salts=1), threshold)


def classify(
    df: DataFrame,
    vectors: DataFrame | None = None,
    model: PipelineModel | None = None,
    threshold: float = THRESHOLD,
    curve: calibrate.Curve | None = None,
) -> DataFrame:
    """``decide`` with a model that sees only the tickets the rules left over.

    With a ``curve`` the threshold is held against calibrated confidence.

    Tickets with a verdict are not scored, and vectors never meet the texts. Store
    ``df`` first: it is read for its ids and then in whole.
    """
    if model is None or vectors is None:
        return decide(df, threshold)
    rest = df.filter(F.col("rule_code").isNull()).select("case_id")
    scored = learn.score(model, vectors.select("case_id", "embedding").join(rest, "case_id", "left_semi"))
    if curve is not None:
        scored = scored.withColumn("ml_confidence", calibrate.calibrated(F.col("ml_confidence"), curve))
    # Ids and scores alone are joined to the wide rows.
    return cascade(df, stored(scored.select("case_id", "ml_code", "ml_confidence"), "scores"), threshold)
