"""The sample tables seen as tickets, classified tickets, topics and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import cascade
from casemill.operators import rules as R
from casemill.operators.metrics import Columns
from casemill.session import spread

# Rules for the sample documents: specific before general, one switched off, one
# broken, two that heed letter case, one shadowed by an earlier one.
SAMPLE_RULES = [
    R.Rule("K01", r"licensed under .*(apache|gnu)", "LEGAL.NAMED", "Named licence", 0.95, rule_order=0),
    R.Rule("K02", r"licen[sc]e|all rights reserved", "LEGAL.ANY", "Licence text", 0.90, rule_order=1),
    R.Rule("K03", r'token = "[0-9a-f]{40}"', "SECRET.TOKEN", "Access token", 0.99, case_sensitive=True, rule_order=2),
    R.Rule("K04", r"(idiot|scum|clown)", "TONE.INSULT", "Insult", 0.92, rule_order=3),
    R.Rule("K05", r"(pathetic|worthless|disgusting|idiot)", "TONE.HARSH", "Harsh tone", 0.75, rule_order=4),
    R.Rule("K06", r".*", "OFF", "Switched off", 1.0, enabled=False, rule_order=5),
    R.Rule("K07", r"(unclosed", "BROKEN", "Broken pattern", 1.0, rule_order=6),
    R.Rule("K08", r"[A-Z]{8,}", "STYLE.SHOUT", "Capitals", 0.55, case_sensitive=True, rule_order=7),
    R.Rule("K09", r"nicht.*(lichte|heitst)", "LANG.DE", "German wording", 0.80, rule_order=8),
    R.Rule("K10", r"(éaument|eauxque).*ment", "LANG.FR", "French wording", 0.66, rule_order=9),
    R.Rule("K11", r"thble.*tion", "WORDS.THBLE", "Frequent ending", 0.40, rule_order=10),
    # One that Java refuses, one with names, a reference and the text's end, one with a bracket in a class.
    R.Rule("K12", r"(edshat)?(?(1) zz| qq)", "OFF.JAVA", "Not for Java", 0.99, rule_order=11),
    R.Rule("K13", r"thanedble (?P<the_word>the) (?:anea|oron)(?:[^a-z]|(?P=the_word)\Z)", "WORDS.NAMED", "Named group", 0.30, rule_order=12),
    R.Rule("K14", r"[[|] edshat", "WORDS.BRACKET", "Bracket in a class", 0.20, rule_order=13),
]

# A taxonomy that renames one code in use and adds one that is not.
SAMPLE_TAXONOMY = [
    ("TONE.INSULT", "Insulting language", "Direct insults"),
    ("BILLING.REFUND", "Refund", "Money back"),
]

# Names and places for entity masking in the sample conversations.
SAMPLE_PHRASES = [
    ("thble", "PERSON"),
    ("Onth the", "ORG"),
    ("Nicht", "GPE"),
    ("réaux", "PERSON"),
    ("und der", "ORG"),
    ("ciónmente", "PRODUCT"),
]

CLASSIFIED = Columns(truth="truth", predicted="predicted", strategy="strategy", confidence="confidence")

LANGUAGE_TOPICS = {"en": 0, "de": 1, "fr": 2, "es": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _as_tickets(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"),
        F.substring("text", 1, 50).alias("subject"),
        F.col("text").alias("description"),
        F.col("source").alias("channel"),
        F.col("lang").alias("language"),
        F.col("doc_id").alias("ingest_seq"),
    )


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets."""
    return _as_tickets(documents(spark, sf_dir))


def raw_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tickets in file order, without a position."""
    return _as_tickets(table(spark, sf_dir, "documents")).drop("ingest_seq")


def labelled_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets whose current category is the document's quality mark, where known."""
    marks = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"),
        F.col("quality").cast("string").alias("current_category"),
    )
    return tickets(spark, sf_dir).join(marks, "case_id", "left")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as classified tickets: volume for keyless aggregates."""
    line, quantity = F.col("l_linenumber"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("truth"),
        F.when(line == 7, None).when(quantity >= 25, "A").when(quantity >= 10, "N").otherwise("R").alias("predicted"),
        F.when(line == 7, "none").when(line <= 3, "rules").otherwise("ml_model").alias("strategy"),
        (F.col("l_tax") * 10).alias("confidence"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("supplier"),
    )


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets decided by the sample rules."""
    return cascade.decide(R.apply_rules(tickets(spark, sf_dir), SAMPLE_RULES))


def defective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided tickets with gaps and wrong values that depend on source and language."""
    source, lang = F.col("channel"), F.col("language")
    return keyed(spark, sf_dir).withColumns(
        {
            "case_id": F.when(source != "src7", F.col("case_id")),
            "confidence": F.when(source == "src9", None)
            .when(lang == "de", F.col("confidence") - 0.9)
            .when(lang == "es", F.col("confidence") + 1.1)
            .otherwise(F.col("confidence")),
            "predicted_code": F.when(source == "src3", F.lit("")).otherwise(F.col("predicted_code")),
            "version": F.when(source != "src5", F.lit("1.0")),
            "decided_by": F.when(source != "src4", F.lit("ensemble_classifier")),
            "decided_at_utc": F.when(source == "src6", F.lit("yesterday")).otherwise(
                F.lit("2024-03-05T06:07:08.250000")
            ),
        }
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), F.col("vec_id")).alias("case_id"), "embedding"
    )


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector labels as topics, the last label as noise."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), F.col("vec_id")).alias("case_id"),
        F.col("vec_id").alias("ingest_seq"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic"),
    )


def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document languages as topics."""
    topic = F.lit(None).cast("int")
    for lang, number in LANGUAGE_TOPICS.items():
        topic = F.when(F.col("lang") == lang, number).otherwise(topic)
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"),
        F.col("doc_id").alias("ingest_seq"),
        F.coalesce(topic, F.lit(-1)).alias("topic"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"), "text"
    )
