"""More queries: sources and sinks, whole runs, and checks on what has no SQL of its own."""

from __future__ import annotations

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.config import Config
from casemill.functions import vectors as V
from casemill.operators import cascade, clusters, embed, learn, redact, review
from casemill.operators import rules as R
from casemill.plans import adapters as A
from casemill.plans import pipeline, reports
from casemill.plans.registry import _C, _HASH, _OPTIONS, _RULED, _T, _masked, _quoted, query
from casemill.session import plan_bytes, scratch_path, stored
from casemill.sources import readers, writers

# --- Sources ----------------------------------------------------------------------


@query(
    "rules_folder",
    f"WITH {_RULED} SELECT case_id, rule_code, rule_name, rule_confidence, rule_id FROM k",
)
def rules_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules written as two files of one folder, read back and applied."""
    frame = R.rules_frame(spark, A.SAMPLE_RULES).repartitionByRange(2, "rule_order").sortWithinPartitions("rule_order")
    folder = writers.write_csv(frame.drop("rule_order"), scratch_path(spark, "rules"))
    held = readers.read_rules(spark, folder)
    return R.apply_rules(A.tickets(spark, sf_dir), held).select("case_id", *R.VERDICT_FIELDS)


@query("taxonomy_file", f"WITH {_OPTIONS} SELECT code, name FROM opt")
def taxonomy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "taxonomy")
    entries = [{"code": c, "name": n, "description": d} for c, n, d in A.SAMPLE_TAXONOMY]
    spark.createDataFrame([(yaml.safe_dump({"categories": entries}),)], "value string").coalesce(1).write.text(folder)
    return review.category_options(A.keyed(spark, sf_dir), readers.read_taxonomy(spark, folder))


@query(
    "vectors_roundtrip",
    """SELECT 'D' || vec_id AS case_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
         round(unnest(list_transform(embedding, lambda x: CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE))), 3) AS value
       FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
             FROM embeddings)""",
)
def vectors_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_vectors(A.vectors(spark, sf_dir), scratch_path(spark, "vectors"))
    held = readers.read_vectors(spark, path, dim=64)
    return held.select("case_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 3)
    )


# Stored bytes of documents per part of a written file.
PART_BYTES = 32 << 20


@query(
    "ingest_files",
    f"""WITH {_T}, m AS (SELECT case_id, subject, description || ' | ' || subject AS description,
          CASE WHEN channel = 'src7' THEN 0 WHEN channel < 'src2' THEN 2 ELSE 1 END AS file, ingest_seq FROM t)
    SELECT case_id FROM (
      SELECT case_id, row_number() OVER (PARTITION BY {_HASH} ORDER BY file, ingest_seq) AS rn FROM m) WHERE rn = 1""",
)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in three CSV files of unequal size: the first of equal rows is the one kept.

    Large ones are written in parts, in order, and all are read in splits.
    """
    folder, raw = scratch_path(spark, "files"), A.tickets(spark, sf_dir)
    channel = F.col("channel")
    file = F.when(channel == "src7", "a").when(channel < "src2", "c").otherwise("b")
    parts = plan_bytes(A.table(spark, sf_dir, "documents")) // PART_BYTES + 1
    for name in "cba":
        part = raw.filter(file == name).repartitionByRange(parts, "ingest_seq").sortWithinPartitions("ingest_seq")
        writers.write_csv(part.drop("ingest_seq"), f"{folder}/{name}.csv")
    held = readers.read_tickets_csv(spark, f"{folder}/*.csv", split=True, number="ingest_seq")
    return pipeline.ingest(held, f"{folder}/staged").select("case_id")


# --- Masking ----------------------------------------------------------------------

# Phrases of one to five words that the sample documents hold.
LONG_PHRASES = [
    ("to thanedble the anea Eriner", "PERSON"),
    ("er ntre in onbleea", "ORG"),
    ("therhean is the", "GPE"),
    ("Anon", "PERSON"),
]


def _long_masks() -> str:
    """Masks in order of each phrase's first place in the words of a text."""
    spots = ", ".join(
        f"{{'at': strpos(' ' || joined || ' ', {_quoted(' ' + p + ' ')}), 'p': {_quoted(p)}, 'l': {_quoted('[' + k + ']')}}}"
        for p, k in LONG_PHRASES
    )
    found = f"list_sort(list_filter([{spots}], lambda s: s.at > 0))"
    return f"list_reduce(list_prepend({{'at': 0, 'p': text, 'l': ''}}, {found}), lambda a, s: {{'at': 0, 'p': replace(a.p, s.p, s.l), 'l': ''}}).p"


_MASK_TABLE = f"""SELECT doc_id, md5({_long_masks()}) AS text_md5
        FROM (SELECT doc_id, text, array_to_string(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), ' ') AS joined FROM documents)"""


def phrase_table(spark: SparkSession) -> DataFrame:
    """The phrases of the sample among 100,000 that no text holds whole."""
    more = spark.range(100_000).select(
        F.format_string("the %d of nowhere%d", "id", "id").alias("phrase"), F.lit("ORG").alias("label")
    )
    return spark.createDataFrame(LONG_PHRASES, "phrase string, label string").unionByName(more)


@query("mask_phrase_table", _MASK_TABLE)
def mask_phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase table with phrases of up to five words over whole documents."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    entities = redact.gazetteer_entities(docs, phrase_table(spark), "text", key="doc_id")
    masked = redact.mask_from_table(docs, entities, "text", "masked", key="doc_id")
    return masked.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("text_md5"))


@query("mask_phrases_in_place", _MASK_TABLE)
def mask_phrases_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same phrases tagged and masked in the pass that reads the texts."""
    docs = A.table(spark, sf_dir, "documents")
    tag = redact.phrase_tagger(phrase_table(spark))
    masked = docs.withColumn("masked", redact.mask_entities(F.col("text"), tag(F.col("text"))))
    return masked.select("doc_id", F.md5(F.col("masked").cast("binary")).alias("text_md5"))


@query(
    "redaction_off",
    f"""WITH {_RULED} SELECT case_id, rule_id, md5(description) AS description_md5, false AS has_masked FROM k""",
)
def redaction_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = pipeline.redact_and_label(A.tickets(spark, sf_dir), A.SAMPLE_RULES, redact_pii=False)
    masked = [c for c in labelled.columns if c.endswith("_redacted")]
    return labelled.select("case_id", "rule_id", F.md5("description").alias("description_md5"), F.lit(bool(masked)).alias("has_masked"))


@query(
    "review_cards_masked",
    f"""WITH {_RULED}, r2 AS (SELECT *, {_masked('subject')} AS s, {_masked('description')} AS d FROM k)
    SELECT case_id, s AS subject_line,
        CASE WHEN length(d) > 300 THEN substring(d, 1, 300) || '...' ELSE d END AS description_line FROM r2""",
)
def review_cards_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards show the masked texts where there are any."""
    cards = review.review_cards(redact.redact(A.keyed(spark, sf_dir)))
    return cards.select("case_id", "subject_line", "description_line")


# --- Learning -----------------------------------------------------------------------


@query(
    "enough_labels",
    """SELECT 'quality' AS label, (SELECT count(quality) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)) >= 10 AS enough
       UNION ALL SELECT 'absent', false""",
)
def enough_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = A.labelled_tickets(spark, sf_dir)
    found = [("quality", learn.enough_labels(tickets)), ("absent", learn.enough_labels(tickets, "no_such_column"))]
    return spark.createDataFrame(found, "label string, enough boolean")


def _labelled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), F.col("vec_id")).alias("case_id"), F.concat(F.lit("L"), F.col("label")).alias("label"), "embedding"
    )


@query(
    "train_check",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT 'D' || vec_id AS case_id, true AS known_code, true AS in_range,
           (SELECT count(*) >= 2 FROM c) AS at_least_commonest FROM embeddings""",
)
def train_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector gets a code among the labels, a confidence of at least one in k, and
    the codes are right at least as often as the commonest label would be."""
    rows = stored(_labelled_vectors(spark, sf_dir), "rows")
    trained = learn.train(rows)
    labels = [r["label"] for r in rows.select("label").distinct().collect()]
    scored = stored(learn.score(trained.model, rows), "scored")
    right = scored.agg(F.avg((F.col("ml_code") == F.col("label")).cast("int")).alias("a")).head()["a"]
    common = rows.groupBy("label").count().agg((F.max("count") / F.sum("count")).alias("s")).head()["s"]
    confident = F.col("ml_confidence").between(1 / len(labels) - 1e-9, 1 + 1e-9)
    return scored.select(
        "case_id", F.col("ml_code").isin(labels).alias("known_code"), confident.alias("in_range"),
        F.lit(right >= common).alias("at_least_commonest"),
    )


@query(
    "classify_rest",
    f"""WITH {_RULED} SELECT case_id, rule_id, code_ok FROM (
      SELECT k.case_id, rule_id, true AS code_ok FROM k)""",
)
def classify_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules stand; the model decides only what they leave, and only where there is a vector."""
    ruled = stored(R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES), "ruled")
    vectors = _labelled_vectors(spark, sf_dir)
    trained = learn.train(vectors)
    decided = cascade.classify(ruled, vectors, trained.model, 0.0)
    there = decided.join(vectors.select("case_id", F.lit(True).alias("vector")), "case_id", "left")
    wanted = F.when(F.col("rule_code").isNotNull(), "rules").when(F.col("vector"), "ml_model").otherwise("none")
    return there.select("case_id", "rule_id", (F.col("model_strategy") == wanted).alias("code_ok"))


# --- Checks on models and topics -------------------------------------------------------


@query(
    "embed_tfidf_check",
    f"WITH {_T} SELECT case_id, 384 AS dim, true AS unit FROM t",
)
def embed_tfidf_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector of 384 elements per text, of length one unless the text has no word."""
    texts = embed.texts(A.tickets(spark, sf_dir))
    made = embed.embed_tfidf(texts, embed.fit_tfidf(texts))
    norm = V.l2_norm(F.col("embedding"))
    return made.select(
        "case_id", F.size("embedding").alias("dim"), ((F.abs(norm - 1) < 1e-3) | (norm == 0)).alias("unit")
    )


@query(
    "reduce_pca_check",
    """SELECT count(*) AS n, 5 AS dim, true AS falling, true AS within FROM embeddings""",
)
def reduce_pca_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variances fall from axis to axis; their sum is no more than that of the unit vectors."""
    vectors = A.vectors(spark, sf_dir)
    points = stored(clusters.reduce_pca(vectors), "points")
    spread = points.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("point")).alias("dim"),
        *[F.var_samp(F.col("point")[i]).alias(f"v{i}") for i in range(5)],
    )
    unit = vectors.select(V.unit(F.col("embedding"), "double").alias("u"))
    whole = unit.agg(sum((F.var_samp(F.col("u")[i]) for i in range(64)), F.lit(0.0)).alias("whole"))
    falling = F.lit(True)
    for i in range(4):
        falling &= F.col(f"v{i}") >= F.col(f"v{i + 1}") - 1e-12
    total = sum((F.col(f"v{i}") for i in range(5)), F.lit(0.0))
    both = spread.withColumn("_one", F.lit(1)).join(whole.withColumn("_one", F.lit(1)), "_one")
    return both.select("n", "dim", falling.alias("falling"), (total <= F.col("whole") + 1e-9).alias("within"))


@query("topics_kmeans_check", "SELECT 'D' || vec_id AS case_id, true AS valid FROM embeddings")
def topics_kmeans_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is in one of at most eight topics or noise, and each topic has three members."""
    found = stored(clusters.kmeans_topics(A.vectors(spark, sf_dir), ks=(4, 8)), "topics")
    sizes = found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    valid = F.col("topic").between(-1, 7) & ((F.col("topic") == -1) | (F.col("n") >= 3))
    return found.join(sizes, "topic").select("case_id", valid.alias("valid"))


@query("topics_found_check", "SELECT 'D' || vec_id AS case_id, true AS valid FROM embeddings")
def topics_found_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density topics of full vectors: numbered from 0 by falling size, three members at least."""
    found = stored(clusters.topics_by_density(A.vectors(spark, sf_dir)), "topics")
    sizes = found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    bigger = sizes.select((F.col("topic") + 1).alias("topic"), F.col("n").alias("before")).filter("topic > 0")
    valid = (F.col("topic") == -1) | (
        (F.col("n") >= 3) & ((F.col("topic") == 0) | (F.coalesce("before", F.lit(0)) >= F.col("n")))
    )
    return found.join(sizes.join(bigger, "topic", "left"), "topic").select("case_id", valid.alias("valid"))


# --- Reports and whole runs --------------------------------------------------------------


@query(
    "coverage_report",
    f"""WITH {_C} SELECT count(*) AS total_tickets, count(predicted) AS classified_tickets,
        round(count(predicted) * 100.0 / count(*), 2) AS coverage_percentage,
        count(*) FILTER (WHERE confidence >= 0.7) AS high_confidence_predictions,
        count(DISTINCT strategy) AS strategies, count(DISTINCT predicted) AS categories FROM c""",
)
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = reports.coverage_report(A.classified(spark, sf_dir), A.CLASSIFIED)
    return held.select(
        "total_tickets", "classified_tickets", "coverage_percentage", "high_confidence_predictions",
        F.size("strategy_breakdown").cast("bigint").alias("strategies"),
        F.size("category_breakdown").cast("bigint").alias("categories"),
    )


@query(
    "quality_report",
    f"""WITH {_C}, x AS (SELECT truth, predicted FROM c WHERE predicted IS NOT NULL AND truth IS NOT NULL AND truth <> '')
    SELECT round(avg(CASE WHEN truth = predicted THEN 1.0 ELSE 0.0 END), 3) AS accuracy, count(*) AS support,
           (SELECT string_agg(l, ',' ORDER BY l) FROM (SELECT truth AS l FROM x UNION SELECT predicted FROM x)) AS labels,
           count(*) AS cells FROM x""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = reports.quality_report(A.classified(spark, sf_dir), A.CLASSIFIED)
    total = F.aggregate(F.flatten("confusion_matrix"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return held.select("accuracy", "support", F.array_join("labels", ",").alias("labels"), total.alias("cells"))


@query(
    "export_files",
    f"""WITH {_RULED} SELECT f.file, case_id, predicted_code, model_strategy
        FROM k, (VALUES ('csv'), ('parquet')) f(file)
        UNION ALL SELECT 'summary', NULL, NULL, CAST(count(*) AS VARCHAR) FROM k
        UNION ALL SELECT 'evaluation', NULL, NULL, CAST(count(*) AS VARCHAR) FROM k""",
)
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in both formats, summary and evaluation, read back from their files."""
    config = Config().under(scratch_path(spark, "export"))
    decided = stored(A.keyed(spark, sf_dir), "classified")
    paths = pipeline.export_with_evaluation(decided, "documents", config)
    none = F.lit(None).cast("string")
    parts = [
        spark.read.option("header", True).option("escape", '"').csv(paths["csv_path"]).withColumn("file", F.lit("csv")),
        spark.read.parquet(paths["parquet_path"]).withColumn("file", F.lit("parquet")),
    ]
    rows = [p.select("file", "case_id", "predicted_code", "model_strategy") for p in parts]
    for file, path in (("summary", paths["summary_json_path"]), ("evaluation", paths["evaluation_json_path"])):
        total = spark.read.json(path).select(F.col("metadata.total_tickets").cast("string").alias("model_strategy"))
        rows.append(total.select(F.lit(file).alias("file"), none.alias("case_id"), none.alias("predicted_code"), "model_strategy"))
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    "full_run_trained_ids",
    f"""WITH {_T}, m AS (SELECT case_id, subject, description || ' | ' || subject AS description, ingest_seq FROM t)
    SELECT case_id, true AS valid FROM (
      SELECT case_id, row_number() OVER (PARTITION BY {_HASH} ORDER BY ingest_seq) AS rn FROM m) WHERE rn = 1""",
)
def full_run_trained_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a whole trained run keeps, each with a strategy and a confidence within bounds."""
    config = Config().under(scratch_path(spark, "run"))
    paths = pipeline.run_pipeline(spark, A.labelled_tickets(spark, sf_dir), "documents", config, A.SAMPLE_RULES)
    labels = spark.read.parquet(paths["parquet_path"])
    valid = F.col("model_strategy").isin("rules", "ml_model", "none") & F.col("confidence").between(0, 1)
    return labels.select("case_id", valid.alias("valid"))
