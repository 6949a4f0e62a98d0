"""Every query over the sample tables, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.config import Config
from casemill.functions import scores, stopwords, text
from casemill.functions import vectors as V
from casemill.operators import (
    cascade,
    clusters,
    dedup,
    embed,
    export,
    learn,
    metrics,
    prepare,
    redact,
    review,
    similar,
    topics,
)
from casemill.operators import rules as R
from casemill.plans import adapters as A
from casemill.plans import pipeline, reports
from casemill.session import scratch_path, settle, spread, stored
from casemill.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# --- SQL shared by the oracles ------------------------------------------------


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_STRIP = "trim({}, " + " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE) + ")"

_T = """t AS (
  SELECT 'D' || doc_id AS case_id, substring(text, 1, 50) AS subject, text AS description,
         source AS channel, lang AS language, doc_id AS ingest_seq
  FROM documents)"""

_C = """c AS (
  SELECT l_returnflag AS truth,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_quantity >= 25 THEN 'A'
              WHEN l_quantity >= 10 THEN 'N' ELSE 'R' END AS predicted,
         CASE WHEN l_linenumber = 7 THEN 'none' WHEN l_linenumber <= 3 THEN 'rules'
              ELSE 'ml_model' END AS strategy,
         l_tax * 10 AS confidence, 'S' || l_suppkey AS supplier
  FROM lineitem)"""

# Refused by Python, and by Java.
_UNUSABLE = ("K07", "K12")
_ACTIVE = [r for r in A.SAMPLE_RULES if r.enabled and r.rule_id not in _UNUSABLE]

# What SQL's dialect says instead of a pattern that needs translating.
_SQL_PATTERNS = {"K13": "thanedble the (anea|oron)[^a-z]", "K14": r"[\[|] edshat"}


def _matches(rule: R.Rule, subject: str = "searched") -> str:
    option = "c" if rule.case_sensitive else "i"
    pattern = _SQL_PATTERNS.get(rule.rule_id, rule.pattern)
    return f"regexp_matches({subject}, {_quoted(pattern)}, '{option}')"


def _first(value: Callable[[R.Rule], str]) -> str:
    return "CASE " + " ".join(f"WHEN {_matches(r)} THEN {value(r)}" for r in _ACTIVE) + " END"


_RULED = f"""{_T},
r AS (
  SELECT *, {_first(lambda r: str(r.rule_order))} AS hit
  FROM (SELECT *, subject || ' ' || description AS searched FROM t)),
rule(rule_order, rule_id, code, name, conf) AS (VALUES {", ".join(
    f"({r.rule_order}, {_quoted(r.rule_id)}, {_quoted(r.assign_code)}, {_quoted(r.assign_name)}, CAST({r.confidence} AS DOUBLE))"
    for r in _ACTIVE)}),
k AS (
  SELECT r.* EXCLUDE (searched, hit), code AS rule_code, name AS rule_name, conf AS rule_confidence,
         rule_id, code AS predicted_code, name AS predicted_name, coalesce(conf, 0.0) AS confidence,
         CASE WHEN code IS NULL THEN 'none' ELSE 'rules' END AS model_strategy
  FROM r LEFT JOIN rule ON hit = rule_order)"""

_TAXONOMY = "tax(code, name) AS (VALUES " + ", ".join(
    f"({_quoted(c)}, {_quoted(n)})" for c, n, _ in A.SAMPLE_TAXONOMY
) + ")"


def _masked(column: str) -> str:
    for name, pattern in text.PII_PATTERNS.items():
        column = f"regexp_replace({column}, {_quoted(pattern)}, '[{name}]', 'g')"
    return column


def _counted(name: str) -> str:
    pattern = _quoted(text.PII_PATTERNS[name])
    return f"CAST(sum(len(regexp_extract_all(text, {pattern}))) AS BIGINT) AS {name.lower()}"


# --- Preparing tickets ----------------------------------------------------------


@query(
    "ingest_defaults",
    f"""WITH {_T}
    SELECT case_id, channel, channel AS product_line, 'unknown' AS region, 'en' AS language,
           'medium' AS severity, 'open' AS status, md5(description) AS description_md5
    FROM t""",
)
def ingest_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    partial = A.tickets(spark, sf_dir).drop("language", "ingest_seq")
    source = partial.withColumnsRenamed({"case_id": "Ticket", "description": "Body"}).withColumn(
        "Main Category", F.col("channel")
    )
    mapping = {"case_id": "Ticket", "description": "Body", "subject": "subject"}
    prepare.check_mapping(mapping)
    filled = prepare.fill_missing_columns(prepare.map_columns(source, mapping))
    typed = prepare.cast_types(filled)
    return typed.select(
        "case_id", "channel", "product_line", "region", "language", "severity", "status",
        F.md5(F.col("description").cast("binary")).alias("description_md5"),
    )


@query(
    "ingest_timestamps",
    """SELECT event_id, epoch_us(CAST(CAST(ts AS VARCHAR) AS TIMESTAMP)) AS micros,
              strftime(CAST(CAST(ts AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS created_at
       FROM events""",
)
def ingest_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("created_at"))
    parsed = prepare.parse_created_at(events)
    return parsed.select(
        "event_id",
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


@query(
    "case_id_synth",
    """SELECT doc_id, printf('TICKET_%05d', row_number() OVER (ORDER BY doc_id) - 1) AS case_id
       FROM documents""",
)
def case_id_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = prepare.row_positions(A.table(spark, sf_dir, "documents").select("doc_id", "_metadata"))
    return prepare.add_case_id(numbered, F.col("ingest_seq")).select("doc_id", "case_id")


_PART_TEXT = "coalesce(p_type, '') || ' | ' || coalesce(p_name, '') || ' | ' || coalesce(p_brand, '')"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a free-form table in which small sizes have no detail."""
    return A.table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_type").alias("Main Category"),
        F.col("p_name").alias("Issue"),
        F.when(F.col("p_size") > 5, F.col("p_brand")).alias("Detail"),
    )


@query(
    "combine_text",
    f"""SELECT p_partkey, {_PART_TEXT.replace("p_brand", "CASE WHEN p_size > 5 THEN p_brand END")} AS description
        FROM part""",
)
def combine_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.combine_fields(_parts(spark, sf_dir)).select("p_partkey", "description")


@query(
    "derive_subject",
    f"""SELECT p_partkey AS id, p_name AS subject, 'issue' AS origin FROM part
        UNION ALL SELECT doc_id, substring(text, 1, 50), 'description' FROM documents""",
)
def derive_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = prepare.derive_subject(_parts(spark, sf_dir))
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"))
    return parts.select(F.col("p_partkey").alias("id"), "subject", F.lit("issue").alias("origin")).unionByName(
        prepare.derive_subject(docs).select(
            F.col("doc_id").alias("id"), "subject", F.lit("description").alias("origin")
        )
    )


@query(
    "composite_text",
    f"""WITH {_T} SELECT case_id, md5({_STRIP.format("subject || chr(10) || description")}) AS text_md5,
        CAST(length({_STRIP.format("subject || chr(10) || description")}) AS BIGINT) AS n FROM t""",
)
def composite_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    composed = embed.texts(A.tickets(spark, sf_dir))
    return composed.select(
        "case_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("bigint").alias("n")
    )


_HASH = f"md5({_STRIP.format('lower(subject)')} || chr(10) || {_STRIP.format('lower(description)')})"


@query("content_hash", f"WITH {_T} SELECT case_id, {_HASH} AS content_hash FROM t")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_content_hash(A.tickets(spark, sf_dir)).select("case_id", "content_hash")


@query(
    "dedup_keep_first",
    f"""WITH {_T} SELECT case_id, ingest_seq, md5(description) AS description_md5 FROM (
          SELECT *, row_number() OVER (PARTITION BY {_HASH} ORDER BY ingest_seq) AS rn FROM t) WHERE rn = 1""",
)
def dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.keep_first(A.tickets(spark, sf_dir))
    return kept.select("case_id", "ingest_seq", F.md5(F.col("description").cast("binary")).alias("description_md5"))


@query(
    "dedup_counts",
    f"""WITH {_T} SELECT count(*) AS rows_in, count(*) - count(DISTINCT {_HASH}) AS rows_removed,
        count(DISTINCT {_HASH}) AS rows_kept FROM t""",
)
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_counts(A.tickets(spark, sf_dir))


@query(
    "profile",
    f"""WITH {_T} SELECT count(*) AS rows, CAST(6 AS INTEGER) AS n_columns,
        'case_id,subject,description,channel,language,ingest_seq' AS columns FROM t""",
)
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.profile(A.tickets(spark, sf_dir))


@query(
    "preview",
    f"WITH {_T} SELECT case_id, subject, channel FROM t ORDER BY ingest_seq LIMIT 5",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = A.tickets(spark, sf_dir).orderBy("ingest_seq").limit(5)
    return first.select("case_id", "subject", "channel")


# --- Masking --------------------------------------------------------------------


@query(
    "redact_regex",
    f"""WITH {_T} SELECT case_id, md5({_masked("subject")}) AS subject_md5,
        md5({_masked("description")}) AS description_md5 FROM t""",
)
def redact_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redact.redact(A.tickets(spark, sf_dir))
    return masked.select(
        "case_id",
        F.md5(F.col("subject_redacted").cast("binary")).alias("subject_md5"),
        F.md5(F.col("description_redacted").cast("binary")).alias("description_md5"),
    )


@query(
    "pii_leak_audit",
    "WITH m AS (SELECT 'before' AS state, text FROM documents UNION ALL "
    f"SELECT 'after', {_masked('text')} FROM documents) "
    f"SELECT state, {', '.join(_counted(n) for n in text.PII_PATTERNS)} FROM m GROUP BY state",
)
def pii_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = redact.redact(A.tickets(spark, sf_dir), ["description"])
    return redact.pii_counts_by(masked, {"before": ["description"], "after": ["description_redacted"]})


def _phrase_masks() -> str:
    column = "text"
    for phrase, label in A.SAMPLE_PHRASES:
        if label in redact.MASKED_LABELS:
            found = f"list_contains(words, {_quoted(phrase)})"
            if " " in phrase:
                found = f"contains(' ' || array_to_string(words, ' ') || ' ', {_quoted(' ' + phrase + ' ')})"
            column = f"CASE WHEN {found} THEN replace({column}, {_quoted(phrase)}, '[{label}]') ELSE {column} END"
    return column


@query(
    "mask_entities",
    f"""SELECT conv_id, turn, md5({_phrase_masks()}) AS text_md5
        FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS words FROM conversations)""",
)
def mask_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = redact.gazetteer_tagger(A.SAMPLE_PHRASES)
    turns = spread(A.table(spark, sf_dir, "conversations"), "conv_id", "turn")
    masked = turns.withColumn("masked", redact.mask_entities(F.col("text"), tag(F.col("text"))))
    return masked.select("conv_id", "turn", F.md5(F.col("masked").cast("binary")).alias("text_md5"))


# --- Rules ----------------------------------------------------------------------


@query(
    "rules_first_match",
    f"WITH {_RULED} SELECT case_id, rule_code, rule_name, rule_confidence, rule_id FROM k",
)
def rules_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES).select("case_id", *R.VERDICT_FIELDS)


_ALL_HITS = f"""{_RULED.split("r AS (")[0]}
s AS (SELECT case_id, subject || ' ' || description AS searched FROM t)"""


def _hit_rows(fields: Callable[[R.Rule], str]) -> str:
    return " UNION ALL ".join(f"SELECT {fields(r)} FROM s WHERE {_matches(r)}" for r in _ACTIVE)


@query(
    "rules_all_hits",
    f"WITH {_ALL_HITS} "
    + _hit_rows(
        lambda r: f"case_id, CAST({r.rule_order} AS INTEGER) AS rule_order, {_quoted(r.rule_id)} AS rule_id, "
        f"{_quoted(r.assign_code)} AS rule_code, CAST({r.confidence} AS DOUBLE) AS rule_confidence"
    ),
)
def rules_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.all_matches(A.tickets(spark, sf_dir), A.SAMPLE_RULES)
    return hits.select("case_id", "rule_order", "rule_id", "rule_code", "rule_confidence")


@query(
    "rules_hit_rate",
    f"WITH {_ALL_HITS} "
    + " UNION ALL ".join(
        f"SELECT {_quoted(r.rule_id)} AS rule_id, count(*) FILTER (WHERE {_matches(r)}) AS hits, "
        f"round(count(*) FILTER (WHERE {_matches(r)}) / count(*), 6) AS rate FROM s"
        for r in _ACTIVE
    ),
)
def rules_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = R.hit_rates(A.tickets(spark, sf_dir), A.SAMPLE_RULES)
    return rates.withColumn("rate", F.round("rate", 6))


@query(
    "rules_verdict_rate",
    f"""WITH {_RULED} SELECT count(*) AS total, count(rule_code) AS matched,
        round(count(rule_code) * 100.0 / count(*), 1) AS rate FROM k""",
)
def rules_verdict_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.verdict_rate(R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES))


@query(
    "rules_stats",
    "WITH " + _RULED + ", n AS (SELECT count(*) FILTER (WHERE rule_id IS NOT NULL) AS matched FROM k) "
    f"SELECT CAST({len(A.SAMPLE_RULES)} AS BIGINT) AS total_rules, "
    f"CAST({sum(r.enabled for r in A.SAMPLE_RULES)} AS BIGINT) AS enabled_rules, "
    f"CAST({len(A.SAMPLE_RULES) - len(_UNUSABLE)} AS BIGINT) AS valid_patterns, matched AS matched_tickets FROM n",
)
def rules_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = R.verdict_rate(R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES))
    stats = R.rule_stats(spark, A.SAMPLE_RULES)
    return stats.select("*", matched.select("matched").scalar().alias("matched_tickets"))


@query("rules_join_equals_chain", f"WITH {_T} SELECT count(*) AS tickets, CAST(0 AS BIGINT) AS different FROM t")
def rules_join_equals_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = A.tickets(spark, sf_dir)
    chained = R.apply_rules(tickets, A.SAMPLE_RULES, as_data=False)
    both = R.apply_rules(
        chained.withColumnsRenamed({f: f"chain_{f}" for f in R.VERDICT_FIELDS}), A.SAMPLE_RULES, as_data=True
    )
    same = F.lit(True)
    for f in R.VERDICT_FIELDS:
        same = same & F.col(f).eqNullSafe(F.col(f"chain_{f}"))
    return both.agg(F.count(F.lit(1)).alias("tickets"), F.count_if(~same).alias("different"))


# --- Deciding -------------------------------------------------------------------

_SCORES = """ml AS (
  SELECT 'D' || vec_id AS case_id, 'L' || label AS ml_code,
         round(0.5 + least(0.5, abs(CAST(embedding[1] AS DOUBLE)) * 2), 6) AS ml_confidence
  FROM embeddings)"""


def _given_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.abs(F.col("embedding")[0].cast("double"))
    return A.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), F.col("vec_id")).alias("case_id"),
        F.concat(F.lit("L"), F.col("label")).alias("ml_code"),
        F.round(0.5 + F.least(F.lit(0.5), first * 2), 6).alias("ml_confidence"),
    )


_CASCADE = f"""{_RULED}, {_SCORES},
d AS (
  SELECT k.case_id,
    CASE WHEN rule_code IS NOT NULL THEN rule_code WHEN ml_confidence >= 0.7 THEN ml_code END AS predicted_code,
    CASE WHEN rule_code IS NOT NULL THEN rule_name WHEN ml_confidence >= 0.7 THEN ml_code END AS predicted_name,
    CASE WHEN rule_code IS NOT NULL THEN rule_confidence WHEN ml_confidence >= 0.7 THEN ml_confidence ELSE 0.0 END AS confidence,
    CASE WHEN rule_code IS NOT NULL THEN 'rules' WHEN ml_confidence >= 0.7 THEN 'ml_model' ELSE 'none' END AS model_strategy
  FROM k LEFT JOIN ml ON k.case_id = ml.case_id)"""


@query(
    "cascade",
    f"WITH {_CASCADE} SELECT case_id, predicted_code, predicted_name, CAST(confidence AS DOUBLE) AS confidence, model_strategy FROM d",
)
def cascade_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES)
    decided = cascade.cascade(ruled, _given_scores(spark, sf_dir))
    return decided.select("case_id", "predicted_code", "predicted_name", "confidence", "model_strategy")


@query(
    "cascade_outcome",
    f"""WITH {_CASCADE} SELECT count(*) AS total, count(*) FILTER (WHERE model_strategy = 'rules') AS rules,
        count(*) FILTER (WHERE model_strategy = 'ml_model') AS ml_model,
        count(*) FILTER (WHERE model_strategy = 'none') AS unclassified FROM d""",
)
def cascade_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = R.apply_rules(A.tickets(spark, sf_dir), A.SAMPLE_RULES)
    return metrics.outcome_counts(cascade.cascade(ruled, _given_scores(spark, sf_dir)))


# --- Counts and coverage ----------------------------------------------------------


@query(
    "outcome_counts",
    f"""WITH {_C} SELECT count(*) AS total, count(*) FILTER (WHERE strategy = 'rules') AS rules,
        count(*) FILTER (WHERE strategy = 'ml_model') AS ml_model,
        count(*) FILTER (WHERE strategy = 'none') AS unclassified FROM c""",
)
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.outcome_counts(A.classified(spark, sf_dir), A.CLASSIFIED)


@query("strategy_counts", f"WITH {_C} SELECT strategy AS value, count(*) AS n FROM c GROUP BY 1")
def strategy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strategy_counts(A.classified(spark, sf_dir), A.CLASSIFIED)


@query(
    "category_counts",
    f"WITH {_C} SELECT predicted AS value, count(*) AS n FROM c WHERE predicted IS NOT NULL GROUP BY 1",
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_counts(A.classified(spark, sf_dir), A.CLASSIFIED)


@query(
    "category_top10",
    f"""WITH {_C}, n AS (SELECT supplier AS value, count(*) AS n FROM c GROUP BY 1)
        SELECT value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS rank,
               greatest((SELECT count(*) FROM n) - 10, 0) AS more
        FROM n ORDER BY n DESC, value LIMIT 10""",
)
def category_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_categories(A.classified(spark, sf_dir), 10, metrics.Columns(predicted="supplier"))


@query(
    "shares",
    f"""WITH {_C}, n AS (SELECT strategy AS value, count(*) AS n FROM c GROUP BY 1)
        SELECT value, n, round(n * 100.0 / sum(n) OVER (), 1) AS share FROM n""",
)
def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shares(metrics.strategy_counts(A.classified(spark, sf_dir), A.CLASSIFIED))


_DESCRIBE = """count(confidence) AS count, round(avg(confidence), 8) AS mean,
  round(stddev_samp(confidence), 8) AS std, min(confidence) AS min,
  quantile_cont(confidence, 0.25) AS p25, quantile_cont(confidence, 0.5) AS p50,
  quantile_cont(confidence, 0.75) AS p75, max(confidence) AS max"""


@query("confidence_describe", f"WITH {_C} SELECT {_DESCRIBE} FROM c")
def confidence_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.describe(A.classified(spark, sf_dir), "confidence")
    return found.withColumns({"mean": F.round("mean", 8), "std": F.round("std", 8)})


@query(
    "price_quantiles",
    """SELECT count(l_extendedprice) AS n, round(quantile_cont(l_extendedprice, 0.25), 6) AS q0,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q2
       FROM lineitem""",
)
def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles by the two-pass way meant for long columns."""
    found = metrics.quantiles(A.table(spark, sf_dir, "lineitem"), "l_extendedprice", max_rows=0)
    return found.select("n", *[F.round(q, 6).alias(q) for q in ("q0", "q1", "q2")])


@query(
    "confidence_histogram",
    f"""WITH {_C} SELECT CAST(least(floor(round(confidence * 10, 9)), 9) AS INTEGER) AS bin, count(*) AS n
        FROM c WHERE confidence IS NOT NULL GROUP BY 1""",
)
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(A.classified(spark, sf_dir), "confidence")


@query(
    "coverage_by_strategy",
    f"""WITH {_C} SELECT count(*) AS total, count(*) FILTER (WHERE strategy <> 'none') AS classified_by_strategy,
        round(count(*) FILTER (WHERE strategy <> 'none') * 100.0 / count(*), 2) AS coverage_by_strategy FROM c""",
)
def coverage_by_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage_by_strategy(A.classified(spark, sf_dir), A.CLASSIFIED)


@query(
    "coverage_by_code",
    f"""WITH {_C} SELECT count(*) AS total, count(predicted) AS classified_by_code,
        count(*) - count(predicted) AS unclassified_by_code,
        round(count(predicted) * 100.0 / count(*), 2) AS coverage_by_code FROM c""",
)
def coverage_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.coverage_by_code(A.classified(spark, sf_dir), A.CLASSIFIED)


@query(
    "high_confidence",
    f"""WITH {_C} SELECT count(*) AS total, count(*) FILTER (WHERE confidence >= 0.7) AS high_confidence,
        round(count(*) FILTER (WHERE confidence >= 0.7) * 100.0 / count(*), 2) AS high_confidence_percentage FROM c""",
)
def high_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.high_confidence(A.classified(spark, sf_dir), A.CLASSIFIED)


_CONFUSION = f"""{_C},
x AS (SELECT truth AS y_true, predicted AS y_pred, count(*) AS n FROM c
      WHERE predicted IS NOT NULL AND truth IS NOT NULL AND truth <> '' GROUP BY 1, 2),
l AS (SELECT y_true AS label FROM x UNION SELECT y_pred FROM x)"""

_PER_LABEL = f"""{_CONFUSION},
s AS (SELECT label,
        coalesce((SELECT sum(n) FROM x WHERE y_true = label AND y_pred = label), 0) AS tp,
        coalesce((SELECT sum(n) FROM x WHERE y_true = label), 0) AS support,
        coalesce((SELECT sum(n) FROM x WHERE y_pred = label), 0) AS guessed FROM l),
m AS (SELECT label, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
        CASE WHEN support + guessed > 0 THEN 2 * tp / (support + guessed) ELSE 0 END AS f1, support FROM s)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(A.classified(spark, sf_dir), A.CLASSIFIED)


@query("confusion_long", f"WITH {_CONFUSION} SELECT y_true, y_pred, n FROM x")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


@query(
    "confusion_dense",
    f"""WITH {_CONFUSION} SELECT a.label AS y_true, b.label AS y_pred, coalesce(n, 0) AS n
        FROM l a CROSS JOIN l b LEFT JOIN x ON y_true = a.label AND y_pred = b.label""",
)
def confusion_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_dense(_cells(spark, sf_dir))


@query(
    "confusion_wide",
    f"""WITH {_CONFUSION} SELECT a.label AS y_true,
        CAST(coalesce(sum(n) FILTER (WHERE y_pred = 'A'), 0) AS BIGINT) AS "A",
        CAST(coalesce(sum(n) FILTER (WHERE y_pred = 'N'), 0) AS BIGINT) AS "N",
        CAST(coalesce(sum(n) FILTER (WHERE y_pred = 'R'), 0) AS BIGINT) AS "R"
        FROM l a LEFT JOIN x ON y_true = a.label GROUP BY 1""",
)
def confusion_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_wide(_cells(spark, sf_dir))


@query("confusion_labels", f"WITH {_CONFUSION} SELECT label FROM l")
def confusion_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_labels(_cells(spark, sf_dir))


@query(
    "accuracy",
    f"""WITH {_CONFUSION} SELECT round(sum(n) FILTER (WHERE y_true = y_pred) / sum(n), 3) AS accuracy,
        CAST(sum(n) AS BIGINT) AS support FROM x""",
)
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_cells(spark, sf_dir))


@query(
    "weighted_prf",
    f"""WITH {_PER_LABEL} SELECT round(sum(precision * support) / sum(support), 3) AS precision,
        round(sum(recall * support) / sum(support), 3) AS recall,
        round(sum(f1 * support) / sum(support), 3) AS f1 FROM m""",
)
def weighted_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_scores(_cells(spark, sf_dir))


@query(
    "class_report",
    f"""WITH {_PER_LABEL}, u AS (
      SELECT label, precision, recall, f1, support FROM m
      UNION ALL SELECT 'accuracy', a, a, a, s FROM (
        SELECT sum(n) FILTER (WHERE y_true = y_pred) / sum(n) AS a, sum(n) AS s FROM x)
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
    SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1,
           CAST(support AS BIGINT) AS support FROM u""",
)
def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.class_report(_cells(spark, sf_dir))
    return report.withColumns({m: F.round(m, 8) for m in ("precision", "recall", "f1")})


@query(
    "summary_report",
    f"""WITH {_C}, d AS (SELECT {_DESCRIBE} FROM c),
    m AS (SELECT count(*) AS total, count(*) FILTER (WHERE strategy <> 'none') AS cl,
                 count(*) FILTER (WHERE confidence >= 0.7) AS hi FROM c),
    u AS (
      SELECT 'metadata' AS section, 'total' AS key, CAST(total AS DOUBLE) AS value FROM m
      UNION ALL SELECT 'metadata', 'classified_by_strategy', cl FROM m
      UNION ALL SELECT 'metadata', 'coverage_by_strategy', round(cl * 100.0 / total, 2) FROM m
      UNION ALL SELECT 'metadata', 'high_confidence', hi FROM m
      UNION ALL SELECT 'metadata', 'high_confidence_percentage', round(hi * 100.0 / total, 2) FROM m
      UNION ALL SELECT 'strategy_breakdown', strategy, count(*) FROM c GROUP BY strategy
      UNION ALL SELECT 'category_breakdown', predicted, count(*) FROM c WHERE predicted IS NOT NULL GROUP BY predicted
      UNION ALL SELECT 'confidence_statistics', 'count', count FROM d
      UNION ALL SELECT 'confidence_statistics', 'mean', mean FROM d
      UNION ALL SELECT 'confidence_statistics', 'std', std FROM d
      UNION ALL SELECT 'confidence_statistics', 'min', min FROM d
      UNION ALL SELECT 'confidence_statistics', 'p25', p25 FROM d
      UNION ALL SELECT 'confidence_statistics', 'p50', p50 FROM d
      UNION ALL SELECT 'confidence_statistics', 'p75', p75 FROM d
      UNION ALL SELECT 'confidence_statistics', 'max', max FROM d)
    SELECT section, key, round(value, 8) AS value FROM u""",
)
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = reports.summary_long(A.classified(spark, sf_dir), A.CLASSIFIED)
    return long.withColumn("value", F.round("value", 8))


# --- Exporting --------------------------------------------------------------------

_DEFECTIVE = f"""{_RULED},
e AS (
  SELECT CASE WHEN channel <> 'src7' THEN case_id END AS case_id,
    CASE WHEN channel = 'src3' THEN '' ELSE predicted_code END AS predicted_code, predicted_name,
    CASE WHEN channel = 'src9' THEN NULL WHEN language = 'de' THEN confidence - 0.9
         WHEN language = 'es' THEN confidence + 1.1 ELSE confidence END AS confidence,
    model_strategy,
    CASE WHEN channel <> 'src5' THEN '1.0' END AS version,
    CASE WHEN channel <> 'src4' THEN 'ensemble_classifier' END AS decided_by,
    CASE WHEN channel = 'src6' THEN 'yesterday' ELSE '2024-03-05T06:07:08.250000' END AS decided_at_utc
  FROM k)"""


@query(
    "labels_export",
    f"""WITH {_DEFECTIVE} SELECT case_id, nullif(predicted_code, '') AS predicted_code, predicted_name,
        round(CAST(CASE WHEN confidence < 0 THEN 0 WHEN confidence > 1 THEN 1 ELSE confidence END AS DOUBLE), 8) AS confidence,
        model_strategy, coalesce(version, '1.0') AS version, coalesce(decided_by, 'system') AS decided_by,
        coalesce(strftime(TRY_CAST(decided_at_utc AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ'), decided_at_utc) AS decided_at_utc
        FROM e WHERE case_id IS NOT NULL""",
)
def labels_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = export.clean_labels(A.defective(spark, sf_dir))
    return cleaned.withColumn("confidence", F.round("confidence", 8))


@query(
    "export_quality",
    f"""WITH {_DEFECTIVE} SELECT count(*) FILTER (WHERE case_id IS NULL) AS null_case_ids,
        count(*) FILTER (WHERE case_id IS NOT NULL AND (confidence < 0 OR confidence > 1)) AS invalid_confidence,
        count(*) FILTER (WHERE case_id IS NOT NULL AND predicted_code = '') AS empty_codes,
        count(*) FILTER (WHERE case_id IS NOT NULL AND decided_by IS NULL) AS missing_decided_by,
        count(*) FILTER (WHERE case_id IS NOT NULL AND version IS NULL) AS missing_version,
        count(case_id) AS exported FROM e""",
)
def export_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.quality_counts(A.defective(spark, sf_dir))


# --- Reviewing --------------------------------------------------------------------


@query(
    "review_queue",
    f"""WITH {_RULED} SELECT case_id, predicted_code, confidence FROM k
        WHERE model_strategy = 'rules' AND confidence >= 0.6 ORDER BY ingest_seq LIMIT 20""",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = review.review_queue(A.keyed(spark, sf_dir), "rules", 0.6)
    return chosen.select("case_id", "predicted_code", "confidence")


@query(
    "review_cards",
    f"""WITH {_RULED} SELECT case_id, subject AS subject_line,
        CASE WHEN length(description) > 300 THEN substring(description, 1, 300) || '...' ELSE description END AS description_line,
        coalesce(predicted_name, 'N/A') AS predicted_name, confidence,
        CASE WHEN confidence > 0.7 THEN 'green' WHEN confidence > 0.4 THEN 'orange' ELSE 'red' END AS band,
        model_strategy FROM k""",
)
def review_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_cards(A.keyed(spark, sf_dir))


_OPTIONS = f"""{_RULED}, {_TAXONOMY},
used AS (SELECT coalesce(predicted_code, 'UNCLASSIFIED') AS code,
                arg_min(coalesce(predicted_name, 'Unclassified'), ingest_seq) AS name FROM k GROUP BY 1),
opt AS (
  SELECT code, coalesce(tax.name, used.name) AS name FROM used FULL JOIN tax USING (code)
  UNION ALL SELECT 'UNCLASSIFIED', 'Unclassified'
  WHERE 'UNCLASSIFIED' NOT IN (SELECT code FROM used) AND 'UNCLASSIFIED' NOT IN (SELECT code FROM tax))"""


def _taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(A.SAMPLE_TAXONOMY, "code string, name string, description string")


@query("category_options", f"WITH {_OPTIONS} SELECT code, name FROM opt")
def category_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.category_options(A.keyed(spark, sf_dir), _taxonomy(spark))


_CORRECTED = f"""{_OPTIONS},
corr AS (SELECT 'D' || doc_id AS case_id,
           CASE WHEN toxic = 1 THEN 'TONE.INSULT' WHEN quality = 0 THEN 'REVIEW.LOW' END AS corrected_code FROM labels),
ck AS (
  SELECT k.case_id, coalesce(corrected_code, predicted_code) AS predicted_code,
    CASE WHEN corrected_code IS NULL THEN predicted_name ELSE coalesce(opt.name, corrected_code) END AS predicted_name,
    confidence, CASE WHEN corrected_code IS NULL THEN model_strategy ELSE 'ui_corrected' END AS model_strategy
  FROM k LEFT JOIN (SELECT * FROM corr WHERE corrected_code IS NOT NULL) q ON k.case_id = q.case_id
         LEFT JOIN opt ON opt.code = corrected_code)"""


def _corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents corrected to a known code, poor ones to a code without a name."""
    code = F.when(F.col("toxic") == 1, "TONE.INSULT").when(F.col("quality") == 0, "REVIEW.LOW")
    return (
        A.table(spark, sf_dir, "labels")
        .select(F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"), code.alias("corrected_code"), "doc_id")
        .filter(F.col("corrected_code").isNotNull())
    )


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = stored(A.keyed(spark, sf_dir), "classified")
    options = review.category_options(decided, _taxonomy(spark))
    return review.apply_corrections(decided, _corrections(spark, sf_dir), options, "doc_id")


@query(
    "apply_corrections",
    f"WITH {_CORRECTED} SELECT case_id, predicted_code, predicted_name, confidence, model_strategy FROM ck",
)
def apply_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corrected(spark, sf_dir).select(
        "case_id", "predicted_code", "predicted_name", "confidence", "model_strategy"
    )


@query(
    "training_labels",
    f"""WITH {_CORRECTED} SELECT case_id, predicted_code, predicted_name, confidence, model_strategy,
        '1.0' AS version, 'ui_review' AS decided_by, '2024-01-01T00:00:00' AS decided_at_utc FROM ck""",
)
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.training_labels(_corrected(spark, sf_dir), F.lit("2024-01-01T00:00:00"))


@query(
    "review_feedback",
    f"""WITH {_CORRECTED}, old AS (SELECT 'D' || doc_id AS case_id, CAST(quality AS VARCHAR) AS category FROM labels)
    SELECT ck.case_id, coalesce(predicted_code, category) AS current_category
    FROM (SELECT case_id, CASE WHEN model_strategy = 'ui_corrected' THEN predicted_code END AS predicted_code FROM ck) ck
    LEFT JOIN old ON ck.case_id = old.case_id""",
)
def review_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed labels written, read back, and set as categories to train on."""
    decided = stored(A.keyed(spark, sf_dir), "classified")
    config = Config().under(scratch_path(spark, "review"))
    paths = pipeline.close_review(decided, _corrections(spark, sf_dir), _taxonomy(spark), config, "doc_id")
    labels = readers.read_parquet(spark, paths["parquet_path"])
    tickets = A.labelled_tickets(spark, sf_dir).select("case_id", "current_category")
    return review.as_categories(tickets, labels)


# --- Vectors ----------------------------------------------------------------------


@query(
    "normalize_vectors",
    """SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
         round(unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) / norm)), 5) AS value
       FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
             FROM embeddings)""",
)
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = A.table(spark, sf_dir, "embeddings").select("vec_id", V.unit(F.col("embedding"), "double").alias("u"))
    return unit.select("vec_id", F.posexplode("u").alias("pos", "value")).withColumn("value", F.round("value", 5))


TOPK_SQL = """WITH p AS (
         SELECT q.vec_id AS query_id, e.vec_id AS case_id,
                round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS similarity
         FROM embeddings q CROSS JOIN embeddings e),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, case_id) AS rank FROM p)
       SELECT query_id, case_id, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank
       FROM ranked WHERE rank <= 5"""


@query("vector_topk", TOPK_SQL)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = A.table(spark, sf_dir, "embeddings")
    corpus = held.select(F.col("vec_id").alias("case_id"), "embedding")
    asked = held.select(F.col("vec_id").alias("query_id"), "embedding")
    return similar.nearest(corpus, asked, 5).withColumn("similarity", F.round("similarity", 6))


@query(
    "vectors_join",
    f"""WITH {_T} SELECT t.case_id, t.language, CAST(len(embedding) AS INTEGER) AS dim
        FROM t JOIN embeddings ON ingest_seq = vec_id""",
)
def vectors_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tickets = A.tickets(spark, sf_dir).select("case_id", "language")
    joined = similar.join_vectors(tickets, A.vectors(spark, sf_dir))
    return joined.select("case_id", "language", F.size("embedding").alias("dim"))


# --- Topics -----------------------------------------------------------------------

_ASSIGNED = """a AS (
  SELECT 'D' || vec_id AS case_id, vec_id AS ingest_seq, CASE WHEN label = 9 THEN -1 ELSE label END AS topic
  FROM embeddings)"""

_EXEMPLARS = """x AS (
  SELECT topic, list(case_id ORDER BY ingest_seq) AS ids FROM (
    SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ingest_seq) AS rn FROM a WHERE topic <> -1)
  WHERE rn <= 3 GROUP BY topic)"""


@query("topic_sizes", f"WITH {_ASSIGNED} SELECT topic, count(*) AS size FROM a WHERE topic <> -1 GROUP BY 1")
def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.topic_sizes(A.assigned(spark, sf_dir))


@query(
    "topic_exemplars",
    f"WITH {_ASSIGNED}, {_EXEMPLARS} SELECT topic, array_to_string(ids, ',') AS exemplars FROM x",
)
def topic_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topics.topic_exemplars(A.assigned(spark, sf_dir))
    return found.select("topic", F.array_join("exemplar_case_ids", ",").alias("exemplars"))


@query(
    "topic_corpus",
    f"""WITH {_ASSIGNED}, f AS (
          SELECT topic, ingest_seq, text FROM (
            SELECT a.*, text, row_number() OVER (PARTITION BY topic ORDER BY ingest_seq) AS rn
            FROM a JOIN documents ON doc_id = ingest_seq WHERE topic <> -1) WHERE rn <= 50)
        SELECT topic, count(*) AS n_texts, md5(string_agg(text, ' ' ORDER BY ingest_seq)) AS corpus_md5
        FROM f GROUP BY topic""",
)
def topic_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = A.texts(spark, sf_dir)
    with_text = A.assigned(spark, sf_dir).join(texts.select("case_id"), "case_id", "left_semi")
    joined = topics.topic_corpus(topics.corpus_texts(with_text, texts, topics.CORPUS_TEXTS))
    return joined.select("topic", "n_texts", F.md5(F.col("corpus").cast("binary")).alias("corpus_md5"))


_KEYWORDS = f"""
f AS (SELECT topic, ingest_seq, text FROM src WHERE topic <> -1),
w AS (SELECT topic, ingest_seq, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
        lambda t: NOT list_contains([{", ".join(_quoted(s) for s in stopwords.ENGLISH)}], t)) AS tokens FROM f
      WHERE topic IN (SELECT topic FROM f GROUP BY topic HAVING count(*) >= 3)),
g AS (SELECT topic, unnest(tokens) AS term FROM w
      UNION ALL SELECT topic, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM w),
tf AS (SELECT topic, term, count(*) AS tf FROM g GROUP BY 1, 2),
len AS (SELECT topic, sum(tf) AS length FROM tf GROUP BY 1),
total AS (SELECT term, sum(tf) AS total FROM tf GROUP BY 1),
scored AS (SELECT tf.topic, tf.term,
             round(tf / length * ln(1 + (SELECT avg(length) FROM len) / total), 10) AS score
           FROM tf JOIN len ON tf.topic = len.topic JOIN total ON tf.term = total.term),
best AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS rank FROM scored)"""

_LANGUAGES = """src AS (
  SELECT 'D' || doc_id AS case_id, doc_id AS ingest_seq, text,
         CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE -1 END AS topic
  FROM documents)"""


@query(
    "topic_keywords",
    f"WITH {_LANGUAGES}, {_KEYWORDS} "
    "SELECT topic, term, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 20",
)
def topic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = topics.corpus_texts(A.by_language(spark, sf_dir), A.texts(spark, sf_dir))
    return topics.keyword_candidates(settle(topics.term_counts(corpus))).select("topic", "term", "rank")


_PAIRS = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]

_DIVERSE = f"""{_KEYWORDS},
cand AS (SELECT topic, term, rank FROM best WHERE rank <= 20),
gt AS (SELECT topic, ingest_seq, unnest(tokens) AS term FROM w
       UNION ALL SELECT topic, ingest_seq,
         unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM w),
dt AS (SELECT topic, ingest_seq, rank, CAST(count(*) AS DOUBLE) AS n
       FROM gt JOIN cand USING (topic, term) GROUP BY ALL),
norm AS (SELECT topic, rank, sqrt(sum(n * n)) AS norm FROM dt GROUP BY ALL),
dots AS (SELECT a.topic, a.rank AS i, b.rank AS j, sum(a.n * b.n) AS dot
         FROM dt a JOIN dt b ON a.topic = b.topic AND a.ingest_seq = b.ingest_seq AND a.rank < b.rank GROUP BY ALL),
sim AS (SELECT a.topic, a.rank AS i, b.rank AS j, coalesce(dot, 0) / (a.norm * b.norm) AS s
        FROM norm a JOIN norm b ON a.topic = b.topic AND a.rank < b.rank
        LEFT JOIN dots ON dots.topic = a.topic AND dots.i = a.rank AND dots.j = b.rank),
pick AS (
  SELECT c1.topic, c1.rank AS r1, c2.rank AS r2, c3.rank AS r3, c4.rank AS r4, c5.rank AS r5,
         round({" + ".join(f"s{a}{b}.s" for a, b in _PAIRS)}, 9) AS total
  FROM cand c1 {" ".join(f"JOIN cand c{k} ON c{k}.topic = c1.topic AND c{k}.rank > c{k - 1}.rank" for k in range(2, 6))}
  {" ".join(f"JOIN sim s{a}{b} ON s{a}{b}.topic = c1.topic AND s{a}{b}.i = c{a}.rank AND s{a}{b}.j = c{b}.rank" for a, b in _PAIRS)}),
chosen AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY total, r1, r2, r3, r4, r5) AS rn FROM pick) WHERE rn = 1)"""


@query(
    "topic_keywords_diverse",
    f"""WITH {_LANGUAGES}, {_DIVERSE}
    SELECT c.topic, term FROM chosen JOIN cand c ON c.topic = chosen.topic AND c.rank IN (r1, r2, r3, r4, r5)""",
)
def topic_keywords_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = topics.corpus_texts(A.by_language(spark, sf_dir), A.texts(spark, sf_dir))
    return topics.topic_keywords(corpus).select("topic", F.explode("keywords").alias("term"))


@query(
    "topic_report",
    f"""WITH {_LANGUAGES}, {_KEYWORDS},
    sz AS (SELECT topic, count(*) AS size FROM src WHERE topic <> -1 GROUP BY 1),
    kw AS (SELECT topic, string_agg(term, ',' ORDER BY rank) AS keywords FROM best WHERE rank <= 5 GROUP BY 1),
    {_EXEMPLARS.replace("FROM a ", "FROM src ")}
    SELECT sz.topic AS cluster_id, size, coalesce(keywords, '') AS keywords,
           coalesce(array_to_string(ids, ','), '') AS exemplars
    FROM sz LEFT JOIN kw ON sz.topic = kw.topic LEFT JOIN x ON sz.topic = x.topic""",
)
def topic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = A.by_language(spark, sf_dir)
    corpus = topics.corpus_texts(assigned, A.texts(spark, sf_dir))
    table = topics.topic_table(
        topics.topic_sizes(assigned),
        topics.topic_keywords(corpus, diverse=False),
        topics.topic_exemplars(assigned),
    )
    return topics.largest_first(table).select(
        "cluster_id",
        "size",
        F.array_join("keywords", ",").alias("keywords"),
        F.array_join("exemplar_case_ids", ",").alias("exemplars"),
    )


@query(
    "sample_tickets",
    f"""WITH {_T}, {_ASSIGNED}, {_EXEMPLARS} SELECT case_id, language FROM t
        WHERE case_id IN (SELECT unnest(ids[1:3]) FROM x)""",
)
def sample_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    exemplars = topics.topic_exemplars(A.assigned(spark, sf_dir))
    return review.sample_tickets(A.tickets(spark, sf_dir).select("case_id", "language"), exemplars)


@query("topics_kmeans")
def topics_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.kmeans_topics(A.vectors(spark, sf_dir), ks=(4, 8))


@query("reduce_pca")
def reduce_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.reduce_pca(A.vectors(spark, sf_dir))


_SIDE = 0.35

_TOUCH = " AND ".join(f"abs(a.cell[{i}] - b.cell[{i}]) <= 1" for i in range(1, 6)) + " AND a.cell <> b.cell"


def _sign(axis: int, position: int) -> int:
    """Walsh signs: five patterns that are orthogonal over 64 positions."""
    return -1 if bin(position & (1, 2, 4, 8, 16)[axis]).count("1") % 2 else 1


def _axis_sql(axis: int) -> str:
    signs = ", ".join(str(_sign(axis, i)) for i in range(64))
    terms = f"list_sum(list_transform(list_zip(embedding, [{signs}]), lambda p: CAST(p[1] AS DOUBLE) * p[2]))"
    return f"CAST(floor(round({terms}, 9) / {_SIDE}) AS BIGINT)"


@query(
    "topics_density",
    f"""WITH RECURSIVE p AS (
      SELECT 'D' || vec_id AS case_id, [{", ".join(_axis_sql(a) for a in range(5))}] AS cell FROM embeddings),
    n AS (SELECT cell, count(*) AS n FROM p GROUP BY cell),
    d AS (SELECT * FROM n WHERE n >= 5),
    reach(start, cell) AS (
      SELECT cell, cell FROM d
      UNION SELECT a.start, b.cell FROM reach a JOIN d b ON {_TOUCH}),
    core AS (SELECT cell, min(start) AS label FROM reach GROUP BY cell),
    edge AS (
      SELECT cell, label FROM (
        SELECT b.cell, label, row_number() OVER (PARTITION BY b.cell ORDER BY a.n DESC, a.cell) AS rn
        FROM n b JOIN d a ON b.n < 5 AND {_TOUCH} JOIN core ON core.cell = a.cell) WHERE rn = 1),
    l AS (SELECT * FROM core UNION ALL SELECT * FROM edge),
    z AS (SELECT label, row_number() OVER (ORDER BY sum(n) DESC, min(l.cell)) - 1 AS topic
          FROM l JOIN n ON l.cell = n.cell GROUP BY label HAVING sum(n) >= 3)
    SELECT case_id, CAST(coalesce(topic, -1) AS INTEGER) AS topic
    FROM p LEFT JOIN l ON p.cell = l.cell LEFT JOIN z ON l.label = z.label""",
)
def topics_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density over five signed sums, each of all elements of a vector."""

    def axis(a: int):
        signed = F.zip_with(
            "embedding", F.array(*[F.lit(_sign(a, i)) for i in range(64)]), lambda x, s: x.cast("double") * s
        )
        return F.round(F.aggregate(signed, F.lit(0.0), lambda t, x: t + x), 9)

    points = A.vectors(spark, sf_dir).select("case_id", F.array(*[axis(a) for a in range(5)]).alias("point"))
    return clusters.density_topics(points, _SIDE, 5)


@query("topics_density_reduced")
def topics_density_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.topics_by_density(A.vectors(spark, sf_dir))


# --- Learning ---------------------------------------------------------------------


@query(
    "split_stratified",
    """WITH h AS (SELECT doc_id, CAST(quality AS VARCHAR) AS label, md5('42|D' || doc_id) AS h FROM labels),
       r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, 'D' || doc_id) AS rn,
                    count(*) OVER (PARTITION BY label) AS n FROM h)
       SELECT 'D' || doc_id AS case_id, label, rn <= round(0.2 * n) AS is_test FROM r""",
)
def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = A.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("D"), F.col("doc_id")).alias("case_id"), F.col("quality").cast("string").alias("label")
    )
    return learn.split_stratified(marked)


@query(
    "label_index",
    """SELECT doc_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM (
         SELECT doc_id, 'q' || quality || 't' || toxic AS label FROM labels)""",
)
def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("q"), F.col("quality"), F.lit("t"), F.col("toxic")).alias("label")
    marked = A.table(spark, sf_dir, "labels").select("doc_id", label)
    return learn.label_index(marked).select("doc_id", "label_index")


@query(
    "min_training_guard",
    """SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, count(*) >= 10 AS trainable
       FROM labels GROUP BY 1""",
)
def min_training_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learn.labelled(A.labelled_tickets(spark, sf_dir).select("current_category"))
    counts = rows.groupBy(F.col("current_category").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("trainable", F.col("n") >= learn.MIN_LABELLED)


@query("train_select_score")
def train_select_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("D"), F.col("vec_id")).alias("case_id"),
        F.concat(F.lit("L"), F.col("label")).alias("label"),
        "embedding",
    )
    trained = learn.train(rows)
    path = scratch_path(spark, "classifier")
    trained.save(path)
    scored = learn.score(learn.load_model(path), rows.select("case_id", "embedding"))
    return scored.select("case_id", "ml_code", F.round("ml_confidence", 6).alias("ml_confidence"))


@query("embed_tfidf")
def embed_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = embed.texts(A.tickets(spark, sf_dir))
    return embed.embed_tfidf(texts, embed.fit_tfidf(texts))


# --- Reading, writing, whole runs ---------------------------------------------------

_TICKET_DIGEST = f"""WITH {_T} SELECT case_id, md5(subject) AS subject_md5, md5(description) AS description_md5,
  channel, language, CAST(ingest_seq AS BIGINT) AS ingest_seq FROM t"""


def _digest(df: DataFrame) -> DataFrame:
    return df.select(
        "case_id",
        F.md5(F.col("subject").cast("binary")).alias("subject_md5"),
        F.md5(F.col("description").cast("binary")).alias("description_md5"),
        "channel",
        "language",
        F.col("ingest_seq").cast("bigint").alias("ingest_seq"),
    )


@query("csv_roundtrip", _TICKET_DIGEST)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_csv(A.tickets(spark, sf_dir), scratch_path(spark, "tickets") + ".csv")
    return _digest(readers.read_tickets_csv(spark, path))


@query("parquet_roundtrip", _TICKET_DIGEST)
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = writers.write_parquet(A.tickets(spark, sf_dir), scratch_path(spark, "tickets") + ".parquet")
    return _digest(readers.read_parquet(spark, path))


@query(
    "json_report",
    f"""WITH {_C} SELECT 'strategy_breakdown' AS section, strategy AS key, CAST(count(*) AS DOUBLE) AS value
        FROM c GROUP BY strategy
        UNION ALL SELECT 'category_breakdown', predicted, count(*) FROM c WHERE predicted IS NOT NULL GROUP BY predicted""",
)
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = reports.summary_report(A.classified(spark, sf_dir), A.CLASSIFIED)
    path = writers.write_json_report(report, scratch_path(spark, "summary") + ".json")
    counts = "map<string,double>"
    read = spark.read.schema(f"strategy_breakdown {counts}, category_breakdown {counts}").json(path)
    parts = [
        read.select(F.lit(s).alias("section"), F.explode(s).alias("key", "value"))
        for s in ("strategy_breakdown", "category_breakdown")
    ]
    return parts[0].unionByName(parts[1])


@query("latest_version", f"WITH {_T} SELECT case_id, 'second' AS written FROM t")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "versions")
    tickets = A.tickets(spark, sf_dir).select("case_id")
    for name in ("first", "second"):
        writers.write_parquet(
            tickets.withColumn("written", F.lit(name)), f"{folder}/{name}_classified.parquet"
        )
    return readers.read_newest_classified(spark, folder)


_COMBINED = "description || ' | ' || subject"


@query(
    "full_run",
    f"""WITH {_T}, m AS (SELECT case_id, subject, {_COMBINED} AS description, ingest_seq FROM t), kept AS (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_HASH} ORDER BY ingest_seq) AS rn FROM m) WHERE rn = 1),
    masked AS (SELECT {_masked("subject")} || ' ' || subject || ' ' || {_masked("description")} || ' ' || description
               AS searched FROM kept),
    d AS (SELECT {_first(lambda r: _quoted(r.assign_code))} AS code FROM masked)
    SELECT CASE WHEN code IS NULL THEN 'none' ELSE 'rules' END AS model_strategy, code AS predicted_code, count(*) AS n
    FROM d GROUP BY 1, 2""",
)
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through every stage, decided by the rules alone."""
    config = Config().under(scratch_path(spark, "run"))
    raw = A.raw_tickets(spark, sf_dir)
    paths = pipeline.run_pipeline(spark, raw, "documents", config, A.SAMPLE_RULES, embedder=None)
    labels = spark.read.parquet(paths["parquet_path"])
    return labels.groupBy("model_strategy", "predicted_code").agg(F.count(F.lit(1)).alias("n"))


@query("full_run_trained")
def full_run_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through every stage, with vectors, topics and a trained model."""
    config = Config().under(scratch_path(spark, "run"))
    raw = A.labelled_tickets(spark, sf_dir)
    paths = pipeline.run_pipeline(spark, raw, "documents", config, A.SAMPLE_RULES)
    return spark.read.parquet(paths["parquet_path"])
