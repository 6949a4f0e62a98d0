"""One query per operator over the sample tables, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import (
    conversation_repair,
    decontaminate,
    hard_negatives,
    jaccard_join,
    lm,
    mixture,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    token_files,
    url_filters,
    warc_audit,
)
from casemill.session import scratch_path, stored

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: secret scans --------------------------------------------------------------

#: What a reviewer of the sample marks as a secret: 40 hexadecimal digits in an assignment.
_REVIEWED = r'(?i)(?:key|token|secret)\s*=\s*"([0-9a-f]{40})"'


def reviewed_findings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Labelled findings: candidates of the learning documents, marked by the review."""
    learn = F.coalesce(F.crc32(F.col("k").cast("string")) % 4 != 2, F.lit(False))
    marked = docs.select(
        F.col("doc_id").alias("k"),
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_REVIEWED), F.lit(1)))).alias("text"),
    )
    marked = marked.select("k", F.sha2("text", 256).alias("value"), F.lit(1).alias("yes")).distinct()
    return found.filter(learn).select("k", "start", "value").join(marked, ["k", "value"], "left").select(
        "k", "start", F.coalesce("yes", F.lit(0)).alias("secret")
    )


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = stored(secret_scan.candidates(docs), "candidates")
    labels = stored(reviewed_findings(docs, found), "reviewed")
    scored = secret_scan.score(found, labels)
    return scored.select(
        F.col("k").alias("doc_id"), "start", "length", F.col("value").alias("value_sha256"), "score",
        (F.col("score") >= 0.5).alias("is_secret"),
    )


# --- 2: quality classifier -----------------------------------------------------


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = quality_classifier.held_out("doc_id")
    model = quality_classifier.fit(docs, labels.filter(~held_out))
    return quality_classifier.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


# --- 3: n-gram Jaccard join -----------------------------------------------------


@query("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


# --- 4: quality rules ----------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]+"

#: Counts of every text of {table}, then cut-offs per group as in quality_rules.
MEASURES_SQL = rf"""
  words AS (
    SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT rid, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM base)),
  triples AS (
    SELECT rid, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS t
    FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
  again AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM triples WHERE t IS NOT NULL)
    WHERE n > 1),
  repeats AS (
    SELECT rid, count(DISTINCT i + d) AS n_repeat_words
    FROM again, (SELECT unnest([0, 1, 2]) AS d) GROUP BY rid),
  lines AS (
    SELECT rid, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '{_WORD}')] AS l
    FROM base),
  counted AS (
    SELECT b.rid, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_words,
           length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[A-Z]', '', 'g')) AS n_capitals,
           len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM base b JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
  measured AS (
    SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
           coalesce(1000 * n_symbols // nullif(word_chars, 0), 0) AS s_signs,
           coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS s_lines,
           coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS s_repeats,
           coalesce(1000 * n_capitals // nullif(word_chars, 0), 0) AS s_capitals,
           coalesce(least(1000, 1000 // nullif(word_chars, 0) + 1), 0) AS u_signs,
           coalesce(least(1000, 1000 // nullif(n_lines, 0) + 1), 0) AS u_lines,
           coalesce(least(1000, 6000 // nullif(n_words, 0) + 1), 0) AS u_repeats,
           coalesce(least(1000, 1000 // nullif(word_chars, 0) + 1), 0) AS u_capitals
    FROM base JOIN counted USING (rid)),
  shares AS (
    UNPIVOT (SELECT lang, source, s_signs, s_lines, s_repeats, s_capitals, u_signs, u_lines, u_repeats, u_capitals
             FROM measured WHERE NOT base_failed)
    ON s_signs, s_lines, s_repeats, s_capitals, u_signs, u_lines, u_repeats, u_capitals INTO NAME share VALUE bin),
  own AS (
    SELECT lang, source, share, count(*) AS n, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75
    FROM shares GROUP BY ALL),
  by_lang AS (
    SELECT lang, share, count(*) AS n, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75
    FROM shares GROUP BY ALL),
  of_all AS (
    SELECT share, quantile_disc(bin, 0.25) AS q25, quantile_disc(bin, 0.75) AS q75 FROM shares GROUP BY ALL),
  fences AS (
    SELECT o.lang, o.source, substr(o.share, 3) AS share, o.n, l.n AS l_n,
           o.q75 + 5 * greatest(o.q75 - o.q25, ou.q75) AS own, l.q75 + 5 * greatest(l.q75 - l.q25, lu.q75) AS lang_,
           a.q75 + 5 * greatest(a.q75 - a.q25, au.q75) AS all_
    FROM own o
    JOIN own ou ON ou.share = 'u' || substr(o.share, 2) AND o.lang IS NOT DISTINCT FROM ou.lang
      AND o.source IS NOT DISTINCT FROM ou.source
    JOIN by_lang l ON o.share = l.share AND o.lang IS NOT DISTINCT FROM l.lang
    JOIN by_lang lu ON lu.share = ou.share AND o.lang IS NOT DISTINCT FROM lu.lang
    JOIN of_all a ON a.share = o.share JOIN of_all au ON au.share = ou.share
    WHERE starts_with(o.share, 's_')),
  wide AS (
    SELECT *, CASE WHEN l_n >= 100 THEN least(lang_, 2 * all_) ELSE all_ END AS outer_ FROM fences),
  cuts AS (
    SELECT *, CASE WHEN n >= 100 THEN least(own, 2 * outer_) ELSE outer_ END AS most FROM wide),
  tops AS (
    SELECT lang, source, max(most) FILTER (share = 'signs') AS m_signs, max(most) FILTER (share = 'lines') AS m_lines,
           max(most) FILTER (share = 'repeats') AS m_repeats, max(most) FILTER (share = 'capitals') AS m_capitals
    FROM cuts GROUP BY lang, source),
  judged AS (
    SELECT m.*, NOT base_failed AND coalesce(s_signs <= m_signs AND s_lines <= m_lines
                AND s_repeats <= m_repeats AND s_capitals <= m_capitals, false) AS kept
    FROM measured m LEFT JOIN tops t
      ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source)"""


@query("op4_quality_rules", f"""
WITH base AS (SELECT *, row_number() OVER () AS rid FROM documents), {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"))


# --- 5: URL filters --------------------------------------------------------------

SITES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
BLOCKED_WORDS = (
    "adult ads banner bets bonus casino cheap click doorway escort farm gambling jackpot loans lottery "
    "pharma pills poker porn sex spam torrent tracker viagra warez xxx"
).split()
URL_RULES = [*(url_filters.site(s, v) for s, v in SITES), *(url_filters.word(w) for w in BLOCKED_WORDS)]


def _sites_sql(value: Callable[[str, str], str]) -> str:
    arms = []
    for s, v in sorted(SITES, key=lambda x: -len(x[0])):
        host, _, path = s.partition("/")
        arms.append(
            f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN {value(s, v)}"
        )
    return "CASE " + " ".join(arms) + " END"


_WORD_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(host || path, '(^|[^A-Za-z0-9]){w}($|[^A-Za-z0-9])') THEN '{w}'" for w in BLOCKED_WORDS
) + " END"


@query("op5_url_filters", f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0
                         THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
    FROM pages),
  split AS (
    SELECT page_id, regexp_extract(rest, '^[^/]*') AS h, substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
    FROM cut),
  named AS (
    SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
  ruled AS (
    SELECT *, {_sites_sql(lambda s, v: f"'{s}'")} AS rule, {_sites_sql(lambda s, v: f"'{v}'")} AS ruling,
           {_WORD_SQL} AS word
    FROM named)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN word IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN word END AS pattern
FROM ruled""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("n_run")


# --- 6: benchmark decontamination ----------------------------------------------


@query("op6_decontaminate")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest().alias("items_sha256"), "contaminated",
    )


# --- 7: Merkle audit of WARC replicas ----------------------------------------------


def damaged(archive: DataFrame) -> DataFrame:
    """A replica of ``archive`` with every record lost or altered whose id says so."""
    fate = F.substring(F.md5(F.concat(F.lit("fate "), F.coalesce(F.col("id").cast("string"), F.lit("none")))), 1, 2)
    other = F.when(fate == "07", F.sha2("digest", 256)).otherwise(F.col("digest"))
    return archive.filter(fate != "0a").withColumn("digest", other)


@query("op7_warc_audit", r"""
WITH records AS (
    SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:'
           || coalesce(page_id::VARCHAR, 'none') || '>' || e || 'WARC-Target-URI: ' || coalesce(url, '') || e
           || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e
           || coalesce(html, '') || e || e AS record
    FROM pages, (SELECT chr(13) || chr(10) AS e)),
  leaves AS (
    SELECT coalesce((page_id // 65536) || '-' || substr(md5(record), 1, 2), 'none-' || substr(md5(record), 1, 4)) AS file,
           page_id AS id, sha256(record) AS digest, strlen(record) AS length, count(*) AS copies
    FROM records GROUP BY ALL),
  placed AS (
    SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY id, digest
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
           substr(md5('fate ' || coalesce(id::VARCHAR, 'none')), 1, 2) AS fate
    FROM leaves)
SELECT file, "offset", length::BIGINT AS length, id, CASE fate WHEN '07' THEN 'changed' ELSE 'missing' END AS state
FROM placed WHERE fate IN ('07', '0a')""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = stored(warc_audit.manifest(table(spark, sf_dir, "pages")), "manifest")
    return warc_audit.audit(archive, damaged(archive))


# --- 8: language-model scoring --------------------------------------------------


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.scores(docs, public_tokenizers.path(TOKENIZER), ~lm.held_out("doc_id"))


# --- 9: mixing sources ----------------------------------------------------------


@query("op9_mixture", rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
           md5('mix ' || coalesce('=' || doc_id, '-') || ' ' || coalesce('=' || source, '-') || ' '
               || coalesce('=' || md5(text), '-')) AS hash
    FROM documents),
  ranked AS (
    SELECT source, source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
           3 * source_size AS cap
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)),
  ordered AS (
    SELECT *, sum(source_size) OVER ()::BIGINT AS total,
           coalesce(sum(cap) OVER o, 0)::BIGINT AS before,
           (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS open
    FROM ranked
    WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  capped AS (SELECT *, (total - before)::DOUBLE / open * weight >= cap AS at_limit FROM ordered),
  goals AS (
    SELECT source, source_size,
           CASE WHEN at_limit THEN cap::DOUBLE
                ELSE (total - coalesce(sum(cap) FILTER (at_limit) OVER (), 0))::BIGINT * weight
                     / (sum(weight) FILTER (NOT at_limit) OVER ())::BIGINT END AS target
    FROM capped),
  placed AS (
    SELECT s.*, source_size, target,
           coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY hash
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
  passes AS (
    SELECT *, floor(target)::BIGINT AS budget,
           CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS passes
    FROM placed)
SELECT doc_id, size, source_size, target,
       (passes * size + least(size, greatest(0, budget - passes * source_size - pos)))::BIGINT AS taken
FROM passes""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.plan(table(spark, sf_dir, "documents"))


# --- 10: token ids in binary files ----------------------------------------------


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.checksums(spark, folder).withColumnRenamed("key", "doc_id")


# --- 11: best-fit packing ----------------------------------------------------------


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packed.select(
        F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


# --- 12: hard negatives -----------------------------------------------------------


@query("op12_hard_negatives", """
WITH taking AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  vectors AS (
    SELECT row_number() OVER () AS n, vec_id, label, list_transform(x, lambda v: floor(256 * v)) AS q
    FROM taking WHERE len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  scored AS (
    SELECT a.n AS anchor, a.vec_id AS anchor_id, b.n, b.vec_id, a.label = b.label AS same,
           list_dot_product(a.q, b.q)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.n <> b.n WHERE a.vec_id % 100 = 0),
  positives AS (
    SELECT anchor, anchor_id, n AS positive, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
  negatives AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY anchor, positive ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s USING (anchor)
    WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0, label=label)


# --- 13: conversation structure repair ----------------------------------------------


def damaged_turns(rows: DataFrame) -> DataFrame:
    """Turns damaged by a rule on their ids; ``here`` is false where a turn was dropped."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fate = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    copies = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    role = F.when(fate == 4, "user").otherwise(told("role"))
    return rows.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), (fate != 0).alias("here"), F.explode(copies).alias("copy")
    ).drop("copy")


#: crc32 by table, as DuckDB has none; then the cheapest edits backwards over the rows.
_REPAIR_SQL = r"""
WITH RECURSIVE steps AS (
    SELECT n, n AS c, 0 AS k FROM (SELECT unnest(range(256)) AS n)
    UNION ALL
    SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
  codes AS (SELECT list(c ORDER BY n) AS t FROM steps WHERE k = 8),
  keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations),
  fated AS (
    SELECT conv_id, turn, role, text, xor(list_reduce(
             [4294967295] || list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT),
             lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) % 20 AS fate
    FROM keyed, codes),
  damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
           CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
           unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM fated WHERE fate <> 0),
  ordered AS (
    SELECT *, rtrim(text, E' 	

') AS seen, left(role, 1) AS c,
           row_number() OVER o AS i,
           row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
           lag(left(role, 1)) OVER o || left(role, 1) AS pair
    FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
  judged AS (
    SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN again THEN 'duplicate'
                   WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
    FROM ordered),
  counted AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv_id),
  back AS (
    SELECT conv_id, n AS i, {'d': 0, 'e': '', 'l': ''} AS z, {'d': 6, 'e': 'II', 'l': E'
user:
assistant:'} AS s,
           {'d': 3, 'e': 'I', 'l': E'
assistant:'} AS u, {'d': 0, 'e': '', 'l': ''} AS a
    FROM counted
    UNION ALL
    SELECT conv_id, i, least(z, {'d': u2.d + 3, 'e': 'I' || u2.e, 'l': E'
user:' || u2.l}),
           least(s, {'d': u2.d + 3, 'e': 'I' || u2.e, 'l': E'
user:' || u2.l}), u2,
           least(a, {'d': u.d + 3, 'e': 'I' || u.e, 'l': E'
user:' || u.l})
    FROM (
        SELECT *, least(u, {'d': a.d + 3, 'e': 'I' || a.e, 'l': E'
assistant:' || a.l}) AS u2
        FROM (
            SELECT conv_id, i,
                   least(dz, CASE WHEN stays AND c = 's' THEN ks END, CASE WHEN stays AND c = 'u' THEN ku END, ru) AS z,
                   least(ds, CASE WHEN stays AND c = 'u' THEN ku END, ru) AS s,
                   least(du, CASE WHEN stays AND c = 'a' THEN ka END, ra) AS u,
                   least(da, CASE WHEN stays AND c = 'u' THEN ku END, ru) AS a
            FROM (
                SELECT b.conv_id, b.i - 1 AS i, c, fault IN ('', 'truncated') AS stays,
                       {'d': z.d + 4, 'e': 'D' || z.e, 'l': z.l} AS dz, {'d': s.d + 4, 'e': 'D' || s.e, 'l': s.l} AS ds,
                       {'d': u.d + 4, 'e': 'D' || u.e, 'l': u.l} AS du, {'d': a.d + 4, 'e': 'D' || a.e, 'l': a.l} AS da,
                       {'d': s.d + p, 'e': 'K' || s.e, 'l': line || s.l} AS ks,
                       {'d': u.d + p, 'e': 'K' || u.e, 'l': line || u.l} AS ku,
                       {'d': a.d + p, 'e': 'K' || a.e, 'l': line || a.l} AS ka,
                       CASE WHEN fault IN ('', 'truncated')
                            THEN {'d': u.d + p + 3, 'e': 'R' || u.e, 'l': E'
user:' || text || u.l} END AS ru,
                       CASE WHEN fault IN ('', 'truncated')
                            THEN {'d': a.d + p + 3, 'e': 'R' || a.e, 'l': E'
assistant:' || text || a.l} END AS ra
                FROM back b JOIN (
                    SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS p, chr(10) || role || ':' || text AS line
                    FROM judged) j
                  ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.i = b.i))))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.z.d, 0)::BIGINT AS cost, coalesce(b.z.e, '') AS audit,
       sha256(coalesce(substr(b.z.l, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0"""


@query("op13_conversation_repair", _REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged_turns(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(turns, present=F.col("here"))
