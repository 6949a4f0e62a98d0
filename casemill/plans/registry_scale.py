"""Queries of the operators that search, match and count without trying everything."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.functions import vectors as V
from casemill.operators import calibrate, graph_axes, hierarchy, metrics, rule_index, skipping
from casemill.operators import rules as R
from casemill.plans import adapters as A
from casemill.plans.registry import _C, _RULED, _TICKET_DIGEST, TOPK_SQL, _digest, query
from casemill.session import plan_bytes, scratch_path, stored
from casemill.sources import readers, writers

# --- Density with a hierarchy ------------------------------------------------------

_UNIT = """u AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i,
         list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(
           list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
d AS (SELECT a.i, b.i AS j, a.vec_id, CAST(list_distance(a.v, b.v) AS DOUBLE) AS d FROM u a JOIN u b ON a.i <> b.i),
c AS (SELECT i, any_value(vec_id) AS vec_id, list(d ORDER BY d)[5] AS core FROM d GROUP BY i)"""


def unit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.vectors(spark, sf_dir).select("case_id", V.unit(F.col("embedding"), "double").alias("point"))


@query("hierarchy_cores", f"WITH {_UNIT} SELECT 'D' || vec_id AS case_id, round(core, 6) AS core FROM c")
def hierarchy_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every vector to its fifth neighbour."""
    cores, _ = hierarchy.reachability(unit_points(spark, sf_dir))
    return cores.select("case_id", F.round("core", 6).alias("core"))


@query(
    "hierarchy_tree",
    f"""WITH RECURSIVE {_UNIT},
    w AS (SELECT d.i, list(greatest(d.d, a.core, b.core) ORDER BY d.j) AS w
          FROM d JOIN c a ON a.i = d.i JOIN c b ON b.i = d.j GROUP BY d.i),
    m AS (SELECT i, list_concat(w[:i - 1], [1e300::DOUBLE], w[i:]) AS w, len(w) + 1 AS n FROM w),
    prim AS (
      SELECT 0 AS k, w AS reach, [1::BIGINT] AS inside, 0.0::DOUBLE AS total FROM m WHERE i = 1
      UNION ALL
      SELECT k + 1, list_transform(list_zip(reach, m.w), lambda p: least(p[1], p[2])), list_append(inside, m.i), total + best
      FROM (
        SELECT *, list_min(free) AS best, list_position(free, list_min(free)) AS at
        FROM (SELECT *, list_transform(reach, lambda x, i: CASE WHEN list_contains(inside, i) THEN 1e301 ELSE x END) AS free
              FROM prim WHERE len(inside) < len(reach))) p
      JOIN m ON m.i = p.at)
    SELECT max(k)::BIGINT AS edges, round(max(total), 5) AS weight FROM prim""",
)
def hierarchy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and weight of the spanning tree under mutual reachability."""
    _, tree = hierarchy.reachability(unit_points(spark, sf_dir))
    return tree.agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("weight"), 5).alias("weight"))


@query("topics_hierarchy")
def topics_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.topics_by_hierarchy(A.vectors(spark, sf_dir))


# --- Search that skips ---------------------------------------------------------------


@query("vector_topk_index", TOPK_SQL)
def vector_topk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five of every vector through the index of pivots and blocks."""
    held = A.table(spark, sf_dir, "embeddings")
    index = skipping.build(held.select(F.col("vec_id").alias("case_id"), "embedding"))
    hits, _ = skipping.search(index, held.select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return hits.withColumn("similarity", F.round("similarity", 6))


# --- Percentiles ----------------------------------------------------------------------


@query(
    "price_quantiles_by_flag",
    """SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n,
         round(quantile_cont(l_extendedprice, 0.01), 6) AS q0, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1,
         round(quantile_cont(l_extendedprice, 0.5), 6) AS q2, round(quantile_cont(l_extendedprice, 0.9), 6) AS q3,
         round(quantile_cont(l_extendedprice, 0.999), 6) AS q4
       FROM lineitem GROUP BY 1, 2""",
)
def price_quantiles_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five exact percentiles of every group, in the two passes that one would take."""
    probs = (0.01, 0.25, 0.5, 0.9, 0.999)
    found = metrics.grouped_quantiles(
        A.table(spark, sf_dir, "lineitem"), "l_extendedprice", probs, ("l_returnflag", "l_linestatus")
    )
    return found.select("l_returnflag", "l_linestatus", "n", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(5)])


# --- Rules behind their literals --------------------------------------------------------


def many_rules() -> list[R.Rule]:
    """The sample's rules in their order, among 5,000 that look for what no ticket says."""
    out: list[R.Rule] = []
    for i in range(5_000):
        if i % 400 == 0 and i // 400 < len(A.SAMPLE_RULES):
            out.append(A.SAMPLE_RULES[i // 400])
        pattern = (f"error {i}7q", f"(?:reset|reboot) unit {i}x[0-9]+", f"part-{i}q(ab|cd)+", f"{i}zq.*{i}zq")[i % 4]
        out.append(R.Rule(f"N{i}", pattern, f"N.{i}", "None such", 0.5, case_sensitive=i % 3 == 0))
    out += A.SAMPLE_RULES[13:]
    return [dataclasses.replace(r, rule_order=n) for n, r in enumerate(out)]


@query(
    "rules_by_literals",
    f"WITH {_RULED} SELECT case_id, rule_code, rule_name, rule_confidence, rule_id, true AS few FROM k",
)
def rules_by_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First match among 5,000 rules; no ticket tries more than a hundredth of them."""
    found = rule_index.apply_indexed(A.tickets(spark, sf_dir), many_rules(), tried="tried")
    return found.select("case_id", *R.VERDICT_FIELDS, (F.col("tried") <= 50).alias("few"))


# --- CSV in parallel ------------------------------------------------------------------------

_SPLIT = "spark.sql.files.maxPartitionBytes"
# Splits are this small on little input only; their number is bounded until the session's own size.
LEAST_SPLIT, SPLITS = 64 << 10, 512


def split_bytes(spark: SparkSession, path: str) -> int:
    """The size of a split that cuts ``path`` into many, at most the session's."""
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return min(most, max(LEAST_SPLIT, plan_bytes(spark.read.text(path)) // SPLITS))


@query("csv_split_roundtrip", _TICKET_DIGEST)
def csv_split_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV with line breaks in quotes, each file read in many splits."""
    path = writers.write_csv(A.tickets(spark, sf_dir), scratch_path(spark, "tickets") + ".csv")
    before = spark.conf.get(_SPLIT)
    spark.conf.set(_SPLIT, str(split_bytes(spark, path)))
    try:
        return _digest(stored(readers.read_tickets_csv(spark, path, split=True), "read"))
    finally:
        spark.conf.set(_SPLIT, before)


# --- The neighbour graph and its axes ----------------------------------------------------------


@query(
    "neighbour_graph",
    """WITH u AS (
      SELECT 'D' || vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(
        list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS v FROM embeddings),
    s AS (SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 9) AS s FROM u a JOIN u b ON a.id <> b.id),
    near AS (SELECT a, b, greatest(s, 1e-6) AS w FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 15)
    SELECT a, b, round(sum(w) / 2, 6) AS weight FROM (SELECT a, b, w FROM near UNION ALL SELECT b, a, w FROM near)
    GROUP BY a, b""",
)
def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symmetric links of every vector to its fifteen nearest."""
    return graph_axes.neighbour_links(A.vectors(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("reduce_graph")
def reduce_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_axes.reduce_graph(A.vectors(spark, sf_dir))


@query("reduce_graph_check", "SELECT unnest(range(5))::INTEGER AS axis, true AS small, true AS spread FROM (SELECT 1) WHERE EXISTS (FROM embeddings)")
def reduce_graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every axis is an eigenvector of the graph, by joins over its links, and no axis is flat."""
    vectors = A.vectors(spark, sf_dir)
    graph = graph_axes.landmark_graph(vectors)
    found = graph_axes.axes(graph)
    points = stored(graph_axes.reduce_graph(vectors), "points")
    left = graph_axes.residuals(graph_axes.links(spark, graph), points, found.value)
    sizes = points.select(F.posexplode("point").alias("axis", "x")).groupBy("axis").agg(F.stddev_pop("x").alias("s"))
    return left.join(sizes, "axis").select("axis", (F.col("residual") < 1e-6).alias("small"), (F.col("s") > 0.1).alias("spread"))


# --- Calibrated confidence -----------------------------------------------------------------------

_CURVE = f"""{_C},
s AS (SELECT confidence, truth = predicted AS hit, supplier,
        CAST(least(greatest(floor(round(confidence * 100, 9)), 0), 99) AS INTEGER) AS bin
      FROM c WHERE confidence IS NOT NULL AND truth IS NOT NULL AND predicted IS NOT NULL),
b AS (SELECT bin, count(*) AS n, count(*) FILTER (WHERE hit) AS good FROM s
      WHERE CAST(substr(supplier, 2) AS BIGINT) % 2 = 0 GROUP BY bin),
m AS (SELECT lo.bin AS a, hi.bin AS z, sum(b.good) / sum(b.n) AS share
      FROM b lo JOIN b hi ON hi.bin >= lo.bin JOIN b ON b.bin BETWEEN lo.bin AND hi.bin GROUP BY lo.bin, hi.bin),
v AS (SELECT bin, max(least_) AS value FROM (
        SELECT b.bin, m.a, min(m.share) AS least_ FROM b JOIN m ON m.a <= b.bin AND m.z >= b.bin GROUP BY b.bin, m.a)
      GROUP BY bin)"""


def _hit() -> Column:
    return F.col("truth") == F.col("predicted")


def _half(spark: SparkSession, sf_dir: str, rest: int) -> DataFrame:
    """Classified rows of every second supplier."""
    return A.classified(spark, sf_dir).filter(F.substring("supplier", 2, 20).cast("bigint") % 2 == rest)


@query("calibration_curve", f"WITH {_CURVE} SELECT bin, n, good AS right, round(value, 9) AS value FROM b JOIN v USING (bin)")
def calibration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Right ones and calibrated value per bin of confidence, by pooling adjacent violators."""
    rows = _half(spark, sf_dir, 0)
    curve = calibrate.fit(rows, "confidence", _hit())
    held = calibrate.counts(rows, "confidence", _hit())
    return held.withColumn("value", F.round(calibrate.calibrated((F.col("bin") + 0.5) / 100, curve), 9))


_FAR = """SELECT sum(n) AS n, sum(n * far) / sum(n) AS error FROM (
  SELECT count(*) AS n, abs(avg({0}) - avg(CAST(hit AS INTEGER))) AS far FROM t
  GROUP BY least(greatest(floor(round({0} * 10, 9)), 0), 9))"""


@query(
    "calibration_error",
    f"""WITH {_CURVE},
    t AS (SELECT CAST(confidence AS DOUBLE) AS raw, value AS cal, hit FROM s JOIN v USING (bin)
          WHERE CAST(substr(supplier, 2) AS BIGINT) % 2 = 1),
    r AS ({_FAR.format("raw")}), k AS ({_FAR.format("cal")})
    SELECT CAST(r.n AS BIGINT) AS n, round(r.error, 6) AS raw_error, round(k.error, 6) AS calibrated_error,
           k.error < r.error AS better FROM r, k""",
)
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far confidence is from accuracy on rows that the curve has not seen, before and after."""
    curve = calibrate.fit(_half(spark, sf_dir, 0), "confidence", _hit())
    rows = _half(spark, sf_dir, 1)
    raw = calibrate.error(rows, "confidence", _hit()).select("n", F.col("error").alias("raw"), F.lit(1).alias("one"))
    after = calibrate.error(rows, calibrate.calibrated(F.col("confidence"), curve), _hit())
    both = raw.join(after.select(F.col("error").alias("cal"), F.lit(1).alias("one")), "one")
    return both.select(
        "n", F.round("raw", 6).alias("raw_error"), F.round("cal", 6).alias("calibrated_error"),
        (F.col("cal") < F.col("raw")).alias("better"),
    )
