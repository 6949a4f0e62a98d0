"""Counts, coverage, confidence statistics and confusion metrics.

Every function returns a table whose size depends on the number of labels or
strategies only. Grouping is always partial-then-final, so a label that holds a
third of the rows costs each task one row of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casemill.functions import scores
from casemill.functions.scores import percent
from casemill.session import lookup, stored

HIGH_CONFIDENCE = 0.7
QUARTILES = (0.25, 0.5, 0.75)

# Up to this many values a percentile is taken in one aggregation buffer.
PERCENTILE_ROWS = 1_000_000

# Size of a quantile sketch: it only brackets the ranks, the second pass is exact.
SKETCH_K = 2_048


@dataclass(frozen=True)
class Columns:
    """Names of the classified table's columns."""

    truth: str = "current_category"
    predicted: str = "predicted_code"
    strategy: str = "model_strategy"
    confidence: str = "confidence"


DEFAULT = Columns()


def value_counts(df: DataFrame, column: str, drop_null: bool = True) -> DataFrame:
    """Rows per value, most frequent first."""
    kept = df.filter(F.col(column).isNotNull()) if drop_null else df
    counts = kept.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("value"))


def strategy_counts(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return value_counts(df, cols.strategy)


def category_counts(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return value_counts(df, cols.predicted)


def top_categories(df: DataFrame, n: int = 10, cols: Columns = DEFAULT) -> DataFrame:
    """The ``n`` most frequent categories, each with how many more there are."""
    counts = category_counts(df, cols)
    others = F.greatest(counts.agg(F.count(F.lit(1)) - n).scalar(), F.lit(0))
    # The window sees the n rows kept by the limit.
    in_order = W.orderBy(F.desc("n"), F.asc("value"))
    return counts.limit(n).select("value", "n", F.row_number().over(in_order).alias("rank"), others.alias("more"))


def shares(counts: DataFrame) -> DataFrame:
    """Percent of the total for a table of (value, n)."""
    total = F.sum("n").over(W.partitionBy())
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / total, 1))


def quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float] = QUARTILES,
    max_rows: int = PERCENTILE_ROWS,
    n: int | None = None,
) -> DataFrame:
    """One row (n, q0, q1, ...): exact percentiles with linear interpolation.

    ``n`` is the number of values, counted here unless the caller knows it.

    ``percentile`` gathers all distinct values in one buffer, so it serves short
    columns only. A longer one goes through ``grouped_quantiles``.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    n = values.count() if n is None else n
    names = [f"q{i}" for i in range(len(probs))]
    if n <= max_rows:
        every = F.percentile("v", F.array(*[F.lit(p) for p in probs]))
        return values.agg(F.count("v").alias("n"), every.alias("_q")).select(
            "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(names)]
        )

    return grouped_quantiles(df, column, probs)


def grouped_quantiles(
    df: DataFrame, column: str, probs: Sequence[float] = QUARTILES, by: Sequence[str] = (), k: int = SKETCH_K
) -> DataFrame:
    """Per group (by..., n, q0, q1, ...): exact percentiles of a column of any length.

    The first pass merges one quantile sketch per group, and each wanted rank is bracketed
    by two of its values. The second pass counts: values outside all brackets only by the
    gap they fall into, values inside by themselves. Their running count is taken over
    range partitions, so neither a group nor a bracket is ever one task's work, and a value
    that a third of the rows hold is one row. Passes do not depend on how many percentiles
    are asked for. Where a sketch has missed a rank, both are repeated with wider brackets.

    Nulls are left out; a group of nulls only has n = 0 and null percentiles. NaN counts as
    infinite. Without ``by`` there is one row, and with it one per group, null groups included.
    """
    keys = [f"g{i}" for i in range(len(by))]
    value = F.nanvl(F.col(column).cast("double"), F.lit(float("inf")))
    rows = df.select(*[F.col(c).alias(g) for c, g in zip(by, keys)], value.alias("v"))
    sketched = stored(
        rows.groupBy(*keys).agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", F.lit(k)).alias("sketch")), "sketches"
    )
    margin = 4.6 / k**0.9021  # twice the error that one rank in a hundred exceeds
    while True:
        found = _between_brackets(rows, sketched, keys, probs, margin, k)
        if found is not None:
            break
        margin *= 4
    names = [F.col(g).alias(c) for c, g in zip(by, keys)]
    return found.select(*names, "n", *[f"q{i}" for i in range(len(probs))])


def _between_brackets(
    rows: DataFrame, sketched: DataFrame, keys: list[str], probs: Sequence[float], margin: float, k: int
) -> DataFrame | None:
    """The percentiles read from between brackets ``margin`` wide; None if a rank is not inside."""
    places = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = [F.floor(x).cast("bigint") for x in places]
    nexts = [F.least(r + 1, F.col("n") - 1) for r in ranks]

    def edges(way: int) -> Column:
        shares = [min(1.0, max(0.0, float(p) + way * margin)) for p in probs]
        # A group not much larger than its sketch is taken whole.
        return F.array(*[
            F.when(F.col("n") > 4 * k, F.kll_sketch_get_quantile_double("sketch", F.lit(x))).otherwise(way * float("inf"))
            for x in shares
        ])

    brackets = sketched.filter("n > 0").select(*keys, edges(-1).alias("lows"), edges(1).alias("highs"))
    there = rows.filter(F.col("v").isNotNull())
    if keys:
        # A null group joins like any other through its list of values.
        key = F.array(*[F.array_compact(F.array(F.col(g).cast("string"))) for g in keys])
        marked = lookup(there.withColumn("key", key), brackets.withColumn("key", key).drop(*keys), ["key"], "inner").drop("key")
    else:
        held = brackets.head()
        sides = {c: F.array(*[F.lit(x) for x in (held[c] if held else [])]).cast("array<double>") for c in ("lows", "highs")}
        marked = there.withColumns(sides)
    inside = F.exists(F.arrays_zip("lows", "highs"), lambda b: (F.col("v") >= b["lows"]) & (F.col("v") <= b["highs"]))
    gap = F.size(F.filter("highs", lambda h: h < F.col("v")))
    counted = marked.select(*keys, F.when(inside, F.col("v")).alias("own"), F.when(~inside, gap).alias("gap"), "v")
    counted = counted.groupBy(*keys, "own", "gap").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("at"))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(counted.repartitionByRange(parts, *keys, "at").withColumn("part", F.spark_partition_id()), "counted")
    sums = dealt.groupBy("part", *keys).agg(F.sum("c").alias("c"))
    earlier = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("part", *keys, F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"))
    upto = F.sum("c").over(W.partitionBy("part", *keys).orderBy("at"))
    same = [F.col(f"d.{g}").eqNullSafe(F.col(f"s.{g}")) for g in ("part", *keys)]
    running = dealt.withColumn("upto", upto).alias("d").join(before.alias("s"), same)
    running = running.select(*[f"d.{g}" for g in keys], "own", "c", (F.col("upto") + F.col("before")).alias("upto"))
    same = [F.col(f"r.{g}").eqNullSafe(F.col(f"n.{g}")) for g in keys] or [F.lit(True)]
    sizes = F.broadcast(sketched.drop("sketch")) if not keys else sketched.drop("sketch")
    ranked = running.alias("r").join(sizes.alias("n"), same).select(*[f"r.{g}" for g in keys], "n", "own", "c", "upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col("own")))

    both = ranked.groupBy(*keys, "n").agg(
        *[at(r).alias(f"a{i}") for i, r in enumerate(ranks)], *[at(r).alias(f"b{i}") for i, r in enumerate(nexts)]
    )
    both = stored(both, "ranked")
    missed = F.lit(False)
    for i in range(len(probs)):
        missed |= F.col(f"a{i}").isNull() | F.col(f"b{i}").isNull()
    if not both.filter(missed).isEmpty():
        return None
    values = [
        F.when((F.col(f"a{i}") == F.col(f"b{i}")) | (places[i] == ranks[i]), F.col(f"a{i}"))
        .otherwise(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (places[i] - ranks[i])).alias(f"q{i}")
        for i in range(len(probs))
    ]
    none = sketched.filter("n = 0").select(*keys, "n", *[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probs))])
    return both.select(*keys, "n", *values).unionByName(none)


def moments(column: str) -> list[Column]:
    """Count, mean, sample deviation, min and max, for one global aggregation."""
    c = F.col(column).cast("double")
    return [
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
    ]


def describe(
    df: DataFrame, column: str = "confidence", max_rows: int = PERCENTILE_ROWS, known: Row | None = None
) -> DataFrame:
    """One row: count, mean, sample deviation, min, quartiles, max.

    ``known`` is a row that already holds the moments.
    """
    row = known or df.agg(*moments(column)).head()
    found = quantiles(df, column, QUARTILES, max_rows, row["count"])
    given = {c: F.lit(row[c]).cast("double").alias(c) for c in ("mean", "std", "min", "max")}
    return found.select(
        F.col("n").alias("count"),
        given["mean"],
        given["std"],
        given["min"],
        F.col("q0").alias("p25"),
        F.col("q1").alias("p50"),
        F.col("q2").alias("p75"),
        given["max"],
    )


def histogram(df: DataFrame, column: str = "confidence", bins: int = 10) -> DataFrame:
    """Rows per equal-width bin of [0, 1]; 1.0 belongs to the last bin."""
    at = F.least(F.floor(F.round(F.col(column) * bins, 9)), F.lit(bins - 1)).cast("int")
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
    )


def coverage_aggregates(cols: Columns = DEFAULT, threshold: float = HIGH_CONFIDENCE) -> dict[str, Column]:
    """All scalar coverage figures, for one global aggregation."""
    total = F.count(F.lit(1))
    by_strategy = F.count_if(F.col(cols.strategy) != "none")
    by_code = F.count(cols.predicted)
    high = F.count_if(scores.at_least(F.col(cols.confidence), threshold))
    return {
        "total": total,
        "classified_by_strategy": by_strategy,
        "coverage_by_strategy": percent(by_strategy, total),
        "classified_by_code": by_code,
        "unclassified_by_code": total - by_code,
        "coverage_by_code": percent(by_code, total),
        "high_confidence": high,
        "high_confidence_percentage": percent(high, total),
    }


def coverage(df: DataFrame, names: Sequence[str], cols: Columns = DEFAULT, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    figures = coverage_aggregates(cols, threshold)
    return df.agg(*[figures[n].alias(n) for n in names])


def coverage_by_strategy(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return coverage(df, ["total", "classified_by_strategy", "coverage_by_strategy"], cols)


def coverage_by_code(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    return coverage(
        df, ["total", "classified_by_code", "unclassified_by_code", "coverage_by_code"], cols
    )


def high_confidence(df: DataFrame, cols: Columns = DEFAULT, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    return coverage(df, ["total", "high_confidence", "high_confidence_percentage"], cols, threshold)


def outcome_counts(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Total, by rules, by model, unclassified."""
    strategy = F.col(cols.strategy)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(strategy == "rules").alias("rules"),
        F.count_if(strategy == "ml_model").alias("ml_model"),
        F.count_if(strategy == "none").alias("unclassified"),
    )


def evaluable(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows with a prediction and a truth that is not blank."""
    return df.filter(
        F.col(cols.predicted).isNotNull() & F.col(cols.truth).isNotNull() & (F.col(cols.truth) != "")
    )


def confusion(df: DataFrame, cols: Columns = DEFAULT) -> DataFrame:
    """Rows per (y_true, y_pred) that occur."""
    return (
        evaluable(df, cols)
        .groupBy(F.col(cols.truth).alias("y_true"), F.col(cols.predicted).alias("y_pred"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_labels(cells: DataFrame) -> DataFrame:
    """Sorted union of true and predicted labels."""
    both = cells.select(F.explode(F.array("y_true", "y_pred")).alias("label"))
    return both.distinct().orderBy("label")


def confusion_dense(cells: DataFrame) -> DataFrame:
    """Every pair of labels, with zeros. The output is labels squared by nature.

    The label list is gathered into one array, so the grid is an explode of it.
    """
    labels = F.array_sort(F.collect_set("label"))
    grid = (
        confusion_labels(cells)
        .agg(labels.alias("labels"))
        .select(F.explode("labels").alias("y_true"), "labels")
        .select("y_true", F.explode("labels").alias("y_pred"))
    )
    return grid.join(cells, ["y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_wide(cells: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per true label, one column per predicted label."""
    if labels is None:
        labels = [r["label"] for r in confusion_labels(cells).collect()]
    rows = confusion_labels(cells).select(F.col("label").alias("y_true"))
    pivoted = cells.groupBy("y_true").pivot("y_pred", list(labels)).agg(F.sum("n"))
    joined = rows.join(pivoted, "y_true", "left")
    return joined.select("y_true", *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in labels])


def accuracy(cells: DataFrame) -> DataFrame:
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    return cells.agg(
        F.round(right / F.sum("n"), 3).alias("accuracy"), F.sum("n").alias("support")
    )


def per_label(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label; a zero divisor gives 0."""
    hit = F.when(F.col("side") == F.col("other"), F.col("n")).otherwise(0)
    sides = [
        F.struct(
            F.col(side).alias("side"), F.col(other).alias("other"), "n", F.lit(side == "y_true").alias("truth")
        )
        for side, other in (("y_true", "y_pred"), ("y_pred", "y_true"))
    ]
    sums = (
        cells.select(F.inline(F.array(*sides)))
        .groupBy(F.col("side").alias("label"))
        .agg(
            F.sum(F.when(F.col("truth"), hit).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("truth"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("truth"), F.col("n")).otherwise(0)).alias("predicted"),
        )
    )

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return sums.select(
        "label",
        ratio(tp, predicted).alias("precision"),
        ratio(tp, support).alias("recall"),
        ratio(2 * tp, support + predicted).alias("f1"),
        "support",
    )


def _averages(labels: DataFrame, weighted: bool) -> list[Column]:
    weight = F.col("support") if weighted else F.lit(1)
    return [(F.sum(F.col(m) * weight) / F.sum(weight)).alias(m) for m in ("precision", "recall", "f1")]


def weighted_scores(cells: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1, three decimals."""
    means = per_label(cells).agg(*_averages(cells, True))
    return means.select(*[F.round(m, 3).alias(m) for m in ("precision", "recall", "f1")])


def class_report(cells: DataFrame) -> DataFrame:
    """The per-label scores followed by accuracy, macro and weighted averages."""
    labels = per_label(cells)
    total = F.sum("support").alias("support")
    right = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)) / F.sum("n")
    overall = cells.agg(right.alias("a"), F.sum("n").alias("support")).select(
        F.lit("accuracy").alias("label"),
        *[F.col("a").alias(m) for m in ("precision", "recall", "f1")],
        "support",
    )
    rows = [labels, overall]
    for name, weighted in (("macro avg", False), ("weighted avg", True)):
        means = labels.agg(*_averages(labels, weighted), total)
        rows.append(means.select(F.lit(name).alias("label"), "precision", "recall", "f1", "support"))
    return reduce(DataFrame.unionByName, rows)


def profile(df: DataFrame) -> DataFrame:
    """Row count and column list."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"n_columns": F.lit(len(df.columns)), "columns": F.lit(",".join(df.columns))}
    )
