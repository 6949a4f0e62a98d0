"""Mixing sources to target weights, exact to the word.

Sources in code point order (null last) weigh 5, 2, 1, repeating. Targets share all
words by weight; none exceeds ``MAX_TIMES`` times its source's words, and what is cut
off so is shared again by weight until nothing is above. The final level follows from
sorting sources by limit over weight: the first k stand at their limits, the rest share
what is left.

Within a source documents are put in the order of a hash of their id and text. The hash
range is split into fine bins, those into coarse bins; running sums of the words are
taken over coarse bins of a source, fine bins of a coarse bin and rows of a fine bin, so
a source with a third of all rows is spread over as many tasks as it has bins. The sum
before a document and the source's budget tell how much of it the mix takes: every whole
pass over the source, and what the last pass reaches. All of it is built-in functions on
narrow rows.

Sizes of null texts are 0, and such documents are never taken. Rows that share an id are
counted each; equal rows are interchangeable. Extra columns are not read. Tables without
words have targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.session import fresh, lookup, stored

WEIGHTS = (5, 2, 1)
MAX_TIMES = 3
#: Rows a fine bin would hold on average if all were of one source.
FINE_ROWS = 256


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """One row per source of ``sizes`` (source, source_size): with its target.

    The windows run over one row per source, not over documents.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("long")).withColumn("limit", max_times * F.col("source_size"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    steps = ranked.withColumns({
        "total": F.sum("source_size").over(every),
        "before": F.coalesce(F.sum("limit").over(upto), F.lit(0)),
        "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
    })
    # A source is at its limit when sharing the rest among it and all later ones passes the limit.
    level = (F.col("total") - F.col("before")).cast("double") / F.col("open")
    at_limit = level * F.col("weight") >= F.col("limit")
    steps = steps.withColumn("at_limit", at_limit)
    fixed = F.sum(F.when(F.col("at_limit"), F.col("limit")).otherwise(0)).over(every)
    free = F.sum(F.when(~F.col("at_limit"), F.col("weight")).otherwise(0)).over(every)
    share = (F.col("total") - fixed) * F.col("weight") / F.nullif(free, F.lit(0))
    return steps.select(
        "source", "source_size",
        F.when(F.col("at_limit"), F.col("limit").cast("double")).otherwise(share.cast("double")).alias("target"),
    )


def _bits(n_rows: int) -> int:
    """Leading bits of the hash that name a fine bin of about ``FINE_ROWS`` rows."""
    return min(32, max(0, (n_rows // FINE_ROWS).bit_length()))


def taken(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """``rows`` (source, hash, size and more, written by the caller) with source_size, target and taken."""
    fine = _bits(rows.count())
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    lead = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    rows = rows.withColumns({"_group": group, "_fine": F.shiftright(lead, 32 - fine)})
    bins = stored(rows.groupBy("_group", "_fine").agg(F.sum("size").alias("n"), F.first("source").alias("source")), "bins")
    own = bins.withColumn("_coarse", F.shiftright("_fine", fine // 2))
    whole = own.groupBy("_group", "_coarse").agg(F.sum("n").alias("n"), F.first("source").alias("source"))

    def upto(by: list[str], order: str) -> Column:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    coarse_start = whole.select("_group", "_coarse", upto(["_group"], "_coarse").alias("a"))
    fine_start = own.select("_group", "_coarse", "_fine", upto(["_group", "_coarse"], "_fine").alias("b"))
    per_source = whole.groupBy("_group").agg(F.first("source").alias("source"), F.sum("n").alias("source_size"))
    goal = targets(per_source.select("source", "source_size"), weights, max_times)
    goal = goal.withColumn("_group", group).drop("source")
    starts = (
        fine_start.join(coarse_start, ["_group", "_coarse"])
        .join(goal, "_group")
        .select("_group", "_fine", (F.col("a") + F.col("b")).alias("_start"), "source_size", "target")
    )
    inside = Window.partitionBy("_group", "_fine").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, ["_group", "_fine"]).withColumn("_at", F.col("_start") + F.col("_inside"))
    budget = F.floor("target")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - passes * F.col("source_size")
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("_at")))
    amount = (passes * F.col("size") + part).cast("long")
    return placed.withColumn("taken", amount).drop("_group", "_fine", "_inside", "_start", "_at")


def _hash(id_col: str, text_col: str, source_col: str) -> Column:
    parts = [F.col(id_col).cast("string"), F.col(source_col).cast("string"), F.md5(F.col(text_col))]
    known = [F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]
    return F.md5(F.concat_ws(" ", F.lit("mix"), *known))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Narrow rows of ``docs``: _id, source, size and hash (of id, source and text)."""
    return docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"),
        _hash(id_col, text_col, source_col).alias("hash"),
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken."""
    rows = taken(stored(keyed(docs, id_col, text_col, source_col), "sizes"))
    return rows.select(F.col("_id").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with their columns.

    Texts are not cut: the one document of a source that its budget divides comes once
    more if at least half of it is taken, so a source is off by half a document at most.
    """
    key, n = fresh(docs, "key"), fresh(docs, "times")
    hashed = docs.withColumn(key, _hash(id_col, text_col, source_col))
    rows = taken(stored(keyed(docs, id_col, text_col, source_col), "sizes"))
    twice = 2 * F.col("size")
    times = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / twice)).otherwise(F.lit(0))
    counted = rows.groupBy(F.col("hash").alias(key)).agg(F.sum(times).cast("int").alias(n), F.count("*").alias("_rows"))
    chosen = stored(counted.filter(F.col(n) > 0), "times")
    # Hashes of single rows are unique, so the join needs no salt beyond the broadcast bound.
    found = lookup(hashed, chosen.filter("_rows = 1").drop("_rows"), [key], "inner", salts=1)
    several = chosen.filter("_rows > 1").drop("_rows")
    if not several.isEmpty():
        # Equal rows are one document; it comes as often as all of them together.
        found = found.unionByName(lookup(hashed, several, [key], "inner").dropDuplicates([key]))
    repeated = found.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n))))
    return repeated.select(*[f"`{c}`" for c in docs.columns])
