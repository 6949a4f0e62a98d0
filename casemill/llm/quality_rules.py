"""Quality rules whose cut-offs follow the data of each language and source.

Every text gets counts (words, word characters, signs, repeated lines, words in repeated
three-word windows, capitals) and shares of them in whole parts of a thousand. The
quantile sketch of a share is its histogram over those at most 1001 values: sketches
merge by adding counts, give any quantile to a thousandth, and come out the same in
whatever order parts are merged. They are built per language and source over the texts
that pass the base rule; a group with fewer than ``MIN_ROWS`` such texts takes the merged
sketch of its language, and a small language that of all texts.

A share fails above its fence, q75 + REACH * max(q75 - q25, unit). The unit is data, too:
what a single event (one sign, one repeated line, two windows of repeated words, one
capital) makes in the short texts of the group, as the upper quartile of a sketch of its
own; where most texts have none of a kind, it says what one more would be. A group's
fence goes no further than twice its language's, and a language's than twice that of all
texts, so a source with much spam does not lift its own limit out of reach.

Everything runs on built-in functions; the cut-offs are one narrow row per group and are
joined through a size-checked lookup, so a source with a third of all rows is never one
task's work.

Null texts are empty: no words, base rule failed. Null languages and sources are groups
of their own. Rows are judged one by one, whatever their ids. Extra columns are kept
where whole rows are filtered, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.session import fresh, lookup, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_ROWS = 100
REACH = 5
#: How far a group's fence may lie beyond that of its language, and a language's beyond all.
BEYOND = 2
#: What is counted as one event of each kind; six words lie in two equal windows.
EVENT = {"signs": 1, "lines": 1, "repeats": 6, "capitals": 1}

# White space, signs and capitals that the counts are about.
WHITE = " \t\n\x0b\x0c\r"
SIGNS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    bare = F.btrim(text, F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""

    def windows(h: Column) -> Column:
        last = F.greatest(F.size(h) - 2, F.lit(0))
        spots = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            spots, lambda i: F.xxhash64(F.get(h, i - 1), F.get(h, i), F.get(h, i + 1))
        )

    def covered(p: Column) -> Column:
        gaps = F.zip_with(
            F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1),
            lambda a, b: F.least(F.lit(3), b - a),
        )
        return F.when(F.size(p) == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x))

    def twice(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, j: (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(True)
            | (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(True),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def count(h: Column) -> Column:
        spots = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_bind(_bind(spots, twice), covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _bind(_bind(hashes, windows), count).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts of one text."""
    whole = F.coalesce(text, F.lit(""))

    def counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"))

    dense = _without(whole, WHITE)
    lines = F.filter(F.split(whole, "\n"), lambda x: _without(x, WHITE) != "")
    return F.struct(
        _bind(word_list(whole), of_words).alias("w"),
        _bind(lines, counts).alias("l"),
        _bind(
            dense,
            lambda d: F.struct(
                F.length(d).cast("long").alias("word_chars"),
                (F.length(d) - F.length(_without(d, SIGNS))).cast("long").alias("n_symbols"),
                (F.length(d) - F.length(_without(d, CAPITALS))).cast("long").alias("n_capitals"),
            ),
        ).alias("c"),
    )


def _flat(docs: DataFrame, m: str) -> DataFrame:
    col = F.col
    n_words, repeats = col(f"{m}.w.n_words"), col(f"{m}.w.n_repeat_words")
    return docs.withColumns({
        "_q_words": n_words, "_q_chars": col(f"{m}.c.word_chars"), "_q_symbols": col(f"{m}.c.n_symbols"),
        "_q_dup": col(f"{m}.l.n_dup_lines"), "_q_repeat": repeats, "_q_capitals": col(f"{m}.c.n_capitals"),
        "_q_lines": col(f"{m}.l.n_lines"),
        "_q_failed": (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words),
    })


def measured(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with the counts, the group key and the base verdict as ``_q`` columns."""

    def key(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))

    found = docs.withColumns({"_qm": measures(F.col(text_col)), "_q_lang": key(lang_col), "_q_source": key(source_col)})
    return _flat(found, "_qm").drop("_qm")


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.floor(1000 * F.col(part) / F.nullif(F.col(whole), F.lit(0))), F.lit(0)).cast("long")


_PARTS = {
    "signs": ("_q_symbols", "_q_chars"), "lines": ("_q_dup", "_q_lines"), "repeats": ("_q_repeat", "_q_words"),
    "capitals": ("_q_capitals", "_q_chars"),
}


def _shares() -> dict[str, Column]:
    return {k: _share(*parts) for k, parts in _PARTS.items()}


def _units() -> dict[str, Column]:
    """What one event makes in a text, rounded up, in thousandths."""

    def unit(k: str) -> Column:
        one = F.floor(F.lit(1000 * EVENT[k]) / F.nullif(F.col(_PARTS[k][1]), F.lit(0))) + 1
        return F.when(one.isNull(), 0).otherwise(F.least(F.lit(1000), one)).cast("long")

    return {k: unit(k) for k in _PARTS}


def sketches(rows: DataFrame) -> DataFrame:
    """Histograms: _q_lang, _q_source, share, bin, n, over the texts that pass the base rule.

    ``share`` names a kind, or the unit of a kind ('signs unit').
    """
    kinds = _shares() | {f"{k} unit": v for k, v in _units().items()}
    pairs = F.array(*[F.struct(F.lit(k).alias("share"), v.alias("bin")) for k, v in kinds.items()])
    return (
        rows.filter(~F.col("_q_failed"))
        .select("_q_lang", "_q_source", F.inline(pairs))
        .groupBy("_q_lang", "_q_source", "share", "bin").agg(F.count("*").alias("n"))
    )


def _quartiles(merged: DataFrame, by: list[str]) -> DataFrame:
    """n, q25 and q75 of each merged sketch: the smallest bins that reach those parts of its rows."""
    own = Window.partitionBy(*by, "share")
    run = merged.withColumns({
        "upto": F.sum("n").over(own.orderBy("bin")), "total": F.sum("n").over(own),
    })
    reach = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bin")))
    return run.groupBy(*by, "share").agg(
        F.max("total").alias("rows"), reach(1).alias("q25"), reach(3).alias("q75")
    )


def cut_offs(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per language and source: _q_lang, _q_source and the highest share kept of each kind."""
    levels = [["_q_lang", "_q_source"], ["_q_lang"], []]
    joined = sketch.select("_q_lang", "_q_source").distinct()
    wide = lambda k, i: F.col(f"level{i}")[k]
    for i, by in enumerate(levels):
        merged = sketch.groupBy(*by, "share", "bin").agg(F.sum("n").alias("n"))
        part = _quartiles(merged, by)
        held = F.map_from_entries(F.collect_list(F.struct("share", F.struct("rows", "q25", "q75"))))
        part = part.groupBy(*by).agg(held.alias(f"level{i}"))
        joined = joined.join(part, by) if by else joined.join(F.broadcast(part))

    def fence(k: str, i: int) -> Column:
        q, unit = wide(k, i), wide(f"{k} unit", i)
        return q["q75"] + REACH * F.greatest(q["q75"] - q["q25"], unit["q75"])

    def most(k: str) -> Column:
        enough = lambda i: wide(k, i)["rows"] >= min_rows
        outer = F.when(enough(1), F.least(fence(k, 1), BEYOND * fence(k, 2))).otherwise(fence(k, 2))
        return F.when(enough(0), F.least(fence(k, 0), BEYOND * outer)).otherwise(outer)

    return joined.select("_q_lang", "_q_source", *[most(k).alias(f"_q_max_{k}") for k in _PARTS])


def judged(rows: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """``rows`` of ``measured``, written once by the caller, with ``_q_kept``.

    A group none of whose texts passes the base rule has no cut-offs and keeps nothing.
    """
    limits = stored(cut_offs(stored(sketches(rows), "sketches"), min_rows), "cutoffs")
    joined = lookup(rows, limits, ["_q_lang", "_q_source"], "left", salt_by=["_q_words", "_q_chars", "_q_symbols"])
    inside = ~F.col("_q_failed")
    for k, v in _shares().items():
        inside &= F.coalesce(v <= F.col(f"_q_max_{k}"), F.lit(False))
    return joined.withColumn("_q_kept", inside)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts, base_failed and kept; the texts are read once."""
    narrow = measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), "lang", "source")).drop("text")
    rows = judged(stored(narrow, "measures"))
    return rows.select(
        F.col("_id").alias(id_col), F.col("_q_words").alias("n_words"), F.col("_q_chars").alias("word_chars"),
        F.col("_q_symbols").alias("n_symbols"), F.col("_q_dup").alias("n_dup_lines"),
        F.col("_q_repeat").alias("n_repeat_words"), F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"),
    )


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns.

    A verdict depends on text, language and source alone, so narrow rows are judged and
    what fails is looked up by the digest of those three; texts are not written.
    """
    parts = [F.md5(F.col(text_col)), F.col(lang_col).cast("string"), F.col(source_col).cast("string")]
    digest = F.md5(F.concat_ws(" ", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]))
    narrow = docs.select(
        digest.alias("_q_key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source")
    )
    rows = judged(stored(measured(narrow).drop("text"), "measures"))
    key = fresh(docs, "key")
    failed = stored(rows.filter(~F.col("_q_kept")).select(F.col("_q_key").alias(key)).distinct(), "failed")
    return lookup(docs.withColumn(key, digest), failed, [key], "left_anti", salts=8).drop(key)
