"""Benchmark decontamination by a positional inverted index of the training texts.

Each task turns its documents into index rows: for every test term that occurs, the
sorted positions of its tokens, within about a megabyte of neighbouring documents. The
index is written to the shared folder. A window of ``WINDOW`` test words is looked up
from its rarest terms on: their position lists, each moved back by the term's offset in
the window, are intersected, so a start that is left at the end is an exact occurrence.
Lists stay within the documents they index; nothing but index rows is ever moved, and a
very common passage costs one list entry per occurrence.

The test set is a stated query set. It is taken in blocks of ``BLOCK_WORDS`` words, so
what is broadcast has a fixed bound whatever its size.

Null texts and texts without words have no words and no hits. Rows that share a
document id, null ids included, are judged one by one. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import texts as X
from casemill.session import fresh, lookup, stored

WINDOW = 13
BLOCK_WORDS = 2_000_000
INDEX_BYTES = 1_000_000


class Queries(NamedTuple):
    """Windows of test items over a sorted list of terms.

    ``terms[w]`` holds the term numbers of window ``w`` in order, -1 after its end.
    """

    vocabulary: np.ndarray
    terms: np.ndarray
    length: np.ndarray
    item: np.ndarray
    item_ids: list


def _item_windows(item_ids: list, hashes: list[np.ndarray], size: int) -> Queries:
    vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
    rows, length, item = [np.zeros((0, size), np.int64)], [], []
    for i, h in enumerate(hashes):
        if not len(h):
            continue
        at = np.searchsorted(vocabulary, h)
        if len(h) < size:
            window = np.full((1, size), -1, np.int64)
            window[0, : len(h)] = at
        else:
            window = np.lib.stride_tricks.sliding_window_view(at, size)
        rows.append(window)
        length += [min(size, len(h))] * len(window)
        item += [i] * len(window)
    return Queries(vocabulary, np.concatenate(rows), np.array(length, np.int64), np.array(item, np.int64), item_ids)


def block_count(benchmark: DataFrame, text_col: str = "text", block_words: int = BLOCK_WORDS) -> int:
    """Blocks that hold ``block_words`` words each if words have two characters with their gap."""
    total = benchmark.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-total // (2 * block_words)))


def query_block(
    benchmark: DataFrame, number: int, blocks: int, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW
) -> Queries:
    """The windows of one block of the test set; items are dealt to blocks by their hash."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == number).collect()
    found = X.words(pa.array([r["t"] for r in part], pa.string()), X.NOT_ALNUM)
    hashes = np.split(found.hash, found.first[1:-1]) if part else []
    return _item_windows([r["i"] for r in part], hashes, size)


def build_index(docs: DataFrame, vocabulary: np.ndarray, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows of ``docs`` for the terms of ``vocabulary``.

    Columns: keys and words (of the row's documents, in order), terms (numbers of the
    terms that occur), counts (tokens of each), positions (steps between the sorted
    positions of each term, counted from the row's first word).
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    held = spark.sparkContext.broadcast(vocabulary)
    kind = source.schema["k"].dataType.simpleString()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in batches:
            for slab in X.slabs(batch, "t", INDEX_BYTES):
                w = X.words(slab.column("t"), X.NOT_ALNUM)
                at = np.searchsorted(wanted, w.hash)
                at[at == len(wanted)] = 0
                place = np.flatnonzero(wanted[at] == w.hash) if len(wanted) else np.zeros(0, np.int64)
                order = np.argsort(at[place], kind="stable")
                place, term = place[order], at[place][order]
                terms, first, counts = np.unique(term, return_index=True, return_counts=True)
                steps = np.diff(place, prepend=0)
                steps[first] = place[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, slab.num_rows], pa.int32()), slab.column("k")),
                        pa.array([w.per_doc.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([terms.astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([counts.astype(np.uint32).tobytes()], pa.binary()),
                        pa.array([steps.astype(np.uint32).tobytes()], pa.binary()),
                    ],
                    names=["keys", "words", "terms", "counts", "positions"],
                )

    return source.mapInArrow(
        index, f"keys array<{kind}>, words array<int>, terms binary, counts binary, positions binary"
    )


def term_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many tokens of each term the index holds, over all its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts"), strict=True):
                at = np.frombuffer(terms.as_py(), np.uint32)
                total[at] += np.frombuffer(counts.as_py(), np.uint32)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["term", "n"])

    # One row per test term at most, so the bound is that of a query block.
    rows = index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(n_terms, np.int64)
    for r in rows.toLocalIterator():
        out[r["term"]] = r["n"]
    return out


class _Row:
    """One index row, its lists unpacked on request."""

    def __init__(self, words: np.ndarray, terms: bytes, counts: bytes, steps: bytes, n_terms: int):
        self.first = np.concatenate(([0], np.cumsum(words)))
        at = np.frombuffer(terms, np.uint32)
        self.count = np.zeros(n_terms, np.int64)
        self.count[at] = np.frombuffer(counts, np.uint32)
        self.begin = np.zeros(n_terms, np.int64)
        self.begin[at] = np.cumsum(self.count[at]) - self.count[at]
        self.steps = np.frombuffer(steps, np.uint32)

    def positions(self, term: int) -> np.ndarray:
        b = self.begin[term]
        return np.cumsum(self.steps[b : b + self.count[term]], dtype=np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1

    def starts(self, terms: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Starts of exact occurrences, by intersecting moved lists, rarest first."""
        found = self.positions(terms[order[0]]) - order[0]
        for j in order[1:]:
            if not len(found):
                return found
            other = self.positions(terms[j])
            at = np.searchsorted(other, found + j)
            at[at == len(other)] = 0
            found = found[other[at] == found + j]
        return found[self.document(found) == self.document(found + len(terms) - 1)]

    def near(self, terms: np.ndarray, order: np.ndarray, slop: int) -> np.ndarray:
        """Places of the rarest term around which all others lie within ``slop`` of their
        offsets, in the same document."""
        found = self.positions(terms[order[0]])
        for j in order[1:]:
            goal, doc = found + j - order[0], self.document(found)
            low, high = np.maximum(goal - slop, self.first[doc]), np.minimum(goal + slop, self.first[doc + 1] - 1)
            other = self.positions(terms[j])
            found = found[np.searchsorted(other, low) < np.searchsorted(other, high, side="right")]
            if not len(found):
                break
        return found


def _ship(spark: SparkSession, queries: Queries, often: np.ndarray) -> Broadcast:
    """The test block for ``_held``, as plain arrays: workers need no copy of this package."""
    small = queries._replace(terms=queries.terms.astype(np.int32), item=queries.item.astype(np.int32))
    return spark.sparkContext.broadcast((tuple(small), often))


def _held(sent: Broadcast) -> tuple[Queries, np.ndarray]:
    parts, often = sent.value
    return Queries(*parts), often


def _named(item: object, whole: bool) -> object:
    return item if whole or item is None else str(item)


def matches(index: DataFrame, queries: Queries, slop: int | None = None) -> DataFrame:
    """Every occurrence of a window: key, row (place of the document in its index row),
    item_id, kind ('exact', or 'near' with ``slop``), start (word number in the document)
    and words (length of the window).
    """
    spark = index.sparkSession
    n_terms = len(queries.vocabulary)
    frequency = _ship(spark, queries, term_counts(index, n_terms))
    key = index.schema["keys"].dataType.elementType.simpleString()
    whole = all(isinstance(i, int) for i in queries.item_ids)
    item, text = ("long", pa.int64()) if whole else ("string", pa.string())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, often = _held(frequency)
        for batch in batches:
            for r in range(batch.num_rows):
                out: list[list] = [[], [], [], [], [], []]
                for w, kind, place, row in _occurrences(batch, r, q, often, slop):
                    doc = row.document(place)
                    keys = batch.column("keys")[r].values
                    out[0].append(keys.take(pa.array(doc)))
                    out[1].append(doc)
                    out[2].append(np.full(len(doc), q.item[w]))
                    out[3] += [kind] * len(doc)
                    out[4].append(place - row.first[doc])
                    out[5].append(np.full(len(doc), q.length[w]))
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.concat_arrays(out[0]), pa.array(np.concatenate(out[1])),
                            pa.array([_named(q.item_ids[i], whole) for i in np.concatenate(out[2])], text), pa.array(out[3]),
                            pa.array(np.concatenate(out[4])), pa.array(np.concatenate(out[5])),
                        ],
                        names=["key", "row", "item_id", "kind", "start", "words"],
                    )

    return index.mapInArrow(
        search, f"key {key}, row long, item_id {item}, kind string, start long, words long"
    )


def _occurrences(batch, r, q, often, slop):
    row = _Row(
        batch.column("words")[r].values.to_numpy(zero_copy_only=False), batch.column("terms")[r].as_py(),
        batch.column("counts")[r].as_py(), batch.column("positions")[r].as_py(), len(q.vocabulary),
    )
    present = (row.count > 0)
    there = present[q.terms] | (q.terms < 0)
    for w in np.flatnonzero(there.all(axis=1)):
        terms = q.terms[w, : q.length[w]]
        place = row.starts(terms, np.argsort(often[terms], kind="stable"))
        if len(place):
            yield w, "exact", place, row
    if slop is not None:
        for w in range(len(q.terms)):
            terms = q.terms[w, : q.length[w]]
            order = np.argsort(often[terms], kind="stable")
            if present[terms].all():
                place = row.near(terms, order, slop)
                if len(place):
                    yield w, "near", place, row


def hits(index: DataFrame, queries: Queries) -> DataFrame:
    """One row per document: key, n_words, n_hit (words inside an occurrence), runs
    (first and behind-last word of each stretch of hit words), items (sorted ids, as
    text, of the items with an occurring window).
    """
    spark = index.sparkSession
    held = _ship(spark, queries, term_counts(index, len(queries.vocabulary)))
    key = index.schema["keys"].dataType.elementType.simpleString()
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, often = _held(held)
        for batch in batches:
            for r in range(batch.num_rows):
                n_words = batch.column("words")[r].values.to_numpy(zero_copy_only=False).astype(np.int64)
                first = np.concatenate(([0], np.cumsum(n_words)))
                edge = np.zeros(first[-1] + 1, np.int64)
                docs, items = [], []
                for w, _, place, row in _occurrences(batch, r, q, often, None):
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + q.length[w], -1)
                    docs.append(row.document(place))
                    items.append(np.full(len(place), q.item[w]))
                hit = np.cumsum(edge[:-1]) > 0
                before = np.concatenate(([0], np.cumsum(hit)))
                listed: list[list[str]] = [[] for _ in n_words]
                runs: list[list[dict]] = [[] for _ in n_words]
                if docs:
                    found = np.stack([np.concatenate(docs), np.concatenate(items)], 1)
                    for d, i in np.unique(found, axis=0).tolist():
                        listed[d].append(str(q.item_ids[i]))
                    for d in np.unique(found[:, 0]).tolist():
                        step = np.diff(hit[first[d] : first[d + 1]].astype(np.int8), prepend=0, append=0)
                        ends = zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True)
                        runs[d] = [{"start": a, "stop": b} for a, b in ends]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("keys")[r].values, pa.array(n_words),
                        pa.array(before[first[1:]] - before[first[:-1]]), pa.array(runs, runs_type),
                        pa.array([sorted(set(x)) for x in listed], pa.list_(pa.string())),
                    ],
                    names=["key", "n_words", "n_hit", "runs", "items"],
                )

    return index.mapInArrow(
        mark, f"key {key}, n_words long, n_hit long, runs array<struct<start:long,stop:long>>, items array<string>"
    )


def _united(parts: list[DataFrame]) -> DataFrame:
    """One row per key from the rows of several blocks, hit words counted once."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    counted = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct(
            (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["end"]))).alias("n"),
            F.greatest(s["end"], x["stop"]).alias("end"),
        ),
        lambda s: s["n"],
    )
    return merged.withColumn("n_hit", counted)


def find(
    docs: DataFrame, benchmark: DataFrame, key_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: key, n_words, n_hit, items, contaminated.

    A document is contaminated when it has a hit word and at least one in twenty of its
    words is hit.
    """
    blocks = block_count(benchmark, item_text, block_words)
    if blocks == 1:
        q = query_block(benchmark, 0, 1, item_col, item_text, size)
        out = hits(stored(build_index(docs, q.vocabulary, key_col, text_col), "postings"), q)
    else:
        numbered = stored(
            docs.select(
                F.monotonically_increasing_id().alias("n"), F.col(key_col).alias("k"), F.col(text_col).alias("t")
            ),
            "numbered",
        )
        parts = []
        for b in range(blocks):
            q = query_block(benchmark, b, blocks, item_col, item_text, size)
            parts.append(stored(hits(stored(build_index(numbered, q.vocabulary, "n", "t"), "postings"), q), "hits"))
        names = numbered.select(F.col("n").alias("key"), F.col("k"))
        out = _united(parts).join(names, "key").drop("key").withColumnRenamed("k", "key")
    share = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("key", "n_words", "n_hit", "items", share.alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not contaminated, all columns kept.

    Contamination depends on the text alone, so rows leave by the digest of their text;
    rows with a null text stay.
    """
    digest = F.md5(F.col(text_col))
    found = find(docs.select(digest.alias("key"), F.col(text_col).alias("text")), benchmark, "key", "text")
    name = fresh(docs, "digest")
    bad = stored(found.filter("contaminated").select(F.col("key").alias(name)).distinct(), "contaminated")
    return lookup(docs.withColumn(name, digest), bad, [name], "left_anti").drop(name)


def items_digest(items: str = "items") -> F.Column:
    return F.sha2(F.concat_ws(",", F.col(items)), 256)
