"""Many phrases found in one pass over a text, by an automaton over words.

The phrases make a tree of words; every node has a link to the longest other node that
ends the same way, and one to the nearest such node that ends a phrase. A text's words
drive the automaton once, whatever the number of phrases, and nothing is exploded, grouped
or shuffled. Nodes, edges and links are arrays; a worker turns the edges into a lookup
table once and keeps it.

An automaton holds at most ``MOST_PHRASES`` phrases of ``MOST_BYTES`` bytes, which bounds
what is broadcast. A longer list is split by the hash of its phrases' first words into
lists that fit, and texts are passed once for each; every phrase is in exactly one list,
so the findings only have to be put together.

A phrase is one or more words with single spaces between them; it is found where a text
has these words one after the other. Null and empty phrases and texts give nothing. Of
several labels for a phrase the alphabetically first counts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.session import fits, scratch_path, stored

MOST_PHRASES = 500_000
MOST_BYTES = 64 << 20

ENTITY_TYPE = "array<struct<ent_text:string,label:string>>"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))


def joined(c: Column) -> Column:
    """The words of a text as one string, which a batch holds in little more than the text's bytes."""
    return F.array_join(tokens(c), " ")


def automaton(pairs: Sequence[tuple[str, str]]) -> dict:
    """The automaton of (phrase, label) pairs as arrays; node 0 is the beginning."""
    words: dict[str, int] = {}
    edges: list[dict[int, int]] = [{}]
    ends, depth = [-1], [0]
    for number, (phrase, _) in enumerate(pairs):
        node = 0
        for word in phrase.split(" "):
            at = words.setdefault(word, len(words))
            if at not in edges[node]:
                edges[node][at] = len(edges)
                edges.append({})
                ends.append(-1)
                depth.append(depth[node] + 1)
            node = edges[node][at]
        ends[node] = number
    fail, shorter = np.zeros(len(edges), np.int64), np.zeros(len(edges), np.int64)
    todo = deque(edges[0].values())
    while todo:
        node = todo.popleft()
        for at, below in edges[node].items():
            back = int(fail[node])
            while back and at not in edges[back]:
                back = int(fail[back])
            fail[below] = edges[back].get(at, 0) if edges[back].get(at, 0) != below else 0
            todo.append(below)
        # The nearest node along the links that ends a phrase; those above are done.
        shorter[node] = fail[node] if ends[fail[node]] >= 0 else shorter[fail[node]]
    flat = [(node, at, below) for node, own in enumerate(edges) for at, below in own.items()]
    return {
        "words": list(words), "edges": np.array(flat, np.int64).reshape(-1, 3), "ends": np.array(ends, np.int64),
        "depth": np.array(depth, np.int64), "fail": fail, "shorter": shorter, "phrases": list(pairs),
    }


class Matcher:
    """An automaton ready to run."""

    def __init__(self, made: dict):
        self.number = {w: i for i, w in enumerate(made["words"])}
        self.width = max(len(self.number), 1)
        self.go = {n * self.width + w: b for n, w, b in made["edges"].tolist()}
        self.ends, self.depth = made["ends"].tolist(), made["depth"].tolist()
        self.fail, self.shorter = made["fail"].tolist(), made["shorter"].tolist()
        self.phrases = made["phrases"]

    def first(self, words: Sequence[str]) -> list[tuple[int, int, int]]:
        """(first word, words, phrase) of the first occurrence of every phrase found, in order."""
        found: dict[int, int] = {}
        number, go, fail, width, state = self.number, self.go, self.fail, self.width, 0
        for i, word in enumerate(words):
            at = number.get(word)
            if at is None:
                state = 0
                continue
            while state and state * width + at not in go:
                state = fail[state]
            state = go.get(state * width + at, 0)
            node = state if self.ends[state] >= 0 else self.shorter[state]
            while node:
                found.setdefault(self.ends[node], i)
                node = self.shorter[node]
        sizes = [len(self.phrases[p][0].split(" ")) for p in found]
        places = [(i - n + 1, n, p) for (p, i), n in zip(found.items(), sizes, strict=True)]
        return sorted(places, key=lambda x: (x[0], -x[1]))


def _ship(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> Broadcast:
    return spark.sparkContext.broadcast(automaton(pairs))


def _matcher(held: Broadcast) -> Matcher:
    """The worker's matcher; it stays with the broadcast value between tasks."""
    if "matcher" not in held.value:
        held.value["matcher"] = Matcher(held.value)
    return held.value["matcher"]


def table_of(phrases: DataFrame) -> DataFrame:
    """One label per phrase (phrase, label), empty ones left out."""
    there = phrases.filter((F.col("phrase") != "") & F.col("label").isNotNull())
    return there.groupBy("phrase").agg(F.min("label").alias("label"))


def _pairs(table: DataFrame) -> list[tuple[str, str]]:
    return sorted((r["phrase"], r["label"]) for r in table.collect())


def tagger(spark: SparkSession, phrases: DataFrame) -> Callable[[Column], Column]:
    """A tagger (text to entity array) for (phrase, label) rows that fit one automaton."""
    table = stored(table_of(phrases), "phrases")
    if not fits(table, MOST_PHRASES, MOST_BYTES):
        raise ValueError(f"More than {MOST_PHRASES} phrases or {MOST_BYTES} bytes: use entities")
    held = _ship(spark, _pairs(table))

    @F.pandas_udf(ENTITY_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = _matcher(held)
        for words in batches:
            yield pd.Series(
                [
                    None if w is None else [{"ent_text": m.phrases[p][0], "label": m.phrases[p][1]} for _, _, p in m.first(w.split())]
                    for w in words
                ],
                index=words.index, dtype=object,
            )

    return lambda c: run(joined(c))


def entities(
    df: DataFrame, phrases: DataFrame, column: str, key: str = "case_id", longest: int | None = None,
    most_phrases: int = MOST_PHRASES,
) -> DataFrame:
    """Entity table (key, pos, ent_text, label) for any number of phrases.

    Each phrase comes once per text, at its first occurrence; positions order by first
    word, longer phrases before shorter ones. Phrases of more than ``longest`` words are
    left out where that is given.
    """
    spark = df.sparkSession
    table = table_of(phrases)
    if longest is not None:
        table = table.filter(F.size(F.split("phrase", " ")) <= longest)
    table = stored(table, "phrases")
    texts = df.select(F.col(key).alias("key"), joined(F.col(column)).alias("words"))
    kind = texts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, pos long, ent_text string, label string"

    def pass_over(some: DataFrame) -> DataFrame:
        held = _ship(spark, _pairs(some))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            m = _matcher(held)
            for batch in batches:
                rows = [
                    (k, (i << 16) + (1 << 16) - 1 - n, *m.phrases[p])
                    for k, words in zip(batch["key"], batch["words"], strict=True) if words is not None
                    for i, n, p in m.first(words.split())
                ]
                yield pd.DataFrame(rows, columns=["key", "pos", "ent_text", "label"])

        return texts.filter("words <> ''").mapInPandas(run, schema)

    if fits(table, most_phrases, MOST_BYTES):
        found = pass_over(table)
    else:
        size = table.agg(F.count(F.lit(1)), F.sum(F.octet_length("phrase") + F.octet_length("label") + 16)).head()
        # Half full on average, as first words are not even.
        parts = 2 * max(-(-size[0] // most_phrases), -(-size[1] // MOST_BYTES))
        opener = F.pmod(F.xxhash64(F.substring_index("phrase", " ", 1)), F.lit(parts))
        path = scratch_path(spark, "entities")
        for part in range(parts):
            pass_over(table.filter(opener == part)).write.mode("append").parquet(path)
        found = spark.read.schema(schema).parquet(path)
    return found.withColumnRenamed("key", key)
