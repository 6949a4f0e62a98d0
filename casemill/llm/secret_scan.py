"""Secret scans with a random forest that tells secrets from look-alikes.

Candidates are long runs of letters, digits and ``+ / = _ -``. Each gets features: its
length and kinds of characters, changes of kind along it, how likely its letter pairs
are among the corpus's words, how much of it words of the corpus's dictionary cover,
whether it is part of a path or URL, its quoting and assignment, and hashed words before
and after it. A forest trained from labelled findings gives every candidate a score.

Letter pairs and the dictionary are counted over every text. The dictionary holds words
of 3 to 6 letters with at least one in ``RARE`` of all such words, so it has at most that
many entries whatever the corpus. Texts are read whole; nothing but findings and counts
is moved.

Null texts hold nothing. Null ids and repeated rows are scanned row by row; labels are
matched by id and start, a null id matches no label, and a finding labelled more than
once takes the larger label. Without labels of both kinds there is no forest and every
score is the share of labelled secrets (0 without labels). Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm import texts as X
from casemill.session import stored

SHORTEST = 16
RARE = 50_000
HASHED = 16
TREES, DEPTH = 20, 8

_CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{%d,}" % SHORTEST)
_DICTIONARY_WORD = re.compile(r"(?<![a-z])[a-z]{3,6}(?![a-z])")
_KEY = re.compile(r"(?i)(key|token|secret|passw|pwd|auth|credential)")
_KINDS = np.zeros(256, np.int8)
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58] = 1, 2, 3


def background(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, frozenset[str]]:
    """log-probabilities of letter pairs (27 x 27, others as one) and the dictionary."""
    source = docs.select(F.col(text_col).cast("string").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, known = np.zeros(27 * 27, np.int64), Counter()
        code = np.zeros(256, np.int64)
        code[97:123] = code[65:91] = np.arange(1, 27)
        for batch in batches:
            for slab in X.slabs(batch, "t"):
                row = code[X.raw(slab.column("t"))[0]]
                pairs += np.bincount(row[:-1] * 27 + row[1:], minlength=27 * 27)
                for t in slab.column("t").to_pylist():
                    known.update(_DICTIONARY_WORD.findall((t or "").lower()))
        names = [f"{i}" for i in range(27 * 27)] + list(known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([*pairs.tolist(), *known.values()], pa.int64())], names=["name", "n"]
        )

    rows = source.mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    counts = stored(rows, "background")
    is_pair = F.col("name").rlike("^[0-9]+$")
    pairs = np.ones(27 * 27)
    for r in counts.filter(is_pair).collect():
        pairs[int(r["name"])] += r["n"]
    pairs = pairs.reshape(27, 27)
    total = counts.filter(~is_pair).agg(F.sum("n").alias("n")).first()["n"] or 0
    often = counts.filter(~is_pair & (F.col("n") * RARE >= total)).select("name")
    return np.log(pairs / pairs.sum(1, keepdims=True)), frozenset(r["name"] for r in often.collect())


def _covered(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that the longest dictionary words cover, from the left."""
    at, inside, low = 0, 0, value.lower()
    while at < len(low):
        size = next((n for n in range(6, 2, -1) if low[at : at + n] in dictionary and at + n <= len(low)), 0)
        inside, at = inside + size, at + (size or 1)
    return inside / len(low)


def _hashed(word: str) -> list[float]:
    out = [0.0] * HASHED
    if word:
        out[sum(b * 31**i for i, b in enumerate(word.lower().encode()[:12])) % HASHED] = 1.0
    return out


def describe(text: str, start: int, value: str, pairs: np.ndarray, dictionary: frozenset[str]) -> list[float]:
    """The features of one candidate; the text around it is read 64 characters far."""
    before, after = text[max(0, start - 64) : start], text[start + len(value) : start + len(value) + 64]
    data = np.frombuffer(value.encode(), np.uint8)
    kind = _KINDS[data]
    share = np.bincount(kind, minlength=4) / len(data)
    counts = np.unique(data, return_counts=True)[1] / len(data)
    letters = np.where(kind == 1, data.astype(int) - 96, np.where(kind == 2, data.astype(int) - 64, 0))
    near = re.findall(r"\w+", before)
    follow = re.match(r"\W*(\w+)", after)
    return [
        float(len(value)), *share.tolist(), float((np.diff(kind) != 0).mean()), float(-(counts * np.log2(counts)).sum()),
        float(pairs[letters[:-1], letters[1:]].mean()), _covered(value, dictionary),
        float(bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value))), float(len(value) % 8 == 0),
        float(value.count("/")), float(value.endswith("=")), float(before[-1:] in "/.\\" and bool(before)),
        float(after[:1] in ('/', '.') and bool(after)), float("://" in before.rsplit(" ", 1)[-1]),
        float(before[-1:] in ('"', "'") and after[:1] in ('"', "'") and bool(before and after)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(bool(_KEY.search(" ".join(near[-2:])))),
        *_hashed(near[-1] if near else ""), *_hashed(follow.group(1) if follow else ""),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known=None) -> DataFrame:
    """k, start, length, value (its SHA-256; the secret itself is not kept) and features."""
    pairs, dictionary = background(docs, text_col) if known is None else known
    held = docs.sparkSession.sparkContext.broadcast((pairs, dictionary))
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, dictionary = held.value
        for batch in batches:
            for slab in X.slabs(batch, "t"):
                row, start, length, digest, features = [], [], [], [], []
                for i, t in enumerate(slab.column("t").to_pylist()):
                    for m in _CANDIDATE.finditer(t or ""):
                        row.append(i)
                        start.append(m.start())
                        length.append(len(m.group()))
                        digest.append(hashlib.sha256(m.group().encode()).hexdigest())
                        features.append(describe(t, m.start(), m.group(), pairs, dictionary))
                yield pa.RecordBatch.from_arrays(
                    [slab.column("k").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(digest, pa.string()), pa.array(features, pa.list_(pa.float64()))],
                    names=["k", "start", "length", "value", "features"],
                )

    return source.mapInArrow(find, f"k {kind}, start long, length long, value string, features array<double>")


def score(found: DataFrame, labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> DataFrame:
    """``found`` (written by the caller) with the score of a forest trained from ``labelled``.

    ``labelled``: k, start and secret (0 or 1) of findings.
    """
    known = labelled.filter("secret IS NOT NULL").groupBy("k", "start").agg(F.max(F.col("secret").cast("double")).alias("label"))
    train = found.join(known, ["k", "start"]).select("label", array_to_vector("features").alias("x"))
    shares = known.agg(F.avg("label").alias("share")).first()["share"]
    kinds = train.groupBy("label").count().collect()
    if len(kinds) < 2:
        return found.withColumn("score", F.lit(float(shares or 0.0)))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(train)
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*found.columns, "score")
