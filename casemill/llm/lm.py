"""Scores of texts under a small attention model and under a word unigram model.

A text is its words (A-Z lower-cased) with one blank between them, then an end.

*Unigram.* Each task turns about two megabytes of neighbouring texts into a chunk: its
distinct words (hashes) with their training counts, split by hash into buckets, and per
text the places of its words in that list. Buckets of all chunks meet in tasks that sum
the counts and answer each chunk, so a word of a third of all tokens is one entry per
chunk and what moves is distinct words, not tokens. The answers go back to the chunks,
where every text's sum is taken.

*Attention* (``attention``). The same pass keeps each text's subword ids. Counts of all
training ids give classes and shares, counts of what class follows which id give the
network's first logits; it is then trained in rounds, each over windows that tile every
training text, so that every id of it is a target once a round. Tasks train for
themselves from the same start, after which their weights are averaged. Scoring runs over
every text whole, without a shuffle.

What the corpus gives (counts of words, ids and pairs, training windows) comes from every
training row and grows with the input; the weights have a fixed size. Averages are sums
of floating-point numbers in no fixed order, so attention scores of two runs may differ
in their last digits. Where a text is cut follows from its ids and the round; which texts
train together follows the partitions of the input. Words with equal 64-bit hashes count as one.

Null texts are empty: their one token is the end. Null ids belong to the training rows.
Rows that share an id are scored each. Extra columns are not read. An empty table gives
no rows; without training rows every count is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.llm import attention, subwords
from casemill.llm import texts as X
from casemill.session import plan_bytes, scratch_path

ROUNDS = 2
TRAIN_BATCH = 256
RATE = 0.01
BUCKET_BYTES = 8_000_000
MOST_BUCKETS = 4096
MERGE_WORDS = 2_000_000
SLICES = 64
#: Tasks that give whole arrays of counts or weights, so that their sum is bounded work.
MOST_TASKS = 1024

_TO_WORDS = bytes(32 if c in X.WHITE else c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(id_col: str, folds: int = 7, which: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == which, F.lit(False))


def _bucket_bits(size: int) -> int:
    bits = 4
    while BUCKET_BYTES << bits < size and 1 << bits < MOST_BUCKETS:
        bits += 1
    return bits


def _windows(ids: np.ndarray, end: int, which: int, seed: int) -> np.ndarray:
    """``_tiles`` of one text."""
    return _tiles([ids], end, which, [seed])


def _tiles(texts: list[np.ndarray], end: int, which: int, seeds: list[int]) -> np.ndarray:
    """Runs of WIDTH + 1 ids that tile each text with the end before and behind it; -1 fills up.

    Every id, and the end behind, is a target once; a text's seed and the round ``which`` give
    the length of the first run, so that rounds cut at other places.
    """
    width, gap = attention.WIDTH, np.array([end], np.int32)
    row = np.concatenate([x for ids in texts for x in (gap, ids, gap)]).astype(np.int32, copy=False)
    last = np.array([len(ids) + 1 for ids in texts])
    first = np.array([1 + ((s * 31 + which + 1) * 0x9E3779B97F4A7C15 >> 17) % width for s in seeds])
    runs = 1 + np.maximum(0, -(-(last - first) // width))
    nth = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    first, stop, base = (np.repeat(x, runs) for x in (first, last, np.cumsum(last + 1) - last - 1))
    begin = np.where(nth > 0, first + (nth - 1) * width, 0)
    stop = np.minimum(stop, first + nth * width)
    found = row.take((base + begin)[:, None] + np.arange(width + 1), mode="clip")
    found[np.arange(width + 1) > (stop - begin)[:, None]] = -1
    return found


def prepare(
    docs: DataFrame, train: Column, tokenizer: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, int, int]:
    """The pass over the texts: rows per text, rows per chunk and bucket, the end's id, bucket bits.

    Both are read back from one folder that the pass writes.
    """
    spark = docs.sparkSession
    held = subwords.ship(spark, tokenizer)
    end = subwords.encoder(held).tokenizer.get_vocab_size()
    bits = _bucket_bits(plan_bytes(docs))
    source = docs.select(
        F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"), train.alias("train")
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, serial = subwords.encoder(held), 0
        for batch in batches:
            for slab in X.slabs(batch, "t"):
                chunk, serial = X.task_id(serial), serial + 1
                yield from _chunk(slab, chunk, e, bits)

    folder = scratch_path(spark, "lm")
    written = source.mapInArrow(split, _ROW)
    written.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    rows = spark.read.schema(_ROW).parquet(folder)
    return rows.filter("kind = 'text'"), rows.filter("kind = 'words'"), end, bits


_ROW = (
    "kind string, chunk long, n int, k long, train boolean, n_words int, places binary, ids binary, "
    "bucket int, words binary, counts binary"
)
_ARROW_ROW = pa.schema([
    ("kind", pa.string()), ("chunk", pa.int64()), ("n", pa.int32()), ("k", pa.int64()), ("train", pa.bool_()),
    ("n_words", pa.int32()), ("places", pa.binary()), ("ids", pa.binary()), ("bucket", pa.int32()),
    ("words", pa.binary()), ("counts", pa.binary()),
])


def _record(size: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns.get(f.name), pa.Array)
         else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _ARROW_ROW],
        schema=_ARROW_ROW,
    )


def _chunk(slab, chunk, e, bits) -> Iterator[pa.RecordBatch]:
    size = slab.num_rows
    w = X.words(slab.column("t"))
    train = slab.column("train").to_numpy(zero_copy_only=False).astype(bool)
    known, place = np.unique(w.hash, return_inverse=True)
    counts = np.bincount(place[train[w.doc]], minlength=len(known)).astype(np.uint32)
    order = np.argsort(w.doc * (len(known) + 1) + place, kind="stable")
    steps = np.diff(place[order], prepend=0)
    begin = w.first[:-1][w.per_doc > 0]
    steps[begin] = place[order][begin]
    places = np.split(steps.astype(np.uint32), w.first[1:-1]) if size else []
    some = np.empty(len(known), np.int64)
    some[place] = np.arange(len(place))
    data, begin, stop = X.raw(slab.column("t"))[0].tobytes().translate(_TO_WORDS), w.start[some], (w.start + w.size)[some]
    ids = e.encode_rows([data[a:b].decode() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], place, w.per_doc)
    yield _record(size, {
        "kind": ["text"] * size, "chunk": [chunk] * size, "n": range(size), "k": slab.column("k"),
        "train": slab.column("train"), "n_words": w.per_doc.astype(np.int32), "places": [p.tobytes() for p in places],
        "ids": ids,
    })
    bucket = (known >> np.uint64(64 - bits)).astype(np.int64)
    there, first = np.unique(bucket, return_index=True)
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(known)], strict=False))
    yield _record(len(there), {
        "kind": ["words"] * len(there), "chunk": [chunk] * len(there), "bucket": there.astype(np.int32),
        "words": [known[a:b].tobytes() for a, b in parts], "counts": [counts[a:b].tobytes() for a, b in parts],
    })


# --- unigram ---------------------------------------------------------------------


def _merged(words: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.zeros(len(known), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return known, total


def word_totals(chunks: DataFrame) -> DataFrame:
    """bucket, words, counts, n (tokens) and v (distinct words that occur in training) over all chunks."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, words, counts, held = None, [], [], 0

        def made() -> pa.RecordBatch:
            known, sums = _merged(words, counts)
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([current], pa.int32()), "words": pa.array([known.tobytes()], pa.binary()),
                "counts": pa.array([sums.tobytes()], pa.binary()), "n": [int(sums.sum())], "v": [int((sums > 0).sum())],
            })

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("bucket", "words", "counts"))
            for b, h, c in zip(*columns, strict=True):
                if b != current and words:
                    yield made()
                    words, counts, held = [], [], 0
                current = b
                words.append(np.frombuffer(h, np.uint64))
                counts.append(np.frombuffer(c, np.uint32).astype(np.int64))
                held += len(words[-1])
                if held > MERGE_WORDS:
                    known, sums = _merged(words, counts)
                    words, counts, held = [known], [sums], 0
        if words:
            yield made()

    dealt = chunks.select("bucket", "words", "counts").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(total, "bucket int, words binary, counts binary, n long, v long")


def _answers(chunks: DataFrame, totals: DataFrame) -> DataFrame:
    """chunk, bucket, the corpus counts of the chunk's words of that bucket, and how many they are.

    A bucket's totals come first, then the chunks that ask for them, one by one.
    """
    asked = chunks.select("bucket", "chunk", "words", F.lit(None).cast("binary").alias("counts"))
    known = totals.select("bucket", F.lit(None).cast("long").alias("chunk"), "words", "counts")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            out = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("bucket", "chunk", "words", "counts"))
            for b, chunk, h, c in zip(*columns, strict=True):
                if chunk is None:
                    words, counts = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                    continue
                found = counts[np.searchsorted(words, np.frombuffer(h, np.uint64))]
                out[0].append(chunk)
                out[1].append(b)
                out[2].append(found.astype(np.uint32 if found.max(initial=0) < 1 << 32 else np.uint64).tobytes())
                out[3].append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.int32()), strict=True)],
                names=["chunk", "bucket", "found", "size"],
            )

    dealt = known.unionByName(asked).repartition("bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    return dealt.mapInArrow(answer, "chunk long, bucket int, found binary, size int")


def unigram(texts: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, n, n_known, train_tokens and base_score of every text."""
    spark = texts.sparkSession
    folder = scratch_path(spark, "totals")
    word_totals(chunks).write.option("compression", "zstd").parquet(folder)
    totals = spark.read.parquet(folder)
    sums = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    ends = texts.filter("train").count()
    tokens, kinds = sums["n"] + ends, sums["v"] + (ends > 0)
    whole = float(np.log10(tokens + kinds + 1))
    end_score, end_known = float(np.log10(ends + 1)) - whole, int(ends > 0)

    def sum_up(key, answers: pa.Table, rows: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        # A chunk's words are in hash order and buckets are leading bits, so parts join up.
        found = [np.zeros(0, np.float64)]
        for b, n in zip(answers.column("found").to_pylist(), answers.column("size").to_pylist(), strict=True):
            found.append(np.frombuffer(b, np.uint64 if len(b) == 8 * n else np.uint32).astype(np.float64))
        count = np.concatenate(found)
        score, known = [], []
        gain = np.log10(count + 1)
        for p in rows.column("places").to_pylist():
            at = np.cumsum(np.frombuffer(p, np.uint32), dtype=np.int64)
            score.append(float(gain[at].sum()) - len(at) * whole + end_score)
            known.append(int((count[at] > 0).sum()) + end_known)
        return pa.table({
            "chunk": rows.column("chunk"), "n": rows.column("n"), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(known), pa.int64()), "base_score": pa.array(score, pa.float64()),
        })

    dealt = _answers(chunks, totals).groupBy("chunk").cogroup(texts.select("chunk", "n", "places").groupBy("chunk"))
    return dealt.applyInArrow(sum_up, "chunk long, n int, n_known long, train_tokens long, base_score double")


# --- attention -------------------------------------------------------------------


def id_counts(texts: DataFrame, end: int) -> np.ndarray:
    """How often each id occurs in the training texts; one row per id reaches the driver."""
    dtype = "<u2" if end <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(end + 1, np.int64)
        for batch in batches:
            for b in batch.column("ids").to_pylist():
                total[:end] += np.bincount(np.frombuffer(b, dtype), minlength=end) if len(b) > end else 0
                if len(b) <= end:
                    np.add.at(total, np.frombuffer(b, dtype), 1)
            total[end] += batch.num_rows
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["id", "n"])

    seen = texts.filter("train").select("ids").coalesce(MOST_TASKS)
    rows = seen.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(end + 1, np.int64)
    for r in rows.toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def _slices(values: np.ndarray, n: int) -> pa.RecordBatch:
    parts = np.array_split(values, SLICES)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([n] * SLICES, pa.int64())],
        names=["slice", "numbers", "n"],
    )


_SLICE = "slice int, numbers binary, n long"


def _summed(rows: DataFrame, dtype: type) -> tuple[np.ndarray, int]:
    """The sum of arrays that many tasks gave in slices, each ``n`` times; the driver gets one array."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for s, b, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "numbers", "n")), strict=True):
                got = sums.setdefault(s, [0.0, 0])
                got[0], got[1] = got[0] + np.frombuffer(b, dtype).astype(np.float64) * n, got[1] + n
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([v[0].tobytes() for v in sums.values()], pa.binary()),
                 pa.array([v[1] for v in sums.values()], pa.int64())],
                names=["slice", "numbers", "n"],
            )

    found = sorted(rows.repartition("slice").mapInArrow(add, _SLICE).collect(), key=lambda r: r["slice"])
    if not found:
        return np.zeros(0), 0
    return np.concatenate([np.frombuffer(r["numbers"], np.float64) for r in found]), found[0]["n"]


def pair_counts(texts: DataFrame, vocab: attention.Vocabulary) -> np.ndarray:
    """Counts of ``attention.pairs`` over the training texts."""
    held = texts.sparkSession.sparkContext.broadcast(tuple(vocab))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = attention.Vocabulary(*held.value)
        dtype, gap = "<u2" if v.end <= 1 << 16 else "<u4", np.array([v.end])
        total = np.zeros(attention.BUCKETS * attention.CLASSES)
        for whole in batches:
            for batch in X.slabs(whole, "ids"):
                rows = [np.frombuffer(b, dtype).astype(np.int64) for b in batch.column("ids").to_pylist()]
                total += attention.pairs(np.concatenate([x for r in rows for x in (gap, r)] + [gap]), v)
        yield _slices(total, 1)

    return _summed(texts.filter("train").select("ids").coalesce(MOST_TASKS).mapInArrow(count, _SLICE), np.float64)[0]


def fit(texts: DataFrame, vocab: attention.Vocabulary, rounds: int = ROUNDS, batch_rows: int = TRAIN_BATCH):
    """The network's weights, averaged over the tasks after each round."""
    spark = texts.sparkSession
    params = attention.start(pair_counts(texts, vocab))
    seen = texts.filter("train").select("ids").coalesce(MOST_TASKS)
    for r in range(rounds):
        held = spark.sparkContext.broadcast((params, tuple(vocab)))

        def learn(batches: Iterator[pa.RecordBatch], r=r, held=held) -> Iterator[pa.RecordBatch]:
            begin, v = held.value
            vocab, n = attention.Vocabulary(*v), 0
            dtype = "<u2" if vocab.end <= 1 << 16 else "<u4"

            def windows() -> Iterator[np.ndarray]:
                nonlocal n
                kept = np.zeros((0, attention.WIDTH + 1), np.int32)
                for whole in batches:
                    for batch in X.slabs(whole, "ids"):
                        rows = batch.column("ids").to_pylist()
                        found = _tiles([np.frombuffer(b, dtype) for b in rows], vocab.end, r, [zlib.crc32(b) for b in rows])
                        # Neighbouring windows of a text do not fill a batch of their own.
                        kept = np.concatenate([kept, found[np.random.default_rng(r).permutation(len(found))]])
                        full = len(kept) - len(kept) % batch_rows
                        for at in range(0, full, batch_rows):
                            n += batch_rows
                            yield kept[at : at + batch_rows]
                        kept = kept[full:]
                if len(kept):
                    n += len(kept)
                    yield kept

            got = attention.train(begin, windows(), vocab, RATE)
            if n:
                yield _slices(attention.flat(got), n)

        total, n = _summed(seen.mapInArrow(learn, _SLICE), np.float32)
        if n:
            params = attention.unflat(total / n)
    return params


def attention_scores(texts: DataFrame, params, vocab: attention.Vocabulary) -> DataFrame:
    """chunk, n, k, train, n_words and score of every text."""
    held = texts.sparkSession.sparkContext.broadcast((tuple(attention.joined(params, vocab.kinds)), tuple(vocab)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, v = held.value
        tables, vocab = attention.Tables(*t), attention.Vocabulary(*v)
        dtype = "<u2" if vocab.end <= 1 << 16 else "<u4"
        for whole in batches:
            for batch in X.slabs(whole, "ids"):
                found = [np.frombuffer(b, dtype).astype(np.int64) for b in batch.column("ids").to_pylist()]
                out = batch.drop_columns(["ids"])
                yield out.append_column("score", pa.array(attention.score(found, tables, vocab)))

    columns = texts.select("chunk", "n", "k", "train", "n_words", "ids")
    return columns.mapInArrow(run, "chunk long, n int, k long, train boolean, n_words int, score double")


def scores(docs: DataFrame, tokenizer: str, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    texts, chunks, end, _ = prepare(docs, train, tokenizer, id_col, text_col)
    vocab = attention.vocabulary(id_counts(texts, end))
    scored = attention_scores(texts, fit(texts, vocab), vocab)
    return scored.join(unigram(texts, chunks), ["chunk", "n"]).select(
        F.col("k").alias(id_col), (~F.col("train")).alias("held_out"),
        (F.col("n_words") + 1).cast("long").alias("n_tokens"), "n_known", "train_tokens", "base_score", "score",
    )
