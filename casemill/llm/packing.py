"""Documents packed into as few sequences of bounded length as can be found.

``pack`` encodes every text, ends it with ``end_id``, cuts what is longer than a sequence
into whole pieces (the first takes the remainder) and gives each piece a sequence and an
offset there. ``sequences`` lays the pieces' ids out.

Only lengths decide where a piece goes, and there are at most ``size`` different ones. So
the packing is made for the histogram of lengths, whatever the number of documents: a
filling (a list of lengths that share a sequence) is used many times at once. Bin
completion searches it: around the largest length left, the fillings that no other
filling dominates are tried, those that leave least room first, each as often as the
counts allow and, on the way back, less often. A branch ends when the room it has left
open, or the lower bound of what is left to pack, cannot beat the best packing known; at
every node, what is left is also packed by best fit, and the better packing is kept. The
search ends when the bound is met, or after ``NODES`` nodes: it then returns the best
packing found, in which every piece has its place all the same.

The histogram is summed up in the tasks that cut. A piece's rank among those of its length
is its rank in its task plus the pieces of that length in the tasks before, and the
filling, copy and offset follow from rank and plan: the plan is a short table (its size
depends on ``size`` and ``NODES``, not on the input), joined to narrow rows. No task or
group ever holds the pieces of one length, hot or not.

Null texts are empty: the end id alone. Null ids and rows that share an id are documents
each. Ties and repeated rows differ by their place in the input only; a table read twice
with the same files gives the same packing. Very long texts are cut like others. Extra
columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from casemill.llm import subwords, texts
from casemill.session import spread, stored

SIZE = 1_024
#: Nodes of the search; branches and steps of listing them at one node.
NODES, BRANCHES, STEPS = 3_000, 12, 300

Filling = tuple[int, ...]
Plan = list[tuple[Filling, int]]

_PIECES = (
    "key long, piece int, start long, length int, ids binary, ids_crc32 long, part int, nth long"
)


# --- how many sequences ---------------------------------------------------------------


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that no packing can do without: lengths above a half need one each, and so on."""
    size = len(counts) - 1
    lengths = np.arange(size + 1)
    number, total = np.cumsum(counts), np.cumsum(counts * lengths)
    half = size // 2
    k = np.arange(half + 1)
    below = np.concatenate(([0], total))[k]
    large = number[size] - number[size - k]
    middle, held = number[size - k] - number[half], total[size - k] - total[half]
    rest = total[half] - below - (middle * size - held)
    return int((large + middle + np.maximum(0, -(-rest // size))).max(initial=0))


def best_fit(counts: np.ndarray) -> Plan:
    """Lengths from the largest, each into the fullest sequence that has room for it."""
    size = len(counts) - 1
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, times: int) -> None:
        if room not in open_:
            insort(rooms, room)
            open_[room] = []
        open_[room].append([filling, times])

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                filling, times = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
                used = min(times, left)
                if used < times:
                    put(room, filling, times - used)
                put(room - length, (*filling, length), used)
                left -= used
            else:
                each = size // length
                whole, rest = divmod(left, each)
                if whole:
                    put(size - each * length, (length,) * each, whole)
                if rest:
                    put(size - rest * length, (length,) * rest, 1)
                left = 0
    return [(filling, times) for held in open_.values() for filling, times in held]


def _dominated(filling: list[int], left: np.ndarray, room: int) -> bool:
    """Whether some lengths of ``filling`` could make way for one other that holds them all.

    ``left`` counts the lengths not in it; ``room`` is what it leaves open.
    """
    sums = {0: 0}
    for length in filling:
        sums |= {s + length: max(n + 1, sums.get(s + length, 0)) for s, n in list(sums.items()) if s + length < len(left)}
    for total, parts in sums.items():
        # One length in place of an equal one changes nothing.
        low = total + 1 if parts <= 1 else total
        if left[max(low, 1) : total + room + 1].any():
            return True
    return False


def completions(counts: np.ndarray, largest: int, waste: int) -> list[Filling]:
    """Undominated fillings around ``largest``, the fullest first; none leaves more than ``waste`` open."""
    left = counts.copy()
    left[largest] -= 1
    room = len(counts) - 1 - largest
    if room and left[room]:
        return [(largest, room)]
    found: list[Filling] = []
    steps = 0

    def grow(filling: list[int], room: int, most: int) -> None:
        nonlocal steps
        there = np.flatnonzero(left[: min(room, most) + 1])[::-1]
        if room <= waste and not left[1 : room + 1].any() and not _dominated(filling[1:], left, room):
            found.append(tuple(filling))
        for length in there.tolist():
            steps += 1
            if steps > STEPS or len(found) >= BRANCHES:
                return
            left[length] -= 1
            grow([*filling, length], room - length, length)
            left[length] += 1

    grow([largest], room, room)
    if not found:  # the steps ran out, or every filling wastes too much: the greedy one
        filling, left[:] = [largest], counts
        left[largest] -= 1
        while len(there := np.flatnonzero(left[: room + 1])):
            length = int(there[-1])
            left[length] -= 1
            filling.append(length)
            room -= length
        return [tuple(filling)] if room <= waste else []
    return sorted(found, key=lambda f: (-sum(f), len(f), tuple(-x for x in f)))


def _times(counts: np.ndarray, filling: Filling) -> int:
    lengths, needs = np.unique(filling, return_counts=True)
    return int((counts[lengths] // needs).min())


def _taken(counts: np.ndarray, filling: Filling, times: int) -> np.ndarray:
    lengths, needs = np.unique(filling, return_counts=True)
    out = counts.copy()
    out[lengths] -= needs * times
    return out


def bin_completion(counts: np.ndarray, nodes: int = NODES) -> Plan:
    """The fewest sequences that the search finds for ``counts[length]`` pieces of each length."""
    size = len(counts) - 1
    counts = counts.astype(np.int64)
    total, bound = int((counts * np.arange(size + 1)).sum()), lower_bound(counts)
    plan = best_fit(counts)
    best = sum(times for _, times in plan)
    if best == bound:
        return plan

    def branches(counts: np.ndarray, waste: int) -> Iterator[tuple[Filling, int]]:
        largest = int(np.flatnonzero(counts)[-1])
        for filling in completions(counts, largest, waste):
            times = _times(counts, filling)
            while times:
                yield filling, times
                times //= 2

    trail: Plan = []
    stack = [(counts, 0, 0, branches(counts, (best - 1) * size - total))]
    while stack and nodes > 0 and best > bound:
        here, used, waste, more = stack[-1]
        taken = next(more, None)
        if taken is None:
            stack.pop()
            if trail:
                trail.pop()
            continue
        nodes -= 1
        filling, times = taken
        left, now = _taken(here, filling, times), used + times
        open_ = waste + times * (size - sum(filling))
        if open_ > (best - 1) * size - total or now + lower_bound(left) >= best:
            continue
        rest = best_fit(left)
        if now + sum(n for _, n in rest) < best:
            best, plan = now + sum(n for _, n in rest), [*trail, taken, *rest]
        if left.any():
            trail.append(taken)
            stack.append((left, now, open_, branches(left, (best - 1) * size - total - open_)))
    return plan


# --- pieces -----------------------------------------------------------------------------


def cut(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of all documents with their ids, stored: each knows its task and its rank there."""
    held = subwords.ship(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        e = subwords.encoder(held)
        tail = b"" if end_id is None else np.array([end_id], e.dtype).tobytes()
        seen, part, width = np.zeros(size + 1, np.int64), TaskContext.get().partitionId(), e.dtype.itemsize
        for batch in batches:
            for slab in texts.slabs(batch, "t"):
                out = []
                for k, t in zip(slab.column("k").to_pylist(), slab.column("t"), strict=True):
                    ids = e.encode(t.as_py()) + tail
                    n = len(ids) // width
                    begin, piece, stop = 0, 0, n % size or min(n, size)
                    while begin < n:
                        own = ids[begin * width : stop * width]
                        check = zlib.crc32(np.frombuffer(own, e.dtype).astype("<u4").tobytes())
                        out.append((k, piece, begin, stop - begin, own, check, part, int(seen[stop - begin])))
                        seen[stop - begin] += 1
                        begin, piece, stop = stop, piece + 1, stop + size
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA
                    )

    source = docs.select(
        F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    return stored(spread(source).mapInArrow(run, _PIECES), "pieces")


_SCHEMA = pa.schema([
    ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()),
    ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()),
])


def _slots(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """Which ranks of a length stand where: length, first rank, rank behind, first sequence, offset."""
    out, rank, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length in filling:
            first = rank.get(length, 0)
            out.append((length, first, first + times, sequence, offset))
            rank[length] = first + times
            offset += length
        sequence += times
    return out


def place(pieces: DataFrame, size: int = SIZE, nodes: int = NODES) -> DataFrame:
    """``pieces`` as ``cut`` gives them, with sequence_id and offset."""
    spark = pieces.sparkSession
    tally = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    counts = np.zeros(size + 1, np.int64)
    for row in tally.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[row["length"]] = row["n"]
    slots = spark.createDataFrame(
        _slots(bin_completion(counts, nodes)), "length int, low long, high long, first long, offset long"
    )
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = tally.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    fits = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    return (
        ranked.withColumnRenamed("length", "own")
        .join(F.broadcast(slots), (F.col("own") == F.col("length")) & fits)
        .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
        .select("key", "piece", "start", F.col("own").cast("long").alias("length"), "ids", "ids_crc32", "sequence_id", "offset")
    )


def pack(
    docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", nodes: int = NODES,
) -> DataFrame:
    """Pieces with their ids (as the encoder's little-endian numbers), the crc32 of these as
    32-bit numbers, sequence_id and offset."""
    return place(cut(docs, tokenizer, size, end_id, id_col, text_col), size, nodes)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids, and where its documents begin in it."""
    own = F.sort_array(F.collect_list(F.struct("offset", "length", "key", "ids")))
    held = packed.groupBy("sequence_id").agg(own.alias("own"))
    joined = F.aggregate("own", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    last = F.element_at("own", -1)
    return held.select(
        "sequence_id", joined.alias("ids"), (last["offset"] + last["length"]).alias("n_tokens"),
        F.col("own.offset").alias("offsets"), F.col("own.key").alias("keys"),
    )
