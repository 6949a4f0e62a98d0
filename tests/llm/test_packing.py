import random
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")

from casemill.llm import packing as P  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, ids string, part int, length string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 5, "y") for r in rows], SCHEMA)


def histogram(lengths, size):
    return np.bincount(np.array(lengths, int), minlength=size + 1)


def sequences_of(counts, plan):
    used = np.zeros_like(counts)
    for filling, times in plan:
        assert sum(filling) < len(counts) and times > 0
        for length in filling:
            used[length] += times
    assert (used == counts).all()
    return sum(times for _, times in plan)


def fewest(lengths, size):
    """By trying every sequence for every length."""

    @cache
    def rest(i, rooms):
        if i == len(order):
            return 0
        best = 1 + rest(i + 1, tuple(sorted((*rooms, size - order[i]))))
        for at in range(len(rooms)):
            if rooms[at] >= order[i]:
                left = (*rooms[:at], *rooms[at + 1 :], rooms[at] - order[i])
                best = min(best, rest(i + 1, tuple(sorted(left))))
        return best

    order = tuple(sorted(lengths, reverse=True))
    return rest(0, ())


def test_few_lengths_are_packed_as_well_as_can_be():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([10, 20, 30])
        lengths = [rng.randint(1, size) if rng.random() < 0.3 else rng.randint(size // 4, size // 2) for _ in range(9)]
        counts = histogram(lengths, size)
        assert sequences_of(counts, P.bin_completion(counts, 5_000)) == fewest(lengths, size), (size, lengths)


def test_search_beats_best_fit_and_keeps_every_piece():
    rng = np.random.default_rng(2)
    saved = []
    for lengths in (rng.integers(256, 500, 300), rng.integers(250, 513, 50_001), rng.choice([700, 400, 350, 330, 323], 50_000)):
        counts = histogram(lengths, 1024)
        found, plain = sequences_of(counts, P.bin_completion(counts)), sequences_of(counts, P.best_fit(counts))
        assert P.lower_bound(counts) <= found <= plain
        saved.append(plain - found)
    assert saved[1] > 0 and saved[2] > 500


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(3)
    counts = histogram(rng.integers(1, 1025, 100_000), 1024)
    small, large = P._slots(P.bin_completion(counts, 50)), P._slots(P.bin_completion(counts * 1_000_003, 50))
    assert len(large) < 3 * len(small)
    assert sequences_of(counts * 1_000_003, P.bin_completion(counts * 1_000_003, 50)) < 1.001 * 1_000_003 * P.lower_bound(counts)


def test_bounds_and_fillings():
    assert P.lower_bound(histogram([6, 6, 6], 10)) == 3 and P.lower_bound(histogram([], 10)) == 0
    assert P.lower_bound(histogram([10, 5, 5, 1], 10)) == 3
    assert P.bin_completion(histogram([], 10)) == []
    # 7 takes 3 for itself; 2 and 1 are dominated by it.
    assert P.completions(histogram([7, 3, 2, 1], 10), 7, 99) == [(7, 3)]
    assert P.completions(histogram([7, 2, 2], 10), 7, 99) == [(7, 2)]
    assert P.completions(histogram([6, 3, 2, 2], 10), 6, 99) == [(6, 2, 2), (6, 3)]
    assert P.completions(histogram([7, 2], 10), 7, 0) == []


def plain_pieces(rows, size):
    encoder, out = Tokenizer.from_file(PATH), []
    for doc, text in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out.append((doc, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), ids[a:b]))
    return out


def some_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ☃\n") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 90])))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "no id"), (3, "same id"), (202, "stop <|endoftext|> here<|endoftext|>")]
    return rows + [(203, "long text " * 30_000)] + [(300 + i, "the same again") for i in range(60)]


@pytest.mark.parametrize("size", [64, 1024])
def test_pieces_and_places(spark, size):
    rows = some_rows()
    packed = P.pack(frame(spark, rows).repartition(3), PATH, size)
    got = packed.drop("ids").collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r["key"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=key) == sorted(
        (r[:5] for r in plain_pieces(rows, size)), key=key
    )
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(own[-1]) <= size
    assert len(held) <= 1.02 * P.lower_bound(histogram([r["length"] for r in got], size)) + 1


def test_sequences_hold_the_pieces(spark):
    rows = some_rows()
    packed = P.pack(frame(spark, rows), PATH, 256)
    places = {(r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packed.collect()}
    for r in P.sequences(packed).collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u2")
        assert len(ids) == r["n_tokens"] <= 256
        ends = [*r["offsets"][1:], len(ids)]
        for a, b in zip(r["offsets"], ends):
            assert zlib.crc32(ids[a:b].astype("<u4").tobytes()) == places.pop((r["sequence_id"], a))
    assert not places


def test_rows_read_again_are_packed_alike(spark):
    docs = frame(spark, some_rows())
    first, again = (sorted(map(str, P.pack(docs, PATH, 128).drop("ids").collect())) for _ in range(2))
    assert first == again


def test_empty_table(spark):
    packed = P.pack(frame(spark, []), PATH)
    assert packed.count() == 0 and P.sequences(packed).count() == 0


def test_all_rows_alike_are_dealt_over_the_tasks(spark):
    packed = P.pack(frame(spark, [(i, "just these words") for i in range(500)]).repartition(4), PATH)
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(per) == -(-sum(r["n"] for r in per) // (1024 // 4 * 4))
