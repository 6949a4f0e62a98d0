"""Repair of the structure of conversations by the cheapest edits.

A conversation's rows, in the order of turn (nulls first), role and text, are edited so
that the first letters of the roles read ``(s?(ua)+)?``: Keep costs nothing, Rerole to
user or assistant 3, Delete 4, Insert (an empty user or assistant turn) 3. A row's first
fault counts: blank (no visible character), duplicate (role and text seen earlier in the
conversation), truncated (the last visible character ends no sentence). Blank and
duplicate rows have to be deleted; a truncated row that stays costs 3 more. Of the
cheapest sequences of edits, the one whose initials (D, I, K, R) come first is taken.

Method. A node is a place in the conversation and a state (nothing yet, after system,
after user, after assistant). The cost to the end is summed backwards over the rows, for
many conversations at once. The arcs that keep to the least cost are then ranked by what
they spell: first by their own letter, then, in rounds, by the rank of what they spell in
twice as many letters, each round looking up the rank at a pointer that jumps twice as
far. The arcs of one node carry different letters, so ranks never tie there, and the
least path is read off through the pointers.

Conversations are dealt by id and read in order; one of more than ``LONG_ROWS`` rows or
``LONG_BYTES`` bytes of text is cut into parts of ``PART_ROWS`` rows that are dealt
anywhere: a part gives its costs between any two states, the parts' tables are chained
backwards to the cost behind each part and then forwards to the state before it, and with
both known each part finds its own piece of the path. Only the SHA-256 of such a
conversation's text is one stream through one task, as that digest cannot be split.

Rows with a null id are one conversation. A null turn comes first and counts for no gap;
null roles and texts are one space. Repeated rows are duplicates; ties in turn are broken
by role and text. A role whose first letter is none of s, u, a, or that is empty, cannot
be kept as it is. Extra columns are not read. An empty table gives no rows; a
conversation without present rows gives zeros, an empty audit and the digest of nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casemill.session import lookup, numbered, stored

LONG_ROWS = 20_000
LONG_BYTES = 64 << 20
PART_ROWS = 4_096
SLAB_ROWS = 8_192
SLAB_BYTES = 16 << 20

WHITE = " \t\n\x0b\x0c\r"
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3

#: Letters in the order in which they count; 0 ends a path.
LETTERS = np.frombuffer(b" DIKR", np.uint8)
_D, _I, _K, _R = 1, 2, 3, 4
_FAR = 1 << 40
#: The state after the next user or assistant turn, by the state before it.
_NEXT = np.array([2, 2, 3, 2])
#: Where a kept row leads, by its initial (other, s, u, a) and the state; -1: nowhere.
_KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
_ROLE = {2: "user", 3: "assistant"}


class Rows(NamedTuple):
    """Rows of some conversations (or parts) one after the other."""

    first: np.ndarray  # where each begins, and the end
    initial: np.ndarray  # 0 other, 1 s, 2 u, 3 a
    fault: np.ndarray  # 0 none, 1 blank, 2 duplicate, 3 truncated


# --- costs ---------------------------------------------------------------------------


def _inserted(cost: np.ndarray) -> None:
    """Let turns be inserted at places whose costs stand in the lines of ``cost``."""
    user = np.minimum(cost[:, 2], INSERT + cost[:, 3])
    cost[:, 3] = np.minimum(cost[:, 3], INSERT + cost[:, 2])
    cost[:, 2] = user
    cost[:, :2] = np.minimum(cost[:, :2], INSERT + user[:, None])


def costs(rows: Rows, behind: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least cost from each place (one more than rows, in each conversation) and state to the end.

    ``behind`` is the cost after each conversation's rows, by state; turns are inserted
    there only where it is ``last``, otherwise the next part does that.
    """
    sizes = np.diff(rows.first)
    place = rows.first[:-1] + np.arange(len(sizes))
    cost = np.full((rows.first[-1] + len(sizes), 4), _FAR)
    ends = place + sizes
    at_end = behind.copy()
    closing = at_end[last]
    _inserted(closing)
    at_end[last] = closing
    cost[ends] = at_end
    order = np.argsort(-sizes, kind="stable")
    for t in range(1, int(sizes.max(initial=0)) + 1):
        some = order[: np.searchsorted(-sizes[order], -t, side="right")]
        here = ends[some] - t
        row = rows.first[some + 1] - t
        after = cost[here + 1]
        now = DELETE + after
        stays = rows.fault[row] % TRUNCATED == 0
        extra = np.where(stays, CUT * (rows.fault[row] == TRUNCATED), _FAR)[:, None]
        target = _KEPT[rows.initial[row]]
        kept = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), 1), _FAR)
        now = np.minimum(now, np.minimum(kept, RETYPE + after[:, _NEXT]) + extra)
        _inserted(now)
        cost[here] = now
    return np.minimum(cost, _FAR)


# --- least paths ---------------------------------------------------------------------


class Paths(NamedTuple):
    """Steps of the least paths in order: whose, letter, place, state before and after."""

    whose: np.ndarray
    letter: np.ndarray
    place: np.ndarray
    before: np.ndarray
    after: np.ndarray
    exits: np.ndarray  # state at the end of each


def _arcs(rows: Rows, cost: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arcs that keep to the least cost, as from, letter, to; a closing loop where none leaves."""
    sizes = np.diff(rows.first)
    places = len(cost)
    end = np.zeros(places, bool)
    end[np.cumsum(sizes + 1) - 1] = True
    inner = np.flatnonzero(~end)
    fault, initial = rows.fault, rows.initial
    state = np.arange(4)
    stays = (fault % TRUNCATED == 0)[:, None]
    extra = (CUT * (fault == TRUNCATED))[:, None]
    found = []

    def add(place: np.ndarray, letter: int, to_place: np.ndarray, to: np.ndarray, price, allowed) -> None:
        to = np.broadcast_to(to, (len(place), 4))
        reached = cost[to_place[:, None], np.maximum(to, 0)]
        on, s = np.nonzero(allowed & (to >= 0) & (cost[place] == price + reached))
        found.append((4 * place[on] + s, np.full(len(on), letter), 4 * to_place[on] + to[on, s]))

    whole = np.ones((len(inner), 4), bool)
    add(inner, _D, inner + 1, state, DELETE, whole)
    add(inner, _K, inner + 1, _KEPT[initial], extra, whole & stays)
    add(inner, _R, inner + 1, _NEXT, RETYPE + extra, whole & stays)
    open_ = np.flatnonzero(~end | np.repeat(last, sizes + 1))
    add(open_, _I, open_, _NEXT, INSERT, np.ones((len(open_), 4), bool))
    closed = np.ones(4 * places, bool)
    for source, _, _ in found:
        closed[source] = False
    loops = np.flatnonzero(closed)
    found.append((loops, np.zeros(len(loops), np.int64), loops))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def least_paths(rows: Rows, cost: np.ndarray, last: np.ndarray, entry: np.ndarray) -> Paths:
    """The least sequence of edits of each conversation, from its ``entry`` state."""
    source, letter, to = _arcs(rows, cost, last)
    order = np.lexsort((letter, source))
    source, letter, to = source[order], letter[order], to[order]
    begin = np.searchsorted(source, np.arange(4 * len(cost)))
    closing = np.zeros(4 * len(cost), bool)
    closing[source[letter == 0]] = True
    rank, jump, jumps = letter, to, []
    while True:
        # The least arc of every node by its rank so far; ranks differ within a node.
        by_rank = np.lexsort((rank, source))
        best = by_rank[begin]
        jumps.append(jump[best])
        if closing[jump].all():
            break
        behind = best[jump]
        pair = rank * (np.int64(rank.max()) + 1) + rank[behind]
        rank, jump = np.unique(pair, return_inverse=True)[1], jump[behind]
    sizes = np.diff(rows.first)
    begins = rows.first[:-1] + np.arange(len(sizes))
    start = 4 * begins + entry
    on = np.zeros(4 * len(cost), bool)
    on[start] = True
    for ahead in reversed(jumps):
        on[ahead[on]] = True
    nodes = np.flatnonzero(on)
    place = nodes // 4
    # At one place the cost falls with every inserted turn.
    nodes = nodes[np.lexsort((-cost.reshape(-1)[nodes], place))]
    place = nodes // 4
    whose = np.repeat(np.arange(len(sizes)), sizes + 1)[place]
    taken = best[nodes]
    ends = letter[taken] == 0
    exits = np.zeros(len(sizes), np.int64)
    exits[whose[ends]] = nodes[ends] % 4
    steps = ~ends
    return Paths(
        whose[steps], letter[taken[steps]], (place - begins[whose])[steps], nodes[steps] % 4, to[taken[steps]] % 4, exits
    )


# --- rows in a task --------------------------------------------------------------------


class _Talk:
    """One conversation, or a part of one, as a task gathers it."""

    def __init__(self, name: tuple):
        self.name = name
        self.turn, self.role, self.text, self.initial, self.fault, self.place = [], [], [], [], [], []
        self.seen: set[bytes] = set()
        self.size = 0

    def add(self, turn, role, text, blank, cut, known, place) -> None:
        if known is None:
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode(errors="surrogatepass")).digest()
            known = key in self.seen
            self.seen.add(key)
        self.turn.append(turn)
        self.role.append(role)
        self.text.append(text)
        self.initial.append(" sua".find(role[:1]) if role[:1] in ("s", "u", "a") else 0)
        self.fault.append(BLANK if blank else DUPLICATE if known else TRUNCATED if cut else 0)
        self.place.append(place)
        self.size += len(text or "")

    def measures(self) -> dict:
        """What can be summed over parts; turns stand in order, nulls first."""
        turns = [t for t in self.turn if t is not None]
        pair = list(zip(self.initial, self.initial[1:], strict=False))
        return {
            "n": len(self.role), "blank": self.fault.count(BLANK), "duplicate": self.fault.count(DUPLICATE),
            "truncated": self.fault.count(TRUNCATED), "illegal": sum(map(_illegal, pair)),
            "turns": len(set(turns)), "low": min(turns, default=None), "high": max(turns, default=None),
            "opens": self.initial[0] if self.role else None, "closes": self.initial[-1] if self.role else None,
        }


def _illegal(pair: tuple[int, int]) -> bool:
    return pair not in ((1, 2), (2, 3), (3, 2))


def _joined(talks: list[_Talk]) -> Rows:
    sizes = [len(t.role) for t in talks]
    flat = lambda name: np.array([v for t in talks for v in getattr(t, name)], np.int64)
    return Rows(np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), flat("initial"), flat("fault"))


def _edited(talks: list[_Talk], paths: Paths) -> list[tuple[str, list[tuple[int, str, str]]]]:
    """Per conversation its audit and the repaired turns, each with the row at or before which it stands."""
    out = [(bytearray(), []) for _ in talks]
    for w, letter, i, after in zip(*(x.tolist() for x in (paths.whose, paths.letter, paths.place, paths.after)), strict=True):
        audit, lines = out[w]
        audit.append(LETTERS[letter])
        if letter == _I:
            lines.append((i, _ROLE[after], ""))
        elif letter != _D:
            talk = talks[w]
            lines.append((i, talk.role[i] if letter == _K else _ROLE[after], talk.text[i]))
    return [(a.decode(), lines) for a, lines in out]


def _talks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[_Talk]]:
    """Rows in order of their keys, as slabs of whole conversations (or parts)."""
    slab, rows, size = [], 0, 0
    columns = ["turn", "role", "text", "blank", "cut", "known", "place"]
    for batch in batches:
        there = set(batch.schema.names)
        names = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
        none = [None] * batch.num_rows
        values = zip(*(batch.column(c).to_pylist() if c in there else none for c in columns), strict=True)
        for name, present, value in zip(names, batch.column("present").to_pylist(), values, strict=True):
            if not slab or slab[-1].name != name:
                if rows >= SLAB_ROWS or size >= SLAB_BYTES or len(slab) >= SLAB_ROWS:
                    yield slab
                    slab, rows, size = [], 0, 0
                slab.append(_Talk(name))
            if present:
                slab[-1].add(*value)
                rows += 1
                size += len(value[2] or "")
    if slab:
        yield slab


_OPEN = np.array([[0, _FAR, _FAR, 0]], np.int64)


def _solve(talks: list[_Talk]) -> tuple[np.ndarray, list]:
    """Cost, audit and repaired turns of whole conversations."""
    rows, last = _joined(talks), np.ones(len(talks), bool)
    cost = costs(rows, np.repeat(_OPEN, len(talks), 0), last)
    begins = rows.first[:-1] + np.arange(len(talks))
    found = _edited(talks, least_paths(rows, cost, last, np.zeros(len(talks), np.int64)))
    # Without rows there is nothing to edit.
    return cost[begins, 0], found


def _line(role: str, text: str) -> bytes:
    return f"{role}:{text}".encode(errors="surrogatepass")


_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _gaps(m: dict) -> int:
    return 0 if m["low"] is None else m["high"] - m["low"] + 1 - m["turns"]


def _prepared(turns: DataFrame, conv, turn, role, text, present: Column | None) -> DataFrame:
    """Rows as the tasks read them; ``blank`` and ``cut`` are decided by Spark."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(" "))
    seen = F.rtrim(said, F.lit(WHITE))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    return turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), said.alias("text"),
        (seen == "").alias("blank"), (~F.substring(seen, -1, 1).isin(".", "!", "?")).alias("cut"), here.alias("present"),
    )


def _order() -> list[Column]:
    return [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv").sortWithinPartitions(*_order())


def _split(rows: DataFrame, long_rows: int, long_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations that fit a task, and those of the others, if there are any."""
    size = rows.groupBy("conv").agg(F.count_if("present").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = stored(size.filter((F.col("n") > long_rows) | (F.col("bytes") > long_bytes)).select("conv"), "long")
    if long.isEmpty():
        return rows, None
    # A null id becomes an empty list, so that it joins like any other.
    key = F.array_compact(F.array("conv"))
    marked = lookup(rows.withColumn("key", key), long.select(key.alias("key"), F.lit(True).alias("long")), ["key"])
    marked = stored(marked.drop("key"), "turns")
    return marked.filter("long IS NULL").drop("long"), marked.filter("long AND present").drop("long")


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv"].dataType.simpleString()


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
    long_rows: int = LONG_ROWS,
    long_bytes: int = LONG_BYTES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Per conversation its faults, the cost and initials of its edits and the digest of the result.

    A row where ``present`` is not true says only that its conversation exists.
    """
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col, present)
    short, long = _split(rows, long_rows, long_bytes)
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for talks in _talks(batches, ["conv"]):
            found, (cost, edits) = [], _solve(talks)
            for talk, price, (audit, lines) in zip(talks, cost.tolist(), edits, strict=True):
                m = talk.measures()
                digest = hashlib.sha256(b"\n".join(_line(r, t) for _, r, t in lines)).hexdigest()
                found.append((
                    *talk.name, _gaps(m), m["blank"], m["duplicate"], m["truncated"], m["illegal"], price, audit, digest
                ))
            yield _batch(found, schema)

    schema = T.StructType().add("conv", kind)
    for field in T._parse_datatype_string(_FACTS):
        schema = schema.add(field)
    out = _in_order(short).mapInArrow(run, schema)
    if long is not None:
        out = out.unionByName(_Parts(long, part_rows).facts(schema))
    return out.withColumnRenamed("conv", conv_col)


def repaired(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    present: Column | None = None,
    long_rows: int = LONG_ROWS,
    long_bytes: int = LONG_BYTES,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The turns of the repaired conversations: id, place (rising, with gaps), role and text."""
    rows = _prepared(turns, conv_col, turn_col, role_col, text_col, present)
    short, long = _split(rows, long_rows, long_bytes)
    schema = T.StructType().add("conv", rows.schema["conv"].dataType).add("place", "long").add("role", "string").add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for talks in _talks(batches, ["conv"]):
            edits = _solve(talks)[1]
            yield _batch(
                [(*t.name, n, r, x) for t, (_, lines) in zip(talks, edits, strict=True) for n, (_, r, x) in enumerate(lines)],
                schema,
            )

    out = _in_order(short).mapInArrow(run, schema)
    if long is not None:
        out = out.unionByName(_Parts(long, part_rows).turns())
    return out.toDF(conv_col, "place", role_col, text_col)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(made)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)


# --- conversations that one task could not hold -----------------------------------------


class _Parts:
    """Long conversations, cut into parts that are dealt to any task."""

    def __init__(self, rows: DataFrame, part_rows: int):
        self.kind = rows.schema["conv"].dataType
        dealt = stored(numbered(rows, *_order(), name="number"), "numbered")
        key = F.array_compact(F.array("conv"))
        begins = dealt.groupBy("conv").agg(F.min("number").alias("begin")).select(key.alias("key"), "begin")
        placed = lookup(dealt.withColumn("key", key), begins, ["key"]).withColumn("place", F.col("number") - F.col("begin"))
        same = [F.col("conv"), F.col("role"), F.sha2("text", 256)]
        firsts = dealt.groupBy(*same).agg(F.min("number").alias("number")).select("number", F.lit(False).alias("known"))
        placed = placed.join(firsts, "number", "left").withColumn("known", F.coalesce("known", F.lit(True)))
        self.rows = stored(
            placed.select(
                "conv", F.floor(F.col("place") / part_rows).alias("part"), "place", "turn", "role", "text", "blank",
                "cut", "known", "present",
            ),
            "parts",
        )
        self.chain = self._chained()

    def _tasks(self, run: Callable, schema: T.StructType, state: DataFrame | None = None, text: bool = False) -> DataFrame:
        """``run`` over slabs of parts in order; with ``state``, its columns stand on each row."""
        rows = self.rows if text else self.rows.withColumn("text", F.lit(None).cast("string"))
        rows = rows.withColumn("key", F.array_compact(F.array("conv")))
        if state is not None:
            key = F.array_compact(F.array("conv")).alias("key")
            more = [c for c in state.columns if c not in ("conv", "part")]
            rows = lookup(rows, state.select(key, "part", *more), ["key", "part"])
        dealt = rows.drop("key").repartition("conv", "part").sortWithinPartitions("conv", "part", "place")
        keys = ["conv", "part"] + ([] if state is None else [c for c in state.columns if c not in ("conv", "part")])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for talks in _talks(batches, keys):
                yield _batch(run(talks), schema)

        return dealt.mapInArrow(each, schema)

    def _fields(self, more: str) -> T.StructType:
        schema = T.StructType().add("conv", self.kind).add("part", "long")
        for field in T._parse_datatype_string(more):
            schema = schema.add(field)
        return schema

    def _chained(self) -> DataFrame:
        """Per part: cost behind it by state, state before it, last or not; measures summed on the first part."""
        between = self._fields(
            "n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, "
            "opens long, closes long, costs array<long>"
        )

        def tables(talks: list[_Talk]) -> list[tuple]:
            rows, last = _joined(talks), np.zeros(len(talks), bool)
            begins = rows.first[:-1] + np.arange(len(talks))
            found = []
            for state in range(4):
                behind = np.full((len(talks), 4), _FAR)
                behind[:, state] = 0
                found.append(costs(rows, behind, last)[begins])
            table = np.stack(found, axis=2).reshape(len(talks), 16)
            return [(*t.name, *t.measures().values(), c) for t, c in zip(talks, table.tolist(), strict=True)]

        def backwards(_: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("part", ignore_index=True)
            cost = _OPEN.copy()
            _inserted(cost)
            behind = [list(_OPEN[0])]
            for table in parts["costs"][::-1]:
                cost = np.minimum((np.asarray(table).reshape(4, 4) + cost).min(axis=1)[None, :], _FAR)
                behind.append(cost[0].tolist())
            total, edge = int(behind.pop()[0]), zip(parts["closes"][:-1], parts["opens"][1:], strict=True)
            high, low = parts["high"], parts["low"]
            shared = (high[:-1].to_numpy() == low[1:].to_numpy()).sum()
            gaps = 0 if low.isna().all() else int(high.max() - low.min() + 1 - (parts["turns"].sum() - shared))
            sums = {c: int(parts[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
            sums["illegal"] += sum(_illegal((int(a), int(b))) for a, b in edge)
            return pd.DataFrame({
                "conv": parts["conv"], "part": parts["part"], "behind": behind[::-1],
                "last": [False] * (len(parts) - 1) + [True], "gaps": gaps, "cost": total, **sums,
            })

        costed = self._fields(
            "behind array<long>, last boolean, gaps long, cost long, blank long, duplicate long, truncated long, illegal long"
        )
        tables_ = self._tasks(tables, between).groupBy("conv")
        self.sums = stored(tables_.applyInPandas(backwards, costed), "costs")
        # Arrays as names of a slab's parts have to compare and hash: four columns.
        state = self.sums.select("conv", "part", *[F.col("behind")[i].alias(f"b{i}") for i in range(4)], "last")

        def leaving(talks: list[_Talk]) -> list[tuple]:
            rows, behind, last = _ends(talks)
            cost = costs(rows, behind, last)
            exits = [least_paths(rows, cost, last, np.full(len(talks), s)).exits for s in range(4)]
            return [(*t.name[:2], x) for t, x in zip(talks, np.stack(exits, axis=1).tolist(), strict=True)]

        def forwards(_: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            parts = parts.sort_values("part", ignore_index=True)
            entry = [0]
            for exits in parts["exits"][:-1]:
                entry.append(int(exits[entry[-1]]))
            return pd.DataFrame({"conv": parts["conv"], "part": parts["part"], "entry": entry})

        exits = self._tasks(leaving, self._fields("exits array<long>"), state).groupBy("conv")
        entered = exits.applyInPandas(forwards, self._fields("entry long"))
        key = F.array_compact(F.array("conv"))
        entered = entered.select(key.alias("key"), "part", "entry")
        return stored(state.withColumn("key", key).join(entered, ["key", "part"]).drop("key"), "chain")

    def pieces(self) -> DataFrame:
        """Per part its piece of the audit and its repaired turns."""

        def edit(talks: list[_Talk]) -> list[tuple]:
            rows, behind, last = _ends(talks)
            entry = np.array([t.name[7] for t in talks])
            found = _edited(talks, least_paths(rows, costs(rows, behind, last), last, entry))
            return [
                (*t.name[:2], audit, [{"role": r, "text": x} for _, r, x in lines])
                for t, (audit, lines) in zip(talks, found, strict=True)
            ]

        return self._tasks(edit, self._fields("audit string, lines array<struct<role:string,text:string>>"), self.chain, True)

    def turns(self) -> DataFrame:
        one = self.pieces().select("conv", "part", F.posexplode("lines").alias("i", "line"))
        return one.select("conv", (F.col("part") * (1 << 32) + F.col("i")).alias("place"), "line.role", "line.text")

    def facts(self, schema: T.StructType) -> DataFrame:
        """One row per conversation; its turns stream through a task in order, for the digest."""
        some = T.StructType().add("conv", self.kind).add("audit", "string").add("repaired_sha256", "string")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, digest, audit, begun = None, None, [], False
            for batch in batches:
                for row in batch.to_pylist():
                    if digest is None or row["conv"] != name:
                        if digest is not None:
                            yield _batch([(name, "".join(audit), digest.hexdigest())], some)
                        name, digest, audit, begun = row["conv"], hashlib.sha256(), [], False
                    audit.append(row["audit"])
                    for line in row["lines"]:
                        digest.update(b"\n" * begun + _line(line["role"], line["text"]))
                        begun = True
            if digest is not None:
                yield _batch([(name, "".join(audit), digest.hexdigest())], some)

        key = F.array_compact(F.array("conv")).alias("key")
        found = self.pieces().repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, some)
        sums = self.sums.filter("part = 0").drop("part", "behind", "last").select("*", key)
        return sums.join(found.select(key, "audit", "repaired_sha256"), "key").select(*schema.names)


def _ends(talks: list[_Talk]) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Rows of parts, the cost behind each and whether it is the last; the names hold them."""
    behind = np.array([t.name[2:6] for t in talks], np.int64).reshape(len(talks), 4)
    return _joined(talks), behind, np.array([t.name[6] for t in talks], bool)
