"""Words of many texts at once, as numpy arrays inside a task.

Texts arrive as Arrow batches. A batch is cut into slabs of about ``SLAB_BYTES`` bytes
(one document at least), so memory follows the slab, not the batch. Words are found on
the UTF-8 bytes: every separator is an ASCII byte, and no byte of a longer character is.
A word stands as a 64-bit hash of its bytes, A-Z lower-cased where asked for. Two words
of n different ones share a hash with probability n*n / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB_BYTES = 2_000_000

#: Bytes that separate words: space and TAB to CR.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
#: Every ASCII byte that is neither a digit nor a lower-case letter.
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; distinct inputs stay distinct."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    return mix((code + np.uint64(1)) * _ODD)


class Words(NamedTuple):
    """Words of a slab: the document each lies in, its hash, words per document, and in the
    bytes of ``raw`` where each begins and how long it is."""

    doc: np.ndarray
    hash: np.ndarray
    per_doc: np.ndarray
    start: np.ndarray
    size: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.per_doc)))


def slabs(
    batch: pa.RecordBatch, column: str, size: int = SLAB_BYTES, rows: int | None = None
) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``size`` bytes of text, one row at least and ``rows`` at most."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start, n = 0, batch.num_rows
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        stop = stop if rows is None else min(stop, start + rows)
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; null is empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    if len(whole) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array, separators: bytes = WHITE, lower: bool = True) -> Words:
    data, offsets = raw(texts)
    n = len(offsets) - 1
    kind = np.ones(256, bool)
    # After lower-casing, A-Z are letters whatever the separators say.
    kind[list(separators)] = False
    if lower:
        kind[65:91] = kind[97:123]
    inside = kind[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return Words(none, np.zeros(0, np.uint64), np.zeros(n, np.int64), none, none)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = inside[begins]
    starts = np.flatnonzero(opens)
    place = np.flatnonzero(inside)
    first = np.flatnonzero(opens[place])
    lengths = np.diff(np.append(first, len(place)))
    power = np.full(int(lengths.max()), 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    along = np.arange(len(place)) - np.repeat(first, lengths)
    value = _byte_values(lower)[data[place]] * power[along]
    found = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * _ODD)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return Words(doc, found, np.bincount(doc, minlength=n).astype(np.int64), starts, lengths)


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every run of ``size`` words; a shorter text is one run."""
    n = len(w.hash)
    factor = mix((np.arange(size, dtype=np.uint64) + np.uint64(11)) * _ODD) | np.uint64(1)
    doc, found = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total += w.hash[j : n - size + 1 + j] * factor[j]
        whole = w.doc[: n - size + 1] == w.doc[size - 1 :]
        doc, found = w.doc[: n - size + 1][whole], mix(total[whole])
    short = np.flatnonzero((w.per_doc > 0) & (w.per_doc < size))
    if len(short):
        rows = np.flatnonzero(np.isin(w.doc, short))
        along = rows - w.first[w.doc[rows]]
        begin = np.flatnonzero(along == 0)
        total = np.add.reduceat(w.hash[rows] * factor[along], begin)
        found = np.concatenate([found, mix(total + w.per_doc[short].astype(np.uint64) * _ODD)])
        doc = np.concatenate([doc, short])
    return doc, found


def distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs, sorted by document, then value."""
    if not len(doc):
        return doc, value
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[keep], value[keep]


def task_id(serial: int) -> int:
    """A number for the ``serial``-th thing a task makes; a repeated task makes the same."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) + serial
