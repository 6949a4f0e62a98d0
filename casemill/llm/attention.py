"""A small causal self-attention model over subword ids, in numpy.

An id belongs to one of ``CLASSES`` classes of about equal frequency, and to one of
``BUCKETS`` input buckets (the most frequent ids have one of their own). The probability
of the next id is that of its class, which the network gives, times its smoothed share
of the class's tokens in the corpus. ``GROUP`` classes that follow each other make a group;
a class has the probability of its group times its own within the group, so that what a
target costs, in training and in scoring, is the groups and one group's classes.

The network has one head: each input bucket has a query, a key, a value, a row of group
logits and, for every group, a row of class logits; a position attends to itself and to
earlier positions of its window, with a learned weight per distance; what it gathers moves
the logits. Sequences are cut into windows of ``WIDTH`` targets that overlap by
``OVERLAP``; the overlap is context only, so every target is scored once, with at least
that much before it unless the text has less.

Training is Adam; a batch moves the rows of those buckets, and of those buckets and groups,
that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

WIDTH = 16
OVERLAP = 4
SIZE = 16
CLASSES = 128
GROUP = 16
GROUPS = CLASSES // GROUP
BUCKETS = 4096
OWN_BUCKETS = 3072

#: Largest magnitude of each table, so that no exponential, and no sum of a row's, overflows.
_BOUND = {"q": 2.5, "k": 2.5, "v": 5.0, "x": 10.0, "top": 10.0, "z": 0.9, "z_top": 0.9, "r": 5.0}


class Vocabulary(NamedTuple):
    """Per id: class, input bucket and log10 of its share of the class; and the id that ends a text."""

    kind: np.ndarray
    bucket: np.ndarray
    share: np.ndarray
    end: int

    @property
    def kinds(self) -> int:
        """Classes in use; fewer than ``CLASSES`` only for a tiny vocabulary."""
        return int(self.kind.max()) + 1


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """From the corpus counts of all ids; the last id is the end of a text."""
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(counts), np.int64)
    rank[order] = np.arange(len(counts))
    smooth = counts + 0.5
    kind = np.empty(len(counts), np.int64)
    # From the most frequent id on, a class is full with its part of the mass that is left.
    now, held, left = 0, 0.0, float(smooth.sum())
    for i, mass in zip(order.tolist(), smooth[order].tolist(), strict=True):
        if now < CLASSES - 1 and held and held >= left / (CLASSES - now):
            left, held, now = left - held, 0.0, now + 1
        kind[i], held = now, held + mass
    share = np.log10(smooth / np.bincount(kind, weights=smooth, minlength=CLASSES)[kind])
    bucket = np.where(rank < OWN_BUCKETS, rank, OWN_BUCKETS + np.arange(len(counts)) % (BUCKETS - OWN_BUCKETS))
    return Vocabulary(kind, bucket.astype(np.int32), share, len(counts) - 1)


def pairs(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """How often a class follows a bucket in a row of ids that begins and ends with the end's id."""
    cell = vocab.bucket[ids[:-1]].astype(np.int64) * CLASSES + vocab.kind[ids[1:]]
    return np.bincount(cell, minlength=BUCKETS * CLASSES)


def start(after: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Weights before training; ``after`` (counts of ``pairs``) gives the logits of each bucket."""
    rng = np.random.default_rng(1)
    table = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    top, logits = np.zeros((BUCKETS, GROUPS), np.float32), np.zeros((GROUPS, BUCKETS, GROUP), np.float32)
    if after is not None and after.any():
        n = after.reshape(BUCKETS, CLASSES).astype(np.float64)
        backing = n.sum(0) + 0.5
        share = ((n + 5 * backing / backing.sum()) / (n.sum(1, keepdims=True) + 5)).reshape(BUCKETS, GROUPS, GROUP)
        whole = share.sum(2)
        top = np.maximum(np.log(whole), -_BOUND["top"]).astype(np.float32)
        inside = np.log(share / whole[..., None]).transpose(1, 0, 2)
        logits = np.ascontiguousarray(np.maximum(inside, -_BOUND["x"]), np.float32)
    return {
        "q": table(BUCKETS, SIZE), "k": table(BUCKETS, SIZE), "v": table(BUCKETS, SIZE), "top": top, "x": logits,
        "z": table(GROUPS, SIZE, GROUP), "z_top": table(SIZE, GROUPS), "r": np.zeros(WIDTH, np.float32),
    }


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    shapes = {k: v.shape for k, v in start().items()}
    for k in sorted(shapes):
        n = int(np.prod(shapes[k]))
        out[k] = np.clip(values[at : at + n].reshape(shapes[k]), -_BOUND[k], _BOUND[k]).astype(np.float32)
        at += n
    return out


def _mask(r: np.ndarray) -> np.ndarray:
    """Weight per distance, and minus infinity for what comes later."""
    back = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
    return np.where(back >= 0, r[np.maximum(back, 0)], np.float32(-np.inf)).astype(np.float32)


class Tables(NamedTuple):
    """Query (scaled), key and value per bucket, group logits per bucket, class logits per
    group and bucket, what moves them, and the mask; logits of unused classes are minus infinity."""

    table: np.ndarray
    top: np.ndarray
    x: np.ndarray
    z_top: np.ndarray
    z: np.ndarray
    mask: np.ndarray


def joined(params: dict[str, np.ndarray], kinds: int = CLASSES) -> Tables:
    """The tables behind the first ``kinds`` classes."""
    scale = np.float32(SIZE**-0.5)
    table = np.concatenate([params["q"] * scale, params["k"], params["v"]], 1)
    top, x = params["top"].copy(), params["x"].copy()
    used = (np.arange(CLASSES) < kinds).reshape(GROUPS, GROUP)
    top[:, ~used.any(1)] = -np.inf
    x.transpose(0, 2, 1)[~used] = -np.inf
    return Tables(np.ascontiguousarray(table), top, x, params["z_top"], params["z"], _mask(params["r"]))


def _attend(table: np.ndarray, mask: np.ndarray, bucket: np.ndarray):
    """Queries, keys and values, attention weights and gathered values of windows (rows of ``bucket``)."""
    got = table.take(bucket, 0)
    q, k, v = got[..., :SIZE], got[..., SIZE : 2 * SIZE], got[..., 2 * SIZE :]
    a = _weights(np.matmul(q, k.transpose(0, 2, 1)), mask)
    return got, a, np.matmul(a, v)


def _weights(a: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Attention weights from products of queries and keys, in their place."""
    by_window, by_place = a.reshape(len(a), -1), a.reshape(-1, WIDTH)
    by_window += mask.ravel()
    np.exp(by_window, out=by_window)
    by_place *= (1 / (by_place @ np.ones(WIDTH, np.float32)))[:, None]
    return a


def _forward(table, top, x, z_top, z, mask, bucket: np.ndarray):
    """As ``_attend``, with the log probabilities of all classes in use, places by classes."""
    got, a, gathered = _attend(table, mask, bucket)
    log_p = lambda logits: logits - np.log(np.exp(logits).sum(-1, keepdims=True))
    lead = log_p(gathered @ z_top + top[bucket])
    whole = [lead[..., g : g + 1] + log_p(gathered @ z[g] + x[g][bucket]) for g in np.flatnonzero(np.isfinite(top[0]))]
    return got, a, gathered, np.concatenate(whole, -1)[..., : int(np.isfinite(x[:, 0]).sum())]


def _by_cell(bucket: np.ndarray, kind: np.ndarray):
    """Targets in the order of their cells (group, then bucket), their cells in that order, and
    where each group of them begins and ends."""
    cell = kind // GROUP * BUCKETS + bucket
    # Numbers of two bytes are sorted by their digits.
    order = np.argsort(cell.astype(np.uint16), kind="stable")
    cell = cell.take(order)
    return order, cell, np.searchsorted(cell, np.arange(GROUPS + 1) * BUCKETS)


def _class_logits(x: np.ndarray, z: np.ndarray, gathered: np.ndarray, cell: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Logits of the classes of each target's group; targets are in the order of ``_by_cell``."""
    logits = x.reshape(-1, GROUP).take(cell, 0)
    for g in range(GROUPS):
        some = slice(edges[g], edges[g + 1])
        logits[some] += gathered[some] @ z[g]
    return logits


def _gains(tables: Tables, gathered: np.ndarray, bucket: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Log probability of each target's class (``kind``) behind its place (``gathered``, ``bucket``)."""
    order, cell, edges = _by_cell(bucket, kind)
    at = np.arange(len(kind))
    logits = gathered @ tables.z_top
    logits += tables.top.take(bucket, 0)
    out = logits.ravel().take(at * GROUPS + kind // GROUP)
    np.exp(logits, out=logits)
    out -= np.log(logits @ np.ones(GROUPS, np.float32))
    logits = _class_logits(tables.x, tables.z, gathered.take(order, 0), cell, edges)
    inside = logits.ravel().take(at * GROUP + kind.take(order) % GROUP)
    np.exp(logits, out=logits)
    out[order] += inside - np.log(logits @ np.ones(GROUP, np.float32))
    return out


def _softmax_loss(logits: np.ndarray, goal: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Derivative of the weighted loss by the logits, in their place."""
    d = np.exp(logits, out=logits)
    d *= (weight / (d @ np.ones(d.shape[1], np.float32)))[:, None]
    d.ravel()[np.arange(len(goal)) * d.shape[1] + goal] -= weight
    return d


def _summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted keys, and the sums of their rows of ``values``."""
    begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
    # Columns are summed one by one; two of them make one of complex numbers.
    return key[begin], np.add.reduceat(values.view(np.complex64), begin).view(np.float32)


class _Adam:
    """A table and its moments; a step moves some of its rows."""

    def __init__(self, values: np.ndarray, bound):
        self.values, self.bound = values, np.asarray(bound, np.float32)
        self.first, self.second = np.zeros_like(values), np.zeros_like(values)

    def step(self, rows: np.ndarray, g: np.ndarray, fade: np.float32) -> None:
        first, second, values = (x.take(rows, 0) for x in (self.first, self.second, self.values))
        # The moments are kept ten and a hundred times as large, which their quotient cancels.
        first *= np.float32(0.9)
        second *= np.float32(0.99)
        first += g
        g *= g
        second += g
        self.first[rows], self.second[rows] = first, second
        np.sqrt(second, out=second)
        second += np.float32(1e-7)
        first /= second
        first *= fade
        values -= first
        np.clip(values, -self.bound, self.bound, out=values)
        self.values[rows] = values


def train(params: dict[str, np.ndarray], windows: Iterator[np.ndarray], vocab: Vocabulary, rate: float = 0.02):
    """Adam over batches of windows (rows of WIDTH + 1 ids, -1 behind a short text's end)."""
    scale = np.float32(SIZE**-0.5)
    # One row per bucket: query, key, value, group logits.
    own = _Adam(
        np.concatenate([params[c] for c in ("q", "k", "v", "top")], 1).astype(np.float32),
        np.repeat([_BOUND[c] for c in ("q", "k", "v", "top")], [SIZE, SIZE, SIZE, GROUPS]),
    )
    x = _Adam(params["x"].astype(np.float32).reshape(-1, GROUP), _BOUND["x"])
    # The small tables in one row; each is a part of it.
    small = [params[c].astype(np.float32) for c in ("z", "z_top", "r")]
    rest = _Adam(
        np.concatenate([s.ravel() for s in small]), np.repeat([_BOUND[c] for c in ("z", "z_top", "r")], [s.size for s in small])
    )
    parts = np.split(rest.values, np.cumsum([s.size for s in small])[:-1])
    z, z_top, r = (part.reshape(s.shape) for part, s in zip(parts, small, strict=True))
    all_rest = np.arange(len(rest.values))
    far = np.arange(WIDTH)[:, None] - np.arange(WIDTH)[None, :]
    unused = (np.arange(CLASSES) >= vocab.kinds).reshape(GROUPS, GROUP)
    earlier = far >= 0
    for step, ids in enumerate(windows, 1):
        there = ids[:, 1:] >= 0
        safe = np.where(ids >= 0, ids, vocab.end)
        bucket, goal = vocab.bucket.take(safe[:, :-1]), vocab.kind.take(safe[:, 1:]).ravel()
        weight = (there.ravel() / max(1, there.sum())).astype(np.float32)
        got = own.values.take(bucket, 0)
        q, k, v = got[..., :SIZE], got[..., SIZE : 2 * SIZE], got[..., 2 * SIZE : 3 * SIZE]
        a = np.matmul(q, k.transpose(0, 2, 1))
        a *= scale
        _weights(a, _mask(r))
        gathered = np.matmul(a, v)
        rows = gathered.reshape(-1, SIZE)
        order, cell, edges = _by_cell(bucket.ravel(), goal)
        late, back = rows.take(order, 0), np.empty_like(order)
        back[order] = np.arange(len(order))
        d_top = rows @ z_top
        d_top += got[..., 3 * SIZE :].reshape(-1, GROUPS)
        if unused.any():
            d_top[:, unused.all(1)] = -np.inf
        d_top = _softmax_loss(d_top, goal // GROUP, weight)
        d_x = _class_logits(x.values, z, late, cell, edges)
        if unused.any():
            d_x[unused[cell // BUCKETS]] = -np.inf
        d_x = _softmax_loss(d_x, goal.take(order) % GROUP, weight.take(order))
        d_z, d_late = np.empty_like(z), np.empty_like(late)
        for g in range(GROUPS):
            some = slice(edges[g], edges[g + 1])
            np.matmul(late[some].T, d_x[some], out=d_z[g])
            np.matmul(d_x[some], z[g].T, out=d_late[some])
        d_gathered = d_late.take(back, 0)
        d_gathered += d_top @ z_top.T
        # What the softmax takes off: the sum of a row of weights times their derivatives.
        taken = np.einsum("ij,ij->i", d_gathered, rows)
        d_gathered = d_gathered.reshape(gathered.shape)
        d_s = np.matmul(d_gathered, v.transpose(0, 2, 1))
        by_place = d_s.reshape(-1, WIDTH)
        by_place -= taken[:, None]
        d_s *= a
        both = (np.ones(len(d_s), np.float32) @ d_s.reshape(len(d_s), -1)).reshape(WIDTH, WIDTH)
        d_s *= scale
        d_in = np.empty_like(got)
        np.matmul(d_s, k, out=d_in[..., :SIZE])
        np.matmul(d_s.transpose(0, 2, 1), q, out=d_in[..., SIZE : 2 * SIZE])
        np.matmul(a.transpose(0, 2, 1), d_gathered, out=d_in[..., 2 * SIZE : 3 * SIZE])
        d_in = d_in.reshape(-1, own.values.shape[1])
        d_in[:, 3 * SIZE :] = d_top
        by_bucket = np.argsort(bucket.ravel().astype(np.uint16), kind="stable")
        fade = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
        own.step(*_summed(bucket.ravel().take(by_bucket), d_in.take(by_bucket, 0)), fade)
        x.step(*_summed(cell, d_x), fade)
        d_r = np.bincount(far[earlier], weights=both[earlier]).astype(np.float32)
        rest.step(all_rest, np.concatenate([d_z.ravel(), (rows.T @ d_top).ravel(), d_r]), fade)
    done = dict(zip(("q", "k", "v", "top"), np.split(own.values, np.arange(1, 4) * SIZE, 1), strict=True))
    return done | {"x": x.values.reshape(GROUPS, BUCKETS, GROUP), "z": z, "z_top": z_top, "r": r}


def score(sequences: list[np.ndarray], tables, vocab: Vocabulary, batch: int = 256) -> np.ndarray:
    """log10 of the probability of each sequence of ids, its end included."""
    lengths = np.array([len(s) + 1 for s in sequences], np.int64)
    gap = np.array([vocab.end])
    row = np.concatenate([part for s in sequences for part in (gap, s)] + [gap] * (WIDTH + 1)) if sequences else gap
    first = np.cumsum(lengths) - lengths
    stride = WIDTH - OVERLAP
    pieces = 1 + np.maximum(0, -(-(lengths - WIDTH) // stride))
    doc = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin, left = first[doc] + nth * stride, lengths[doc] - nth * stride
    bucket, kind, share = vocab.bucket[row], vocab.kind[row], vocab.share[row]
    # Each target's share of its class needs no window. The end of text d stands where d + 1 begins.
    out = np.add.reduceat(share[1 : lengths.sum() + 1], first) if len(lengths) else np.zeros(0)
    heads = np.flatnonzero(nth == 0)
    for some, skip in ((heads, 0), (np.flatnonzero(nth > 0), OVERLAP)):
        for b in range(0, len(some), batch):
            part = some[b : b + batch]
            at = begin[part][:, None] + np.arange(WIDTH)
            gathered = _attend(tables.table, tables.mask, bucket.take(at))[2][:, skip:].reshape(-1, SIZE)
            late = at[:, skip:].ravel()
            gain = _gains(tables, gathered, bucket.take(late), kind.take(late + 1)).reshape(len(part), -1)
            valid = np.arange(skip, WIDTH)[None, :] < left[part][:, None]
            gained = np.where(valid, gain, 0).sum(1, dtype=np.float64)
            out += np.bincount(doc[part], weights=gained, minlength=len(out)) / np.log(10)
    return out
