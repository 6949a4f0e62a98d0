"""Subword ids of many texts with a given tokenizer file.

The tokenizer's file travels to the tasks as a broadcast value of fixed size; the first
task of a Python worker builds the tokenizer, later ones find it there. For byte-level
tokenizers a text falls apart at every single blank between two other characters, since
no piece crosses such a place; the ids of each word are then kept for the next time it
comes, up to ``CACHE_WORDS`` words. What does not fall apart that way, and every other
kind of tokenizer, takes the tokenizer's own whole-text path, with equal ids. So do texts
that hold the string of an added token (such as ``<|endoftext|>``), which the library
encodes as that token.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

CACHE_WORDS, CACHE_PIECES = 600_000, 300_000

_BLANK = re.compile(r"(?<=\S)(?= \S)")
# Runs of letters that need no look at Unicode tables, of digits, and of ASCII signs other
# than the apostrophe: the pieces of a word that holds nothing else.
_RUN = r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+"
_RUNS, _PLAIN = re.compile(_RUN), re.compile(f"(?:{_RUN})+")


class _Uneven(Exception):
    """A text in which a blank touches other white space, or that holds an added token's string."""


class _Ids(dict):
    """Word -> bytes of its ids; fills itself."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder = encoder
        self.lead = lead

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace() or self.encoder.find_added(word):
            raise _Uneven
        if "\n" in word:
            return self.encoder.lines(self.lead, word)
        found = self.encoder.word(self.lead, word)
        if len(self) < CACHE_WORDS:
            self[word] = found
        return found


class _Pieces(dict):
    """Piece with its lead -> bytes of its ids; words share their stems and their signs."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        e = self.encoder
        found = array(e.code, [x.id for x in e.model.tokenize(piece.translate(e.letters))]).tobytes()
        if len(self) < CACHE_PIECES:
            self[piece] = found
        return found


class _Letters(dict):
    """Code point -> the characters that stand for its bytes in the vocabulary."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.pre = tokenizer.pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = "".join(x for x, _ in self.pre.pre_tokenize_str(chr(code)))
        return self[code]


class Encoder:
    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(file)
        #: Their strings stand for ids of their own, wherever they are in a text.
        added = [re.escape(x["content"]) for x in told.get("added_tokens") or ()]
        self.find_added = re.compile("|".join(added) or r"(?!)").search
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        self.by_word = (
            pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and not told.get("normalizer") and model.get("type") == "BPE"
            and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
        )
        self.letters = _Letters(self.tokenizer)
        self.model = self.tokenizer.model
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = _Pieces(self)
        self.first, self.later = _Ids(self, ""), _Ids(self, " ")
        self.line_end = self._bytes(self.tokenizer.encode("\n", add_special_tokens=False).ids) if self.by_word else b""

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def lines(self, lead: str, word: str) -> bytes:
        """A stretch without blanks over several lines; a single line end is a piece of its own."""
        first, *later = word.split("\n")
        try:
            begin = (self.later if lead else self.first)[first]
            return begin + b"".join(self.line_end + self.first[x] for x in later)
        except _Uneven:
            return self._bytes(self.tokenizer.encode(lead + word, add_special_tokens=False).ids)

    def word(self, lead: str, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.pieces[lead + word]
        if not _PLAIN.fullmatch(word):
            return self._bytes(self.tokenizer.encode(lead + word, add_special_tokens=False).ids)
        pieces = _RUNS.findall(word)
        pieces[0] = lead + pieces[0]
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as little-endian numbers of ``dtype``."""
        if not text:
            return b""
        if self.by_word:
            first, *later = text.split(" ")
            try:
                return self.first[first] + b"".join(map(self.later.__getitem__, later))
            except _Uneven:
                pieces = [text] if self.find_added(text) else _BLANK.split(text)
                encoded = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        else:
            encoded = [self.tokenizer.encode(text, add_special_tokens=False)]
        return b"".join(self._bytes(e.ids) for e in encoded)

    def encode_words(self, words: list[str]) -> bytes:
        """The ids of words that stand with one blank between them."""
        if not self.by_word or not words:
            return self.encode(" ".join(words))
        try:
            return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))
        except _Uneven:
            return self.encode(" ".join(words))

    def encode_rows(self, known: list[str], place: np.ndarray, per_row: np.ndarray) -> list[bytes]:
        """As ``encode_words`` for each of many rows of words, which are places in ``known``.

        Each different word is looked up once, not once for every place.
        """
        edge = np.append(0, np.cumsum(per_row))
        rows_of = lambda r: [known[i] for i in place[edge[r] : edge[r + 1]]]
        if not self.by_word:
            return [self.encode_words(rows_of(r)) for r in range(len(per_row))]
        found, odd = [], np.zeros(len(known), bool)
        for i, word in enumerate(known):
            try:
                found.append(self.later[word])
            except _Uneven:
                found.append(b"")
                odd[i] = True
        # The first word of a row has no blank before it, so it is an entry of its own.
        heads = edge[:-1][per_row > 0]
        found += [b"" if odd[i] else self.first[known[i]] for i in place[heads].tolist()]
        entry = place.copy()
        entry[heads] = len(known) + np.arange(len(heads))
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        n = size.take(entry)
        end = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(found), self.dtype)
        ids = ids.take(np.arange(end[-1]) + np.repeat((np.cumsum(size) - size).take(entry) - end[:-1], n))
        cut = end[edge].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)]
        if odd.any():
            for r in np.unique(np.searchsorted(edge, np.flatnonzero(odd[place]), side="right") - 1).tolist():
                out[r] = self.encode_words(rows_of(r))
        return out


def ship(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file at ``path``, read once by the driver, for ``encoder`` in the tasks."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def encoder(held: Broadcast) -> Encoder:
    """The worker's encoder; it stays with the broadcast value between tasks."""
    value = held.value
    if "encoder" not in value:
        value["encoder"] = Encoder(value["file"])
    return value["encoder"]
