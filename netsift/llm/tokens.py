"""Whole texts to token ids by the tokenizers library, repeated pieces encoded once.

The byte-level pre-tokenizer never joins what stands before a space and what follows it when the
next character is no white space, so a text may be cut there: each piece (with its leading space)
has the same ids alone as in its text. A worker keeps the ids of the pieces that it has met and of
their pre-tokens (words, punctuation), and gives the library only new pre-tokens, many in one call.
Pieces next to runs of white space stay whole. The memory of pieces is emptied
at ``MOST_PIECES``, that of pre-tokens at ``MOST_WORDS``, both when another operator takes the worker.
"""

from __future__ import annotations

import os
import re

import numpy as np

MOST_PIECES = 1_000_000
MOST_WORDS = 300_000
#: Bytes of text given to the encoder in one call; a longer text goes alone.
ENCODE_BYTES = 1 << 19
#: Pre-tokens given to the library in one string, with a character between them that has a token of its own.
_GROUP, _BETWEEN = 512, "\0"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Marks the first piece of a text, which has no leading space; no other piece begins with one.
_FIRST = " "
_made: dict[str, Encoder] = {}


class _Numbered(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = i = len(self)
        self.new.append(key)
        return i

    def of(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class _Lists:
    """Lists of ids, one behind the other; 16 bits an id while they fit."""

    def __init__(self) -> None:
        self.ids, self.used, self.known = np.zeros(1 << 16, np.uint16), 0, 0
        self.start, self.count = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    @staticmethod
    def _room(a: np.ndarray, size: int) -> np.ndarray:
        if size <= len(a):
            return a
        out = np.zeros(max(size, len(a) * 3 // 2), a.dtype)
        out[: len(a)] = a
        return out

    def add(self, flat: np.ndarray, count: np.ndarray) -> None:
        if len(flat) and self.ids.dtype == np.uint16 and flat.max() > 0xFFFF:
            self.ids = self.ids.astype(np.uint32)
        end, last = self.used + len(flat), self.known + len(count)
        self.ids = self._room(self.ids, end)
        self.start, self.count = self._room(self.start, last), self._room(self.count, last)
        self.ids[self.used : end] = flat
        self.start[self.known : last] = self.used + np.cumsum(count) - count
        self.count[self.known : last] = count
        self.used, self.known = end, last

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[at].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.start[at] - (ends - count), count) + np.arange(total)].astype(np.uint32), count


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.grouped = Tokenizer.from_file(path)
        self.grouped.encode_special_tokens = True
        self.grouped.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(_BETWEEN, "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.between = self.tokenizer.encode(_BETWEEN, add_special_tokens=False).ids[0]
        self.pretokens = regex.compile(public_tokenizers.PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.piece_of, self.pieces = _Numbered(), _Lists()
        self.odd = np.zeros(1 << 14, bool)  # pieces with white space at an end, or empty
        self.word_of, self.words = _Numbered(), _Lists()

    def _learn_words(self) -> None:
        new, self.word_of.new = self.word_of.new, []
        count, flat = np.zeros(len(new), np.int64), []
        odd = [i for i, w in enumerate(new) if _BETWEEN in w]
        if odd:  # such words go to the library one by one
            for i in range(len(new)):
                got = np.array(self.tokenizer.encode(new[i], add_special_tokens=False).ids, np.uint32)
                count[i] = len(got)
                flat.append(got)
        else:
            groups = [_BETWEEN.join(new[i : i + _GROUP]) for i in range(0, len(new), _GROUP)]
            at = 0
            for e in self.grouped.encode_batch_fast(groups, add_special_tokens=False):
                got = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(got == self.between)
                n = np.diff(np.concatenate([[-1], cut, [len(got)]])) - 1
                count[at : at + len(n)] = n
                at += len(n)
                flat.append(np.delete(got, cut))
        self.words.add(np.concatenate(flat) if flat else np.zeros(0, np.uint32), count)

    def _learn(self) -> None:
        new, self.piece_of.new = self.piece_of.new, []
        words, number, split = [], [], self.pretokens
        first = self.pieces.known
        self.odd = _Lists._room(self.odd, first + len(new))
        self.odd[first : first + len(new)] = [not p or p[-1].isspace() or (p[0].isspace() and p[0] != _FIRST) for p in new]
        if len(self.word_of) > MOST_WORDS:
            self.word_of, self.words = _Numbered(), _Lists()
        for p in new:
            if p.isalpha():  # all letters: one pre-token
                words.append(" " + p)
                number.append(1)
            else:
                got = split(p[1:] if p[:1] == _FIRST else " " + p)
                words += got
                number.append(len(got))
        at = self.word_of.of(words)
        if self.word_of.new:
            self._learn_words()
        flat, count = self.words.take(at)
        total = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(number)
        self.pieces.add(flat, total[ends] - total[ends - np.array(number)])

    def _numbers(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The number of every piece, new ones learned, and the bounds of the texts."""
        found = []
        bounds = np.zeros(len(parts) + 1, np.int64)
        for i, p in enumerate(parts):
            if p and p[0]:
                found.append(_FIRST + p[0])
            found += p[1:]  # without a first piece the text begins with the space of the second
            bounds[i + 1] = len(found)
        at = self.piece_of.of(found)
        if self.piece_of.new:
            self._learn()
        return at, bounds

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts as uint32 (no end id) and offsets by text; null counts as empty."""
        if len(self.piece_of) > MOST_PIECES:
            self.clear()
        parts = [t.split(" ") if t else [] for t in texts]
        at, bounds = self._numbers(parts)
        if self.odd[at].any():
            for i in np.unique(np.searchsorted(bounds, np.flatnonzero(self.odd[at]), side="right") - 1):
                parts[i] = _CUT.split(texts[i])
            at, bounds = self._numbers(parts)
        ids, count = self.pieces.take(at)
        ends = np.concatenate([[0], np.cumsum(count)])
        return ids, ends[bounds]


def encoder(path: str) -> Encoder:
    if path not in _made:
        _made[path] = Encoder(path)
    return _made[path]


def with_end(ids: np.ndarray, off: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id behind every text."""
    docs = len(off) - 1
    out_off = off + np.arange(docs + 1)
    out = np.full(out_off[-1], end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[out_off[1:] - 1] = False
    out[keep] = ids
    return out, out_off
