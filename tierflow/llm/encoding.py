"""Whole texts to token ids with a file of the tokenizers library, quickly and exactly.

A text is cut where its tokenizer always starts anew whatever stands before:
at a run of spaces. The distinct pieces of a slice are encoded once and
remembered by hash; ids of texts are put together from those of their pieces.

* byte-level files split by the usual pattern keep one white-space character
  with the word after it, so a piece is that character and the word; what comes
  before in a longer run of spaces is a piece of its own;
* files whose pattern drops white space are cut into the runs between it;
* an ASCII sign after an ASCII letter also starts a piece (the apostrophe, which
  may be part of a contraction, does not).

Texts with other white space than the ASCII one are encoded whole, since the
pattern may join it across a cut. The files' special strings count as ordinary
text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytekernel as K

#: White space beyond ASCII.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Pieces remembered by one worker; then it starts over.
REMEMBERED = 1_500_000
#: Pieces that the tokenizer encodes at once; its results hold far more than the ids.
AT_ONCE = 4096
#: Late comers until they are merged into the large table.
LATE = 150_000

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[ord("A") : ord("Z") + 1] = _ASCII_LETTER[ord("a") : ord("z") + 1] = True
_SIGN = np.zeros(256, bool)
_SIGN[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]] = True

_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def _merged(keys: np.ndarray, numbers: np.ndarray, more: np.ndarray, its: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, numbers = np.concatenate([keys, more]), np.concatenate([numbers, its])
    order = np.argsort(keys)
    return keys[order], numbers[order]


class PieceEncoder:
    """Encodes slices of texts; keeps ids of pieces seen before."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.forget()

    def forget(self) -> None:
        # Sorted piece hashes and the pieces' numbers: a large table, and a small one of late comers.
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.old, self.late = none, none
        self.n = 0
        self.ids = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)

    def number(self, h: np.ndarray) -> np.ndarray:
        """The numbers of pieces by hash (sorted), -1 where not remembered."""
        out = np.full(len(h), -1, np.int64)
        for keys, numbers in (self.old, self.late):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[at] == h
                out[hit] = numbers[at[hit]]
        return out

    @classmethod
    def of(cls, path: str, spaced: bool) -> PieceEncoder:
        """One for each worker process."""
        if (path, spaced) not in _encoders:
            _encoders[path, spaced] = cls(path, spaced)
        return _encoders[path, spaced]

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the pieces, in order."""
        n = len(data)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        space = K.IS_SPACE[data]
        first = np.zeros(n, bool)
        first[off[:-1][off[:-1] < n]] = True
        final = np.zeros(n, bool)
        final[off[1:][off[1:] > 0] - 1] = True
        begins = first.copy()
        begins[1:] |= _SIGN[data[1:]] & _ASCII_LETTER[data[:-1]]
        if self.spaced:
            begins[1:] |= space[1:] & ~space[:-1]
            begins[:-1] |= space[:-1] & ~space[1:] & ~final[:-1]
            start = np.flatnonzero(begins)
            end = np.append(start[1:], n)
        else:
            begins[1:] |= space[:-1]
            start = np.flatnonzero(begins & ~space)
            ends = final
            ends[:-1] |= begins[1:] | space[1:]
            end = np.flatnonzero(ends & ~space) + 1
        return start, end, np.searchsorted(off, start, "right") - 1

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each slice of the column: the ids of its texts, one after another, and how many each text has."""
        wide = pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), WIDE_SPACE), False).to_numpy(zero_copy_only=False)
        for lo, hi in K.slices(column):
            part = pc.fill_null(column.slice(lo, hi - lo), "")
            data, off = K.flat(part)
            ids, count = self._encode(data, off)
            if wide[lo:hi].any():
                ids, count = self._replace(ids, count, part, np.flatnonzero(wide[lo:hi]))
            yield ids, count

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end, text = self.pieces(data, off)
        n_texts = len(off) - 1
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n_texts, np.int64)
        h, first, inverse = np.unique(K.span_hash(data, start, end), return_index=True, return_inverse=True)
        if self.n > REMEMBERED:
            self.forget()
        at = self.number(h)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = data.tobytes()
            spans = list(zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True))
            ids: list[list[int]] = []
            for k in range(0, len(spans), AT_ONCE):
                ids += [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in spans[k : k + AT_ONCE]], add_special_tokens=False)]
            at[new] = self._remember(h[new], ids)
            del ids
        at = at[inverse]
        lo, hi = self.ends[at], self.ends[at + 1]
        size = hi - lo
        total = np.cumsum(size)
        ids = self.ids[np.repeat(lo - total + size, size) + np.arange(total[-1])]
        return ids, np.bincount(text, size, n_texts).astype(np.int64)

    def _remember(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Keep the ids of new pieces; their numbers."""
        size = np.array([len(x) for x in ids], np.int64)
        n, end = self.n, self.ends[self.n]
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        while len(self.ends) < n + len(keys) + 2:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < end + len(flat):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[end : end + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(keys)] = end + np.cumsum(size)
        self.n += len(keys)
        numbers = np.arange(n, n + len(keys), dtype=np.int32)
        self.late = _merged(*self.late, keys, numbers)
        if len(self.late[0]) > LATE:
            self.old = _merged(*self.old, *self.late)
            self.late = keys[:0], numbers[:0]
        return numbers

    def _replace(self, ids: np.ndarray, count: np.ndarray, part: pa.Array, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode some texts whole and put their ids in place."""
        each = np.split(ids, np.cumsum(count)[:-1])
        for i in which.tolist():
            each[i] = np.array(self.tokenizer.encode(part[i].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
