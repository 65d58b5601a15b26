"""Token ids of whole texts, word by word.

A text is cut where neither tokenizer joins anything: before a run of ASCII
white space that follows a character which is certainly no white space, and
between an ASCII letter and an ASCII mark. Each distinct piece is encoded once
by the tokenizers library and kept in a bounded table; the ids of a text are
those of its pieces in order. Pieces are told apart by two 64-bit hashes.

A text that may hold the string of one of the vocabulary's added tokens, in any
case, is encoded whole by the library, which gives those strings their own ids;
so is a text with two pieces that agree in the first hash only.
"""

from __future__ import annotations

import os
from functools import cache

import numpy as np
from pyarrow import Array, ChunkedArray

from . import bytesnp as B
from .common import buffer, runs, tidy

MOST_KNOWN = 1_500_000
CHUNK = 2 << 20
AT_ONCE = 5_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x7F] = True
_MARK[48:58] = False
_MARK &= ~_LETTER


class Encoder:
    def __init__(self, path: str, glue_space: bool):
        """glue_space: white space belongs to ids (byte-level vocabularies), else it is dropped."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.glue = glue_space
        self._forget()

    def _forget(self) -> None:
        """known: first hashes of pieces in order; their second hashes, where each one's ids begin in ids, and how many they are."""
        self.known, self.second, self.begin, self.size = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of pieces over the buffer; row bounds are cuts."""
        space = B._SPACE[buf]
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        # before a space whose predecessor is a sure non-space
        before = np.zeros(n, bool)
        before[1:] = ~space[:-1]
        high = buf >= 0x80
        unsure = np.zeros(n, bool)  # the last byte of a character that may be white space
        if high.any():
            two = np.flatnonzero(buf == 0xC2)
            unsure[np.minimum(two + 1, n - 1)] = True
            for lead in (0xE1, 0xE2, 0xE3):
                unsure[np.minimum(np.flatnonzero(buf == lead) + 2, n - 1)] = True
            before[1:] &= ~unsure[:-1]
        cut[:-1] = space & before
        cut[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
        cut[off] = True
        at = np.flatnonzero(cut)
        return at[:-1], at[1:]

    def _learn(self, h: np.ndarray, g: np.ndarray, words: list[bytes]) -> None:
        """Encodes pieces that are not known."""
        flat, sizes = [], []
        for i in range(0, len(words), AT_ONCE):
            some = [w.decode() for w in words[i : i + AT_ONCE]]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            flat.append(np.array(e.ids, dtype=np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, dtype=np.int64), minlength=len(some)))
        size = np.concatenate(sizes)
        begin = len(self.ids) + np.r_[0, np.cumsum(size)[:-1]]
        self.ids = np.concatenate([self.ids, *flat])
        known = np.concatenate([self.known, h])
        order = np.argsort(known, kind="stable")
        self.known, self.second = known[order], np.concatenate([self.second, g])[order]
        self.begin, self.size = np.concatenate([self.begin, begin])[order], np.concatenate([self.size, size])[order]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which hashes it has."""
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return at, (self.known[at] == h) if len(self.known) else np.zeros(len(h), bool)

    def _holds_added(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Rows that may hold the string of an added token."""
        low, rows = B.lower_ascii(buf).tobytes(), set()
        for token in self.added:
            at = low.find(token)
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                rows.add(row)
                at = low.find(token, int(off[row + 1]))
        return np.array(sorted(rows), np.int64)

    def encode(self, buf: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, each followed by ``end``; where each row begins (with the end)."""
        start, stop = self._pieces(buf, off)
        full = stop > start
        start, stop = start[full], stop[full]
        rows, whole = len(off) - 1, self._holds_added(buf, off)
        if len(start):
            g = B.hashes(buf, start, stop, 1)
            h, first, inv = np.unique(B.hashes(buf, start, stop), return_index=True, return_inverse=True)
            if len(self.known) > MOST_KNOWN:
                self._forget()
            new = np.flatnonzero(~self._find(h)[1])
            if len(new):
                raw = buf.tobytes()
                self._learn(h[new], g[first[new]], [raw[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist(), strict=True)])
            at = self._find(h)[0]
            size, base, flat = self.size[at], self.begin[at], self.ids
            row = np.searchsorted(off, start, "right") - 1
            many = size[inv]
            whole = np.union1d(whole, row[self.second[at][inv] != g])
        else:
            flat, base, row, many, inv = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        begin = np.r_[0, np.cumsum(np.bincount(row, weights=many, minlength=rows).astype(np.int64) + 1)]
        out = np.full(begin[-1], end, dtype=np.uint32)
        to = np.r_[0, np.cumsum(many)[:-1]][: len(many)] + row  # one end id for each row before
        step = np.arange(many.sum()) - np.repeat(np.r_[0, np.cumsum(many)[:-1]][: len(many)], many)
        out[np.repeat(to, many) + step] = flat[np.repeat(base[inv], many) + step]
        return self._with_whole(buf, off, end, out, begin, whole) if len(whole) else (out, begin)

    def _with_whole(self, buf: np.ndarray, off: np.ndarray, end: int, out: np.ndarray, begin: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the rows in ``whole`` replaced by those of the library for the whole text."""
        parts = [out[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        for r in whole.tolist():
            text = buf[off[r] : off[r + 1]].tobytes().decode()
            parts[r] = np.array([*self.tokenizer.encode(text, add_special_tokens=False).ids, end], np.uint32)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def column(self, col: Array | ChunkedArray, end: int):
        """(first row, ids, begins) of chunks of a text column."""
        buf, off = buffer(col)
        for i, j in runs(off, CHUNK):
            ids, begin = self.encode(buf[off[i] : off[j]], off[i : j + 1] - off[i], end)
            yield i, ids, begin
        tidy()


@cache
def encoder(path: str, glue_space: bool) -> Encoder:
    return Encoder(path, glue_space)
