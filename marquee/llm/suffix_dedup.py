"""Operator 1: suffix-array removal of long repeats, by a logarithmic family of levels.

Every byte covered by a ``width``-byte string that also starts in a document
with a smaller id goes. All suffixes of all texts together would be fifty times
the input, so the suffix arrays are sparse: of the k-byte strings in each
``width``-byte window the one with the least hash is its anchor, and only
suffixes at anchors are held, as far as the windows of the anchor reach, with
the bytes before them that those windows cover. Equal windows have equal anchors
at equal places, so a match of ``width`` bytes always meets at a suffix that both
texts sampled. Order and equality are those of the bytes.

* Batches come in the order of ids. A batch is dealt to blocks; each block's
  suffix array, without repeats, is cut by ranges of the byte order.
* In each range the blocks' arrays are merged and scanned against every level of
  the family that exists: suffixes that share their first k bytes lie side by
  side; where one of them holds more than one text, their windows are compared
  one by one. Answers go back as one bit a window.
* The batch's merged array becomes a level of its own, a table in buckets of its
  ranges, so that no level is ever shuffled again. A level of like size merges with
  it in the scan, and while the last two levels are of like size, they merge into one.
* The ranges are cut at quantiles of a sample of suffixes. A string of k bytes
  before which or after which the sample shows many different texts (edges of a
  passage that a large share of the documents has) is hot: its windows are held
  as suffixes of their own, dealt by a hash of all their bytes.

A passage in a third of all documents is one entry for each block, and one for
each level. :class:`Family` keeps its levels in a folder and outlives a call:
batches of larger ids can be added at any time.

Defined results: null text is empty; a text shorter than ``width`` stays whole;
rows of the same id count as one document and are never held against each
other; a null id counts as the largest. Empty tables give empty results; other
columns are left out here (join by id).
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import bucketed
from . import bytesnp as B
from .common import binaries, buffer, drop, runs, table, tidy

GRAM = 12
BATCHES = 4
BLOCK_BYTES = 3 << 20
PART_ENTRIES = 250_000
SAMPLES = 32  # sampled suffixes for each range
MOST_BUCKETS = 20_000  # of a level; Spark refuses over 100,000, and a bucket may hold any number of ranges
HOT = 8  # sampled texts around one anchor, a quarter of a range, from which on it is hot
SAMPLED_BYTES = 50_000_000
SAMPLED_SHARE = 0.002
AT_ONCE = 1 << 19  # windows compared at once
_POS = np.uint64(0xFFFFFF)
_PIECE = 8 << 20  # a longer text is cut into pieces that overlap by width - 1
_ZSTD = pa.Codec("zstd", 1)
_NULL_ID = np.iinfo(np.int64).max
_EARLIER = np.iinfo(np.int64).min  # the order of what a level holds


@dataclass(frozen=True)
class Shape:
    """How entries look and where they go.

    An entry is a row of bytes: width from the anchor on, width - k before it
    (backwards), and how many of either count. A window of a hot anchor is an entry
    of its own: the window, nothing before it, and width + 1 as its mark.
    """

    width: int
    k: int
    parts: int
    cuts: tuple[bytes, ...]  # first k bytes where a next range begins
    hot: tuple[bytes, ...]

    @property
    def left(self) -> int:
        return self.width - self.k


def anchors(buf: np.ndarray, off: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each anchor of the texts in one buffer, and its place."""
    none = np.empty(0, np.int64)
    n = len(buf) - width + 1
    if n <= 0:
        return none, none, none
    grams = B.Hasher(buf).grams(k)
    packed = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
    at = (B.window_min_positions(packed, width - k + 1)[:n] & _POS).astype(np.int64)
    valid = np.zeros(len(buf) + 1, np.int32)
    full = np.diff(off) >= width
    np.add.at(valid, off[:-1][full], 1)
    np.add.at(valid, off[1:][full] - width + 1, -1)
    ok = np.cumsum(valid)[:n] > 0
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(at[1:], at[:-1], out=change[1:])
    change[1:] |= ok[1:] != ok[:-1]
    lo = np.flatnonzero(change)
    hi = np.r_[lo[1:], n] - 1
    keep = ok[lo]
    return lo[keep], hi[keep], at[lo[keep]]


def pieces(buf: np.ndarray, off: np.ndarray, width: int):
    """(first row, byte offset in it, buffer, offsets) of chunks; a long text comes in overlapping pieces."""
    for i, j in runs(off):
        if j == i + 1 and off[j] - off[i] > _PIECE:
            for s in range(0, int(off[j] - off[i]) - width + 1, _PIECE):
                e = min(int(off[j] - off[i]), s + _PIECE + width - 1)
                yield i, s, buf[off[i] + s : off[i] + e], np.array([0, e - s])
        else:
            yield i, 0, buf[off[i] : off[j]], off[i : j + 1] - off[i]


def _entries(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, s: Shape) -> np.ndarray:
    """The rows of bytes of suffixes at places of a buffer whose windows start from lo to hi."""
    wide = np.zeros(s.left + len(buf) + s.width, np.uint8)
    wide[s.left : s.left + len(buf)] = buf
    got = np.lib.stride_tricks.sliding_window_view(wide, s.left + s.width)[at]
    out = np.empty((len(at), s.width + s.left + 2), np.uint8)
    out[:, -2], out[:, -1] = hi + s.width - at, at - lo
    out[:, : s.width] = got[:, s.left :]
    out[:, s.width : -2] = got[:, : s.left][:, ::-1]
    out[:, :-2] *= _counted(out, s)
    return out


@cache
def _masks(width: int, left: int) -> np.ndarray:
    """Which bytes count, for every pair of the last two of a row."""
    after, before = np.arange(width) < np.arange(width + 2)[:, None], np.arange(left) < np.arange(left + 1)[:, None]
    return np.concatenate([np.repeat(after, left + 1, axis=0), np.tile(before, (width + 2, 1))], axis=1)


def _counted(rows: np.ndarray, s: Shape) -> np.ndarray:
    """Which bytes of rows count, by their last two."""
    return _masks(s.width, s.left)[rows[:, -2].astype(np.int64) * (s.left + 1) + rows[:, -1]]


def _ordered(rows: np.ndarray) -> np.ndarray:
    """The order of rows by their bytes, ties as they come."""
    first = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(first, kind="stable")
    first = first[order]
    edge = np.flatnonzero(np.r_[True, first[1:] != first[:-1], True])
    size = np.diff(edge)
    tied = np.flatnonzero(np.repeat(size > 1, size))
    if len(tied):
        some = order[tied]
        order[tied] = some[np.argsort(np.ascontiguousarray(rows[some]).view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    return order


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.empty(0, np.int64)


def covered(rows: np.ndarray, order: np.ndarray, s: Shape, copies: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in order of their bytes: a mask of windows that a row of smaller ``order`` has (bit: bytes before the anchor), where runs of equal rows begin, and the least order of each run; copies: only of windows that an equal row has."""
    if not len(rows):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    begin = _starts(rows)
    run = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(rows)]))
    least = np.minimum.reduceat(order, begin)
    distinct = rows[begin]
    first, last = np.maximum(s.width - distinct[:, -2].astype(np.int64), 0), distinct[:, -1].astype(np.int64)
    one = np.uint64(1)
    full = ((one << (last + 1).astype(np.uint64)) - one) & ~((one << first.astype(np.uint64)) - one)
    some = np.zeros(len(begin), np.uint64)
    if copies:
        return np.where(order > least[run], full[run], np.uint64(0)), begin, least
    gram = np.flatnonzero(np.r_[True, (distinct[1:, : s.k] != distinct[:-1, : s.k]).any(axis=1), True])
    many = np.diff(gram)
    at = gram[:-1]
    apart = (many > 1) & (np.minimum.reduceat(least, at) < np.maximum.reduceat(least, at))  # where all are of one order, as in a level, none covers another
    which = np.flatnonzero(np.repeat(apart, many))  # runs around whose anchor there are other texts
    if len(which):
        of = np.repeat(np.arange(len(many)), many)[which]
        windows = np.cumsum(last[which] - first[which] + 9)  # and what a row takes by itself
        groups, at = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]), 0
        while at < len(groups) - 1:  # whole groups, about AT_ONCE windows together
            done = windows[groups[at] - 1] if groups[at] else 0
            to = max(at + 1, int(np.searchsorted(windows[groups[1:] - 1], done + AT_ONCE, "right")))
            part = which[groups[at] : groups[to]]
            some[part] = _windows(distinct[part], least[part], first[part], last[part], s)
            at = to
    return np.where(order > least[run], full[run], some[run]), begin, least


def _windows(rows: np.ndarray, order: np.ndarray, first: np.ndarray, last: np.ndarray, s: Shape) -> np.ndarray:
    """Masks of the windows of distinct rows that a row of smaller order has too."""
    after, before = B.prefixes(rows[:, : s.width]), B.prefixes(rows[:, s.width : -2])
    count = last - first + 1
    row = np.repeat(np.arange(len(rows)), count)
    o = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
    key = B.mix(after[row, s.width - o] + B.mix(before[row, o] + o.astype(np.uint64)))
    by = np.argsort(key, kind="stable")
    key, r, w = key[by], row[by], o[by]
    same = (key[1:] == key[:-1]) & (w[1:] == w[:-1])
    near = np.flatnonzero(same)  # equal hashes: compare the bytes
    for i in range(0, len(near), 1 << 16):
        n = near[i : i + (1 << 16)]
        a, b, x = rows[r[n]], rows[r[n + 1]], w[n][:, None]
        differ = a != b
        same[n] = ~((differ[:, : s.width] & (np.arange(s.width) < s.width - x)).any(axis=1) | (differ[:, s.width : -2] & (np.arange(s.left) < x)).any(axis=1))
    begin = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(order[r], begin)
    hit = np.repeat(least, np.diff(np.r_[begin, len(r)])) < order[r]
    bits = np.zeros(len(row), np.uint64)
    bits[by] = hit.astype(np.uint64) << w.astype(np.uint64)
    return np.bitwise_or.reduceat(bits, np.r_[0, np.cumsum(count)[:-1]])


def packed(rows: np.ndarray, s: Shape) -> bytes:
    """Rows of bytes compressed: how many of either side count, then those that do."""
    raw = np.ascontiguousarray(rows[:, -2:].T).tobytes() + np.compress(_counted(rows, s).ravel(), np.ascontiguousarray(rows[:, :-2]).ravel()).tobytes()
    return len(rows).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def unpacked(blob: bytes, s: Shape) -> np.ndarray:
    n, size = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    raw = np.frombuffer(_ZSTD.decompress(blob[16:], size), np.uint8)
    rows = np.zeros((n, s.width + s.left + 2), np.uint8)
    rows[:, -2:] = raw[: 2 * n].reshape(2, n).T
    rows[:, :-2][_counted(rows, s)] = raw[2 * n :]
    return rows


def _numbers(x: np.ndarray) -> bytes:
    return _ZSTD.compress(np.ascontiguousarray(x).tobytes(), asbytes=True)


def _numbered(blob: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(blob, 8 * n), kind)


class Block:
    """The documents of a block and their suffix array."""

    def __init__(self, t: pa.Table, s: Shape):
        self.s, self.block = s, t["block"][0].as_py() if len(t) else 0
        self.ids = t["doc_id"].combine_chunks() if len(t) else pa.array([], pa.int64())
        key = self.ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False) if len(t) else np.empty(0, np.int64)
        self.buf, self.off = buffer(t["text"])
        rows, at, ids = [np.empty((0, s.width + s.left + 2), np.uint8)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        hot = np.array(s.hot, f"S{s.k}")
        for row, skip, buf, off in pieces(self.buf, self.off, s.width):
            lo, hi, place = anchors(buf, off, s.width, s.k)
            got = _entries(buf, lo, hi, place, s)
            if len(hot):
                is_hot = _among(got, hot, s.k)
                if is_hot.any():
                    count = (hi - lo + 1)[is_hot]
                    each = np.repeat(lo[is_hot] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                    alone = _entries(buf, each, each, each, s)
                    alone[:, -2] = s.width + 1
                    got, place = np.concatenate([got[~is_hot], alone]), np.concatenate([place[~is_hot], each])
            rows.append(got)
            at.append(place + (self.off[row] + skip))
            ids.append(key[np.searchsorted(off, place, "right") - 1 + row])
        rows = np.concatenate(rows)
        order = _ordered(rows)
        self.rows, self.at, self.order = rows[order], np.concatenate(at)[order], np.concatenate(ids)[order]

    def dealt(self, distinct: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(range, places in distinct) of every range that gets some, in order of bytes."""
        part = _parts(distinct, self.s)
        by = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1], True]) if len(part) else np.zeros(1, np.int64)
        return [(int(part[by[a]]), by[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _among(rows: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    gram = np.ascontiguousarray(rows[:, :k]).view(f"S{k}").ravel()
    at = np.minimum(np.searchsorted(some, gram), len(some) - 1)
    return some[at] == gram


def _parts(rows: np.ndarray, s: Shape) -> np.ndarray:
    """The range of each row: by its first k bytes, or for windows of hot anchors by a hash of all bytes."""
    gram = np.ascontiguousarray(rows[:, : s.k]).view(f"S{s.k}").ravel()
    part = np.searchsorted(np.array(s.cuts, f"S{s.k}"), gram, "right").astype(np.int64) if s.cuts else np.zeros(len(rows), np.int64)
    if s.hot:
        alone = np.flatnonzero(rows[:, -2] > s.width)
        part[alone] = s.parts + (B.prefixes(rows[alone, : s.width])[:, -1] % np.uint64(s.parts)).astype(np.int64)
    return part


_MESSAGE = "part int, block int, n int, ids binary, rows binary"
_SCANNED = "part int, kind int, block int, n int, blob binary"  # kind 0: masks for a block; kind 1: the level's array


def _building(s: Shape):
    def build(_key: tuple, t: pa.Table) -> pa.Table:
        b = Block(t, s)
        begin = _starts(b.rows)
        distinct = b.rows[begin]
        least = np.minimum.reduceat(b.order, begin) if len(begin) else b.order
        out = [(p, b.block, len(i), _numbers(least[i]), packed(distinct[i], s)) for p, i in b.dealt(distinct)]
        tidy()
        return _table(out, _MESSAGE)

    return build


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, cols, strict=True)})


def _scanning(s: Shape, own: bool, grow: bool = True, merge: bool = False):
    """Merge scan of a batch against one level; own: also against itself; grow: and with the array that becomes its level; merge: of which the level scanned becomes a part."""

    def scan(_key: tuple, t: pa.Table, level: pa.Table) -> pa.Table:
        if not len(t):
            return level.cast(_table([], _SCANNED).schema) if merge else _table([], _SCANNED)
        part, blocks = t["part"][0].as_py(), t["block"].to_pylist()
        held = [unpacked(b, s) for b in level["blob"].to_pylist()]
        size = sum(len(h) for h in held)
        rows = np.concatenate([*held, *(unpacked(b, s) for b in t["rows"].to_pylist())])
        count = t["n"].to_pylist()
        order = np.concatenate([np.full(size, _EARLIER)] + [_numbered(i, n, np.int64) if own else np.zeros(n, np.int64) for i, n in zip(t["ids"].to_pylist(), count, strict=True)])
        by = _ordered(rows)
        rows = rows[by]
        mask, begin, least = covered(rows, order[by], s)
        back = np.empty(len(rows), np.uint64)
        back[by] = mask
        edge = size + np.r_[0, np.cumsum(count)]
        out = [(part, 0, k, n, _numbers(back[a:b])) for k, n, a, b in zip(blocks, count, edge[:-1], edge[1:], strict=True) if back[a:b].any()]
        if own and grow and (new := rows[begin if merge else begin[least != _EARLIER]]).size:
            out.append((part, 1, 0, len(new), packed(new, s)))
        tidy()
        return _table(out, _SCANNED)

    return scan


def _merging(s: Shape):
    def merge(_key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        got = [x for t in (a, b) for x in t.to_pylist()]
        rows = np.concatenate([unpacked(x["blob"], s) for x in got])
        rows = rows[_ordered(rows)]
        rows = rows[_starts(rows)]
        return _table([(got[0]["part"], 1, 0, len(rows), packed(rows, s))], _SCANNED)

    return merge


_FINISHED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finishing(s: Shape, with_text: bool):
    def finish(_key: tuple, t: pa.Table, said: pa.Table) -> pa.Table:
        b = Block(t, s)
        mask, begin, least = covered(b.rows, b.order, s, copies=True)  # distinct rows were held against each other, this block's too, where they were merged
        dealt = dict(b.dealt(b.rows[begin]))
        told = np.zeros(len(begin), np.uint64)
        for part, n, blob in zip(said["part"].to_pylist(), said["n"].to_pylist(), said["blob"].to_pylist(), strict=True):
            told[dealt[part]] |= _numbered(blob, n, np.uint64)
        run = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(b.rows)]))
        mask = mask | np.where(b.order == least[run], told[run], np.uint64(0)) if len(run) else mask
        some = np.flatnonzero(mask)
        mark = np.zeros(len(b.buf) + 1, np.int32)
        for o in range(s.left + 1):
            at = b.at[some[(mask[some] >> np.uint64(o)) & np.uint64(1) == 1]] - o
            np.add.at(mark, at, 1)
            np.add.at(mark, at + s.width, -1)
        gone = np.cumsum(mark)[: len(b.buf)] > 0
        before = np.r_[0, np.cumsum(gone)]
        removed = before[b.off[1:]] - before[b.off[:-1]]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = b.off[:-1][np.diff(b.off) > 0]
        begins[inner] = gone[inner]  # a run ends with its document
        spans = np.r_[0, np.cumsum(begins)]
        out = {"doc_id": b.ids, "n_bytes": pa.array(np.diff(b.off)), "n_removed": pa.array(removed), "n_spans": pa.array(spans[b.off[1:]] - spans[b.off[:-1]])}
        if with_text:
            text = _whole_characters(b.buf, b.off, gone)
            changed = np.flatnonzero(removed).tolist()
            sha = {i: hashlib.sha256(b.buf[b.off[i] : b.off[i + 1]]).hexdigest() for i in changed}
            out |= {"kept_text": pa.array([text[i].as_py() if i in sha else None for i in range(len(removed))], pa.string()), "text_sha256": pa.array([sha.get(i) for i in range(len(removed))], pa.string())}
        else:
            out["kept"] = binaries(b.buf[~gone], b.off - before[b.off])
        tidy()
        return pa.table(out)

    return finish


def _whole_characters(buf: np.ndarray, off: np.ndarray, drop_: np.ndarray) -> pa.Array:
    """The characters of which no byte is dropped."""
    if not len(buf):
        return pa.array([""] * (len(off) - 1), pa.string())
    char = np.cumsum((buf & 0xC0) != 0x80) - 1
    cut = np.zeros(char[-1] + 1, bool)
    cut[char[drop_]] = True
    keep = ~cut[char]
    return binaries(buf[keep], np.r_[0, np.cumsum(keep)][off]).cast(pa.string())


def shape_of(docs: DataFrame, total: int, width: int = 50, k: int = GRAM, part_entries: int = PART_ENTRIES) -> Shape:
    """Ranges for ``total`` bytes of texts like docs (doc_id, text), cut at quantiles of sampled suffixes, and the hot anchors."""
    parts = max(1, -(-2 * total // (part_entries * (width - k + 2))))
    whole = Shape(width, k, parts, (), ())
    if parts == 1:
        return whole
    share = min(1.0, SAMPLED_SHARE + SAMPLED_BYTES / total)
    every = max(1, int(share * total * 2 / (width - k + 2) / (parts * SAMPLES)))

    def draw(batches):
        for batch in batches:
            buf, off = buffer(batch.column("text"))
            for _, _, b, o in pieces(buf, off, width):
                lo, hi, at = anchors(b, o, width, k)
                rows = _entries(b, lo, hi, at, whole)
                h = B.mix(B.prefixes(rows[:, :-2])[:, -1] + rows[:, -1].astype(np.uint64))
                some = h % np.uint64(every) == 0  # the same texts everywhere
                gram = [x.tobytes() for x in rows[some, :k]]
                yield pa.record_batch({"gram": pa.array(gram, pa.binary()), "h": pa.array(h[some].view(np.int64))})
            tidy()

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < share * (1 << 20)).select("text").mapInArrow(draw, "gram binary, h long").distinct()
    seen = drawn.groupBy("gram").count().toArrow()  # about SAMPLES rows a range
    grams = np.array(seen["gram"].to_pylist(), f"S{k}")
    count = seen["count"].to_numpy()
    hot = np.sort(grams[count >= HOT])
    rest = np.sort(np.repeat(grams[count < HOT], count[count < HOT]))
    cuts = np.unique(rest[np.arange(1, parts) * len(rest) // parts]) if len(rest) else rest
    padded = lambda xs: tuple(x.ljust(k, b"\0") for x in xs.tolist())
    return Shape(width, k, parts, padded(cuts), padded(hot))


class Family:
    """Levels of suffix arrays. In a folder (``at``) they outlive the session; else they go with :meth:`close`."""

    def __init__(self, spark: SparkSession, shape: Shape, at: str | None = None):
        self.spark, self.shape, self.at = spark, shape, at.rstrip("/") if at else None
        self.buckets = min(MOST_BUCKETS, shape.parts * (2 if shape.hot else 1))  # a bucket may hold several ranges
        self.levels: list[tuple[int, DataFrame]] = []  # (entries, table), the oldest first
        self.gone: list[DataFrame] = []
        self.number = 0

    @classmethod
    def open(cls, spark: SparkSession, at: str) -> Family:
        """The family as the last finished :meth:`add` left it."""
        said = [json.loads(r[0]) for r in spark.read.parquet(f"{at.rstrip('/')}/state").collect()]  # one row a batch
        last = max(said, key=lambda x: x["number"])
        out = cls(spark, Shape(last["width"], last["k"], last["parts"], *(tuple(map(bytes.fromhex, last[n])) for n in ("cuts", "hot"))), at)
        out.number, out.levels = last["number"], [(n, bucketed(spark, p, _SCANNED, out.buckets, "part")) for n, p in last["levels"]]
        return out

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        at = f"{self.at}/{name}-{self.number:06d}" if self.at else None
        return table(df, f"suffix-{name}", self.buckets, "part", at, compression="none")

    def add(self, texts: DataFrame, last: bool = False, size: int = 0) -> DataFrame:
        """Masks for the blocks of a written batch texts(doc_id, text, block), whose ids exceed those of all batches before; last: nothing follows, so the batch becomes no level; size: the bytes of texts, where a level that is like them in size by that merges with them as it is scanned."""
        s = self.shape
        said = texts.groupBy("block").applyInArrow(_building(s), _MESSAGE).groupBy("part")
        none = self.spark.createDataFrame([], _SCANNED)
        levels = [t.where("kind = 1") for _, t in self.levels] or [none]
        at_once = not last and bool(self.levels) and self.levels[-1][0] * (s.width - s.k + 2) < 3 * size
        scanned = said.cogroup(levels[-1].groupBy("part")).applyInArrow(_scanning(s, True, not last, at_once), _SCANNED)
        for older in levels[:-1]:
            scanned = scanned.unionByName(said.cogroup(older.groupBy("part")).applyInArrow(_scanning(s, False), _SCANNED))
        got = self._write(scanned, "level")
        if at_once:
            self.gone.append(self.levels.pop()[1])
        self.levels.append((got.where("kind = 1").agg(F.sum("n")).first()[0] or 0, got))
        if not last:
            self._merge()
        if self.at:
            x = {"number": self.number, "width": s.width, "k": s.k, "parts": s.parts, "cuts": [c.hex() for c in s.cuts], "hot": [h.hex() for h in s.hot], "levels": [[n, t._written_at] for n, t in self.levels]}
            self.spark.createDataFrame([(json.dumps(x),)], "state string").coalesce(1).write.mode("append").parquet(f"{self.at}/state")
        return got.where("kind = 0")

    def _merge(self) -> None:
        """While the last two levels are of like size, they become one. The answers in the newest table stay until its batch is finished."""
        while len(self.levels) > 1 and self.levels[-2][0] < 2 * self.levels[-1][0]:
            (_, a), (_, b) = self.levels[-2:]
            pair = a.where("kind = 1").groupBy("part").cogroup(b.where("kind = 1").groupBy("part"))
            one = self._write(pair.applyInArrow(_merging(self.shape), _SCANNED), "merged")
            self.levels[-2:] = [(one.agg(F.sum("n")).first()[0] or 0, one)]
            self.gone += [a, b]

    def settle(self) -> None:
        """Deletes the tables that merged levels have replaced, after the batch's answers were read."""
        drop(*self.gone)
        self.gone = []

    def close(self) -> None:
        self.settle()
        drop(*(t for _, t in self.levels))
        self.levels = []


def removed_in_batch(family: Family, docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = False, last: bool = False, size: int | None = None) -> DataFrame:
    """Adds docs(doc_id, text), of ``size`` bytes, whose ids exceed all before, to the family; the results of its rows, written."""
    if size is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = table(docs.select("doc_id", "text", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block")), "suffix-texts")
    said = family.add(texts, last, size)
    schema = _FINISHED.replace(", kept binary", ", kept_text string, text_sha256 string") if with_text else _FINISHED
    out = table(texts.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(_finishing(family.shape, with_text), schema), "suffix-results")
    drop(texts)
    family.settle()
    return out


def remove_repeats(docs: DataFrame, width: int = 50, k: int = GRAM, block_bytes: int = BLOCK_BYTES, part_entries: int = PART_ENTRIES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): what is left of each text; see the module.

    with_text: instead of kept, and where something was removed, kept_text (without what is left of cut
    characters) and text_sha256 of the whole text (hexadecimal): rows of equal id and text have equal
    results, so the two name a result.

    The rows come in ``batches`` quantiles of their ids. ``block_bytes`` of text and ``part_entries``
    suffixes of a range bound a task's memory.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    quantiles = F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 10_000)
    total, ids = docs.agg(F.sum(F.octet_length("text")), quantiles).first()
    cuts = sorted(set(ids or []))[: batches - 1]
    family = Family(docs.sparkSession, shape_of(docs, total or 0, width, k, part_entries))
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") <= cuts[i], i).otherwise(batch)
    sizes = {r[0]: r[1] or 0 for r in docs.groupBy(batch.alias("b")).agg(F.sum(F.octet_length("text"))).collect()}  # a row a batch
    ends, out = [None, *cuts, None], []
    for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        above = F.lit(True) if a is None else (F.col("doc_id") > a) | F.col("doc_id").isNull() if z is None else F.col("doc_id") > a
        mine = docs.where(above if z is None else above & (F.col("doc_id") <= z))
        out.append(removed_in_batch(family, mine, block_bytes, with_text, i == len(cuts), sizes.get(i, 0)))
    family.close()
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
