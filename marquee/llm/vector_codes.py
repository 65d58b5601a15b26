"""Operator 12: product codes of vectors by Lloyd's method with heaps.

A vector is cut into equal consecutive parts; each part position has a codebook
of integer entries, trained by rounds of nearest-entry assignment and floored
means. All arithmetic is exact.

The assignment is Heap Lloyd. When a part is scanned, its slack is the distance
to the second nearest entry (a lower bound for all others) minus that to its own
(an upper bound). It goes into a heap of its entry, keyed by the slack plus the
drift that the entry has had so far. A round adds to an entry's drift how far it
moved and how far any other moved; only parts whose key the drift has reached
can have changed, and they are at the head of the heap. They are popped,
scanned exactly against all entries, and pushed again. No other part is looked
at.

The heaps are partition-local: vectors lie in blocks of a written table, one row
a block, with the parts by position and, by position, the members of each
entry's heap in order of their keys (a sorted array is a heap). A round reads
the blocks and writes them anew; a lost executor costs the tasks it ran. The
driver holds codebooks only; sums over members are aggregated in tasks first,
so a third of all rows at one entry is one row a task.

Defined results: vectors that are null, hold a null or non-finite component, or
differ in length from the first valid one are left out; a length that the number
of parts does not divide is cut at floor(p * length / parts); repeated rows are
rows of their own; null ids come last among the seeds; with fewer rows than
entries the codebooks are that much smaller; components beyond 2**28 in size
after scaling count as 2**28; sums of errors beyond a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
BLOCK = 4096  # vectors in a row of the block table
MOST = 1 << 28
_EXACT = 1 << 20  # components up to which doubles hold all sums exactly
_NEAR = 1e-6  # bounds closer than this, relative to the drift, are scanned

Books = list[np.ndarray]


def valid(vector: Column) -> Column:
    """Whether a vector is there with all of its components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x.astype(np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact: by products of doubles where they hold every sum, else by differences."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= _EXACT and x.shape[1] <= 1024:
        a, b = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in book], axis=1)


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lowest of equals), and the slack: distance to the second nearest minus that to it."""
    d = squares(x, book)
    own = d.argmin(1)
    rows = np.arange(len(x))
    best = np.sqrt(d[rows, own].astype(np.float64))
    if len(book) == 1:
        return own, np.full(len(x), np.inf)
    d[rows, own] = np.iinfo(np.int64).max
    return own, np.sqrt(d.min(1).astype(np.float64)) - best


class Heaps:
    """The heaps of one part position in one block: members and keys by entry, each entry's in order of keys."""

    def __init__(self, entry: np.ndarray, key: np.ndarray, entries: int):
        self.members = np.lexsort((key, entry)).astype(np.int32)
        self.keys = key[self.members]
        self.ends = np.searchsorted(entry[self.members], np.arange(entries + 1)).astype(np.int32)

    def entry(self) -> np.ndarray:
        """The entry of each member of the block."""
        out = np.empty(len(self.members), np.int64)
        out[self.members] = np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))
        return out

    def advance(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> Heaps:
        """Pops the members whose keys the drift has reached, scans them, and pushes them where they belong now."""
        heads = [self.keys[a:b].searchsorted(t, "right") for a, b, t in zip(self.ends[:-1], self.ends[1:], drift + _NEAR * (1 + drift), strict=True)]
        if not any(heads):
            return self
        popped = np.concatenate([self.members[a : a + n] for a, n in zip(self.ends[:-1], heads, strict=True)])
        entry, key = self.entry(), np.empty(len(self.members))
        key[self.members] = self.keys
        entry[popped], slack = scan(x[popped], book)
        key[popped] = slack + drift[entry[popped]]
        return Heaps(entry, key, len(book))


def _cuts(length: int, parts: int) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def _small(x: np.ndarray) -> np.ndarray:
    """In the smallest type of integers that holds all."""
    return next(y for t in (np.int8, np.int16, np.int32, np.int64) if ((y := x.astype(t)) == x).all())


class _Block:
    """A row of the block table: ids, labels, and by part position the integers and the heaps."""

    def __init__(self, ids: pa.Array, labels: pa.Array, x: np.ndarray, heaps: list[Heaps]):
        self.ids, self.labels, self.x, self.heaps = ids, labels, x, heaps

    def row(self) -> pa.RecordBatch:
        held = _small(self.x)
        blob = lambda xs: pa.array([b"".join(np.ascontiguousarray(v).tobytes() for v in xs)], pa.binary())
        listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
        h = self.heaps
        return pa.record_batch({"ids": listed(self.ids), "labels": listed(self.labels), "width": pa.array([held.itemsize], pa.int32()), "parts": blob([held]), "members": blob(x.members for x in h), "keys": blob(x.keys for x in h), "ends": blob(x.ends for x in h)})

    @staticmethod
    def all(batch: pa.RecordBatch, n_parts: int, entries: int) -> Iterator[_Block]:
        for i in range(len(batch)):
            one = {c: batch.column(c)[i] for c in batch.schema.names}
            raw = {c: one[c].as_buffer() for c in ("parts", "members", "keys", "ends")}
            ids = one["ids"].values
            x = np.frombuffer(raw["parts"], f"i{one['width'].as_py()}").reshape(len(ids), -1).astype(np.int64)
            heaps = []
            split = zip(*(np.frombuffer(raw[c], t).reshape(n_parts, -1) for c, t in (("members", np.int32), ("keys", np.float64), ("ends", np.int32))), strict=True)
            for members, keys, ends in split:
                h = Heaps.__new__(Heaps)
                h.members, h.keys, h.ends = members, keys, ends
                heaps.append(h)
            yield _Block(ids, one["labels"].values, x, heaps)


def _first(rows: DataFrame, books: Books, cuts: list[int], schema: str) -> DataFrame:
    """Blocks with every part scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                x = integers(some.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(len(some), cuts[-1])
                heaps = [Heaps(*scan(x[:, a:b], book), len(book)) for a, b, book in zip(cuts[:-1], cuts[1:], books, strict=True)]
                yield _Block(some.column("id"), some.column("label"), x, heaps).row()

    return rows.mapInArrow(run, schema)


def _again(blocks: DataFrame, books: Books, cuts: list[int], drift: np.ndarray) -> DataFrame:
    """Blocks after a move of the entries: heaps popped as far as the drift reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _Block.all(batch, len(books), len(books[0])):
                block.heaps = [h.advance(block.x[:, a:b], book, d) for h, a, b, book, d in zip(block.heaps, cuts[:-1], cuts[1:], books, drift, strict=True)]
                yield block.row()

    return blocks.mapInArrow(run, blocks.schema)


def _means(blocks: DataFrame, books: Books, cuts: list[int]) -> Books:
    """Floored means of the members of each entry; an entry without members stays."""
    entries, length = len(books[0]), cuts[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((entries, length), np.int64), np.zeros((entries, len(books)), np.int64)
        for batch in batches:
            for block in _Block.all(batch, len(books), entries):
                for p, (h, a, b) in enumerate(zip(block.heaps, cuts[:-1], cuts[1:], strict=True)):
                    count[:, p] += np.diff(h.ends)
                    np.add.at(total[:, a:b], h.entry(), block.x[:, a:b])
        cell = np.flatnonzero(both := np.concatenate([count, total], axis=1).ravel())
        yield pa.record_batch({"cell": pa.array(cell), "n": pa.array(both[cell])})

    out = np.zeros(entries * (len(books) + length), np.int64)
    for cell, n in blocks.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # as many as the codebooks have numbers, and their counts
        out[cell] = n
    out = out.reshape(entries, -1)
    count, total = out[:, : len(books)], out[:, len(books) :]
    return [np.where(count[:, p : p + 1] > 0, total[:, a:b] // np.maximum(count[:, p : p + 1], 1), book) for p, (a, b, book) in enumerate(zip(cuts[:-1], cuts[1:], books, strict=True))]


def _moved(old: Books, new: Books) -> np.ndarray:
    """What a round adds to the drift of each entry of each position: its own move and the largest of the others."""
    out = []
    for a, b in zip(old, new, strict=True):
        step = np.sqrt(((a - b).astype(np.float64) ** 2).sum(1))
        top = np.argsort(step)[::-1]
        others = np.full(len(step), step[top[0]])
        others[top[0]] = step[top[1]] if len(step) > 1 else 0.0
        out.append(step + others)
    return np.array(out)


def digest_of(books: Books) -> str:
    """SHA-256 of all entries' integers by position, entry and place."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books]:
    """(id, label, code binary, error) of each kept row, and the codebooks; at most 256 entries, a byte each."""
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    named = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v")).where(valid(F.col("v")))
    kinds = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    order = [F.col("id").asc_nulls_last(), F.size("v"), F.col("v")]
    first = named.orderBy(*order).limit(1).select(F.size("v")).collect()
    length = first[0][0] if first else 0
    named = named.where(F.size("v") == length)
    seeds = named.orderBy(*order).limit(entries).select("v").collect()
    cuts = _cuts(length, parts)
    x = integers(np.array([r[0] for r in seeds], np.float64).reshape(len(seeds), length))
    books = [x[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    final = f"id {kinds['id']}, label {kinds['label']}, code binary, error long"
    if not seeds:
        return rows.sparkSession.createDataFrame([], final), books
    schema = f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, width int, parts binary, members binary, keys binary, ends binary"
    blocks = table(_first(named, books, cuts, schema), "code-blocks")
    drift = np.zeros((parts, len(seeds)))
    for r in range(rounds):
        new = _means(blocks, books, cuts)
        drift, books = drift + _moved(books, new), new
        after = _again(blocks, books, cuts, drift)
        if r + 1 < rounds:
            after = table(after, "code-blocks")
            drop(blocks)
            blocks = after
        else:
            blocks = after

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _Block.all(batch, parts, len(seeds)):
                code = np.stack([h.entry() for h in block.heaps], axis=1)
                error = sum(((block.x[:, a:b] - book[code[:, p]]) ** 2).sum(1) for p, (a, b, book) in enumerate(zip(cuts[:-1], cuts[1:], books, strict=True)))
                raw = code.astype(np.uint8)
                yield pa.record_batch({"id": block.ids, "label": block.labels, "code": pa.array([r.tobytes() for r in raw], pa.binary()), "error": pa.array(error)})

    return table(blocks.mapInArrow(read, final), "vector-codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """The rows with label_error, the errors summed over equal labels; nulls are one label.

    The sums are a written table, so that Spark knows their size: it broadcasts
    them below its threshold, and else shuffles and splits a label that is skewed.
    """
    sums = table(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    sums = sums.withColumnRenamed("label", "_l")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_l"))).drop("_l")
