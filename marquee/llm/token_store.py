"""Operator 10: token ids in files, with Elias-Fano encoded document boundaries.

The file format: ids of documents in ascending id order, concatenated, in
segments. A segment (one row of a Parquet table, which any store that Spark
reads can hold) has the ids little-endian in 2 or 4 bytes each, and the bounds
between its documents as an Elias-Fano code: the low bits of each bound packed,
the high bits as a unary bit vector with the place of every 256th one, so
``select`` returns a bound from about 2 + log2(u / n) bits a document instead
of a table of 64-bit numbers. The document ids, which ascend too, are coded the
same way, as what they exceed the segment's first one by.

A segment ends after ``segment_ids`` ids; a document lies in one segment.
Segments are in order by (partition of a range partitioning by id, number
within it); where a segment begins in the whole stream follows from windows over
the sums of those before it: within a partition, within a thousand partitions,
and over the thousands.

Defined results: null or empty text is its end id alone; a null id comes first;
repeated ids keep all their rows, ordered by a hash of their ids and then by
their place in the input, so that one id may fill many partitions; an empty
table gives empty files; other columns stay out.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, table
from .packing import token_table

SEGMENT_IDS = 1 << 20
SAMPLE = 256
MAGIC = b"MQEF0002"
THOUSAND = 1024
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES = _BITS.sum(axis=1)
_NTH = np.argsort(1 - _BITS, axis=1, kind="stable")  # the place of the nth one of each byte


class EliasFano:
    """A non-decreasing sequence of numbers below ``universe`` + 1."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, u = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << low_bits) - 1)
        bits = ((low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        unary[at] = 1
        return cls(n, u, low_bits, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th number: scan the high bits from the nearest sample, then add the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, rest = int(self.samples[i // SAMPLE]), i % SAMPLE
        while rest:
            word = np.unpackbits(self.high[(at + 1) // 8 : (at + 1) // 8 + 64], bitorder="little")[(at + 1) % 8 :]
            ones = np.flatnonzero(word)
            if len(ones) >= rest:
                at, rest = at + 1 + int(ones[rest - 1]), 0
            else:
                at, rest = at + len(word), rest - len(ones)
        low, from_ = 0, i * self.low_bits
        for b in range(self.low_bits):
            low |= int(self.low[(from_ + b) // 8] >> ((from_ + b) % 8) & 1) << b
        return (at - i) << self.low_bits | low

    def selects(self, i: np.ndarray) -> np.ndarray:
        """Many numbers at once: the byte of each one among the high bits by counts of ones, then the bit in it, then the low bits."""
        i = np.asarray(i, dtype=np.int64)
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError("not in the sequence")
        ones = np.cumsum(_ONES[self.high], dtype=np.int64)
        byte = np.searchsorted(ones, i, side="right")
        inner = i - np.where(byte > 0, ones[np.maximum(byte, 1) - 1], 0)
        high = (8 * byte + _NTH[self.high[byte], inner] - i).astype(np.uint64) if len(i) else np.empty(0, np.uint64)
        low = np.zeros(len(i), np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            low |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return (high << np.uint64(self.low_bits)) | low

    def dump(self) -> bytes:
        return MAGIC + struct.pack("<QQBIII", self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: bytes) -> EliasFano:
        if data[:8] != MAGIC:
            raise ValueError("no Elias-Fano bounds")
        n, u, bits, a, b, c = struct.unpack_from("<QQBIII", data, 8)
        at = 8 + struct.calcsize("<QQBIII")
        part = lambda k, size, kind: np.frombuffer(data, kind, size, k)
        return cls(n, u, bits, part(at, a, np.uint8), part(at + a, b, np.uint8), part(at + a + b, c, np.uint32))


_SEGMENT = "part int, segment int, n_docs long, n_nulls long, n_ids long, width int, first_id long, doc_ids binary, bounds binary, ids binary"


def write(docs: DataFrame, path: str, end: int = 1, glue_space: bool = False, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The written segments of all documents, in the shared folder."""
    tokens = token_table(docs, path, end, glue_space)
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    parts = max(1, -(-total // (8 * segment_ids)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("part"), F.col("at")]
    ordered = tokens.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    ordered = ordered.select("doc_id", "n_tokens", "width", "ids", F.spark_partition_id().alias("part"))

    def segments(batches):
        number, docs_, blobs, held, part, width = 0, [], [], 0, 0, 2

        def flush():
            nonlocal number, docs_, blobs, held
            sizes = np.array([len(b) // width for b in blobs], dtype=np.int64)
            known = np.array([d for d in docs_ if d is not None], dtype=np.int64)
            base = int(known[0]) if len(known) else 0
            row = (part, number, len(blobs), len(docs_) - len(known), int(sizes.sum()), width, base, EliasFano.build((known - base).view(np.uint64)).dump(), EliasFano.build(np.r_[0, np.cumsum(sizes)]).dump(), b"".join(blobs))
            number, docs_, blobs, held = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=schema)

        for batch in batches:
            for doc, n, w, blob, p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "width", "ids", "part")), strict=True):
                part, width = p, w
                docs_.append(doc)
                blobs.append(blob)
                held += n
                if held >= segment_ids:
                    yield flush()
        if blobs:
            yield flush()

    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[x.split()[1]]) for n, x in zip(names, _SEGMENT.split(", "), strict=True)])
    out = table(ordered.mapInArrow(segments, _SEGMENT), "token-store")
    drop(tokens)
    return out


def _offsets(segments: DataFrame) -> DataFrame:
    """(part, segment, base): the ids before each segment. Every window holds a bounded number of rows, but for the last: a row for a thousand partitions."""
    sizes = segments.select("part", "segment", "n_ids", F.floor(F.col("part") / THOUSAND).alias("group"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c, w: F.coalesce(F.sum(c).over(before(w)), F.lit(0))
    inner = sizes.select("part", "segment", past("n_ids", Window.partitionBy("part").orderBy("segment")).alias("a"))
    parts = sizes.groupBy("group", "part").agg(F.sum("n_ids").alias("n"))
    middle = parts.select("group", "part", past("n", Window.partitionBy("group").orderBy("part")).alias("b"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n"))
    outer = groups.select("group", past("n", Window.orderBy("group")).alias("c"))
    return inner.join(middle, "part").join(outer, "group").select("part", "segment", (F.col("a") + F.col("b") + F.col("c")).alias("base"))


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written segments alone."""
    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.uint16 if r["width"] == 2 else np.uint32).astype(np.uint32)
                bounds = EliasFano.load(r["bounds"])
                begin, stop = (bounds.selects(np.arange(r["n_docs"]) + k).astype(np.int64) for k in (0, 1))
                known = EliasFano.load(r["doc_ids"])
                ids_of = np.zeros(r["n_docs"], np.int64)
                ids_of[r["n_nulls"] :] = known.selects(np.arange(known.n)).view(np.int64) + r["first_id"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                yield pa.record_batch({
                    "part": pa.array(np.full(r["n_docs"], r["part"], np.int32)), "segment": pa.array(np.full(r["n_docs"], r["segment"], np.int32)),
                    "doc_id": pa.array(ids_of, mask=np.arange(r["n_docs"]) < r["n_nulls"]), "at": pa.array(begin), "n_tokens": pa.array(stop - begin), "ids_crc32": pa.array(crc, pa.int64()),
                })

    rows = segments.mapInArrow(decode, "part int, segment int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(_offsets(segments), ["part", "segment"]).select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
