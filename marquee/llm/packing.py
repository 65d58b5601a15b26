"""Operator 8: concatenate and cut.

The token ids of all documents, each with its end id, form one stream that is
cut into sequences of ``length`` ids; only the last one is padded. The first
pass encodes every partition and writes its ids with the running count within
the partition. The partitions' totals, added up, are the partitions' offsets in
the stream; the second pass cuts each document where the stream crosses a
sequence's bound, so a piece knows its sequence and offset without any shuffle.

Defined results: null or empty text is its end id alone; ties and repeated rows
are documents of their own; an empty table gives an empty result; other columns
stay out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, table
from .tokens import encoder


def token_table(docs: DataFrame, path: str, end: int, glue_space: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part, at (ids before it in its partition), n_tokens and ids (little-endian, 2 or 4 bytes each), written."""

    def encode(batches):
        enc, at = encoder(path, glue_space), 0
        kind = np.uint16 if enc.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        for batch in batches:
            for i, ids, begin in enc.column(batch.column("text"), end):
                rows = len(begin) - 1
                data = ids.astype(kind)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, rows), "part": batch.column("part").slice(i, rows), "at": pa.array(begin[:-1] + at),
                    "n_tokens": pa.array(np.diff(begin)), "width": pa.array(np.full(rows, data.itemsize, np.int32)),
                    "ids": binaries(data.view(np.uint8), begin * data.itemsize),
                })
                at += int(begin[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    return table(rows.mapInArrow(encode, "doc_id long, part int, at long, n_tokens long, width int, ids binary"), "tokens")


def pack(docs: DataFrame, path: str, length: int = 1024, end: int = 0, glue_space: bool = True, with_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and their ids as array<int>)."""
    tokens = token_table(docs, path, end, glue_space)
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n")).toArrow()
    part, n = (totals[c].to_numpy() for c in ("part", "n"))
    sums = np.zeros(int(part.max()) + 2 if len(part) else 1, np.int64)
    sums[part + 1] = n
    shared = tokens.sparkSession.sparkContext.broadcast(np.cumsum(sums))  # eight bytes for each partition of the input: 6 MB at 100 TB

    def cut(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            cols = (batch.column(c).to_pylist() for c in ("doc_id", "part", "at", "n_tokens", "width", "ids"))
            for doc, part, at, n, width, blob in zip(*cols, strict=True):
                ids = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32).astype(np.uint32)
                begin, done = int(shared.value[part]) + at, 0
                while done < n:
                    seq, off = divmod(begin + done, length)
                    k = min(n - done, length - off)
                    piece = ids[done : done + k]
                    for c, v in zip(out, (doc, done, k, zlib.crc32(piece.tobytes()), n, seq, off, piece if with_ids else None), strict=True):
                        c.append(v)
                    done += k
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            data = {k: pa.array(v, pa.int64()) for k, v in zip(names, out, strict=False)}
            if with_ids:
                data["ids"] = pa.array(out[7], pa.list_(pa.int32()))
            yield pa.record_batch(data)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return tokens.mapInArrow(cut, schema)


def sequences(pieces: DataFrame, length: int = 1024, pad: int = 0) -> DataFrame:
    """sequence_id, ids, n_padding: the pieces (with ids) of each sequence put together; a group is one sequence."""
    got = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return got.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), F.lit(length) - F.size(ids))).alias("ids"), (F.lit(length) - F.size(ids)).alias("n_padding"))
