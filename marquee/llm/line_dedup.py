"""Operator 13: line dedup.

A text is split at line feeds. A line's key is the line without white space at
both ends and with A to Z in lower case; only keys of at least ``least_chars``
code points count. Lines are exploded to 128-bit hashes of their keys, the
documents of each hash are counted, and a key in more than ``most_docs``
documents loses its lines in all of them but the one of the least id, where
every line stays. What is left is put together in its old order.

The exploded lines (an id and a hash each) are a written table, read twice: for
the aggregate, which is summed up before its shuffle, so that a line in a third
of all documents is one row a task, and for the way back, a join that Spark
splits where it is skewed. Texts are scanned to be hashed, and once more to be
rebuilt.

Defined results: a null or empty text is one empty line, and stays as it is;
rows of one id are one document, and null ids are one document, the largest; a
very long text is one row like any other, held by one task. Other columns
stay, but for those called like one of ``NEW``, which the new ones replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, table

LEAST_CHARS = 10
MOST_DOCS = 1
NEW = ("n_lines", "n_dropped")
_WHITE = b" \t\n\v\f\r"
_LAST = (1 << 63) - 1


def digest(line: bytes, least_chars: int) -> bytes | None:
    """128 bits of a line's key, or None where the key is too short to count."""
    key = line.strip(_WHITE).lower()  # of bytes: A to Z only
    if len(key) < least_chars or len(key) < 4 * least_chars and len(key.decode()) < least_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def remove_repeats(docs: DataFrame, least_chars: int = LEAST_CHARS, most_docs: int = MOST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text without repeated lines, and n_lines (before) and n_dropped."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    own = [c for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, flat = [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                found = {d for line in (t.as_buffer().to_pybytes() if t.is_valid else b"").split(b"\n") if (d := digest(line, least_chars))}
                ids += [i] * len(found)
                flat += sorted(found)
            halves = np.frombuffer(b"".join(flat), np.int64).reshape(-1, 2)
            yield pa.record_batch({"id": pa.array(ids, pa.int64()), "h1": pa.array(halves[:, 0]), "h2": pa.array(halves[:, 1])})

    lines = table(docs.select(key.alias("id"), text.cast("string").alias("text")).mapInArrow(explode, "id long, h1 long, h2 long"), "lines")
    if most_docs == 1:  # two different ids are enough, so nothing needs to be counted
        common = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        common = lines.distinct().groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > most_docs)
    common = table(common.select("h1", "h2", "first"), "common-lines")  # so that both sides of the join are plain shuffles, which Spark splits where skewed
    id_, gone = free("id", docs.columns), free("gone", docs.columns)
    lost = lines.join(common, ["h1", "h2"]).where("id > first").groupBy("id").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")).toDF(id_, gone)
    joined = docs.withColumn(id_, key).join(lost, id_, "left").drop(id_)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + f", `{text_col}` string, n_lines long, n_dropped long"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, n, m = [], [], []
            for t, g in zip(batch.column(text_col), batch.column(gone).to_pylist(), strict=True):
                old = (t.as_buffer().to_pybytes() if t.is_valid else b"").split(b"\n")
                away = {np.array([x["h1"], x["h2"]], np.int64).tobytes() for x in g or ()}
                kept = [x for x in old if digest(x, least_chars) not in away] if away else old
                new.append(b"\n".join(kept).decode() if t.is_valid else None)
                n.append(len(old))
                m.append(len(old) - len(kept))
            yield pa.record_batch({**{c: batch.column(c) for c in own}, text_col: pa.array(new, pa.string()), "n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(m, pa.int64())})

    return joined.mapInArrow(rebuild, schema)
