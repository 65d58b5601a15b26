"""Operator 3: substring dedup by sliding sentence spans.

A text is cut into sentences (after ``.``, ``!`` or ``?`` with white space, and
after a new line). Every run of ``run`` consecutive sentences is a span, however few
its words, and so are a text of fewer sentences and each sentence of at least
``least_words`` words; the 128-bit hash of its words joins a span with equal
ones anywhere. The first of equal spans (least document id, then place) stays;
sentences covered by any other go. Longer repeated runs consist of such spans.

Spans are aggregated before they are shuffled: a passage in a third of all
documents is one row a task. Going back from the hash to its spans is a plain
join that Spark splits where it is skewed.

Defined results: null or blank text has no sentences and stays as it is (null
as null); rows that repeat in full count as one document; a null id counts as
the largest; a very long text is one row like any other. Other columns stay,
but for those that are called like one of the three new ones (``NEW``), which
the new ones replace. Rows are told apart by 128 bits of a hash.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, table

RUN = 2
LEAST_WORDS = 25
NEW = ("n_sentences", "n_removed", "removed_spans")
_CUT = re.compile(r"(?<=[.!?]\s)|(?<=\n)")


def sentences(text: str) -> list[str]:
    """Pieces that make up the text when put together again."""
    return [p for p in _CUT.split(text) if p]


def spans(text: str, run: int = RUN, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(first piece, last piece, 128-bit hash) of each span."""
    held = [(i, w) for i, p in enumerate(sentences(text)) if (w := p.split())]
    norm = [" ".join(w) for _, w in held]
    wide = min(run, len(held))
    ends = {(k, k + wide) for k in range(len(held) - wide + 1) if wide} | {(k, k + 1) for k, (_, w) in enumerate(held) if len(w) >= least_words}
    return [(held[k][0], held[e - 1][0], xxhash.xxh3_128_intdigest(" ".join(norm[k:e]))) for k, e in sorted(ends)]


def remove_repeats(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text without repeated spans, and n_sentences, n_removed and removed_spans (array of [first, last] sentence)."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in NEW))
    own = [c for c in docs.columns if c != text_col]
    id_, text = (F.col(f"`{c}`") for c in (id_col, text_col))
    row, spans_ = free("row", docs.columns), free("spans", docs.columns)
    key = F.struct(F.xxhash64(id_, text).alias("a"), F.xxhash64(text, id_, F.lit(1)).alias("b"))
    keyed = docs.withColumn(row, key)
    place = keyed.select(F.coalesce(id_.cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.col(f"{row}.a").alias("a"), F.col(f"{row}.b").alias("b"), text.cast("string").alias("text"))

    def find(batches):
        for batch in batches:
            ids, one, two, texts = (batch.column(c).to_pylist() for c in ("id", "a", "b", "text"))
            out: list[list] = [[] for _ in range(7)]
            for i, r, q, t in zip(ids, one, two, texts, strict=True):
                for a, b, h in spans(t or "", run, least_words):
                    for c, v in zip(out, (i, r, q, a, b, h >> 64, h & ((1 << 64) - 1)), strict=True):
                        c.append(v)
                if len(out[0]) >= 50_000:
                    yield _batch(out)
                    out = [[] for _ in range(7)]
            yield _batch(out)

    found = place.mapInArrow(find, "id long, a long, b long, first int, last int, h1 long, h2 long")
    found = found.select("id", F.struct("a", "b").alias("row"), "first", "last", "h1", "h2")
    origin = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "first")).alias("o"), F.max(F.struct("id", "row", "first")).alias("z")).where("o <> z")
    origin = table(origin.select("h1", "h2", "o"), "span-origins")  # so that both sides of the join are plain shuffles, which Spark splits where skewed
    again = found.join(origin, ["h1", "h2"]).where(F.struct("id", "row", "first") != F.col("o"))
    gone = again.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias(spans_))
    joined = keyed.join(gone.withColumnRenamed("row", row), row, "left").drop(row)
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + f", `{text_col}` string, n_sentences int, n_removed int, removed_spans array<array<int>>"

    def rebuild(batches):
        for batch in batches:
            texts, removed = batch.column(text_col).to_pylist(), batch.column(spans_).to_pylist()
            new, n, m, kept = [], [], [], []
            for t, s in zip(texts, removed, strict=True):
                pieces = sentences(t or "")
                s = [[x["first"], x["last"]] for x in s or []]
                drop = np.zeros(len(pieces) + 1, bool)
                for a, b in s:
                    drop[a : b + 1] = True
                solid = [bool(p.strip()) for p in pieces]
                new.append(t if not s else "".join(p for p, d in zip(pieces, drop, strict=False) if not d))
                n.append(sum(solid))
                m.append(sum(1 for x, d in zip(solid, drop, strict=False) if x and d))
                kept.append(s)
            yield pa.record_batch({**{c: batch.column(c) for c in own}, text_col: pa.array(new, pa.string()), "n_sentences": pa.array(n, pa.int32()), "n_removed": pa.array(m, pa.int32()), "removed_spans": pa.array(kept, pa.list_(pa.list_(pa.int32())))})

    return joined.mapInArrow(rebuild, schema)


def _batch(out: list[list]) -> pa.RecordBatch:
    signed = lambda xs: pa.array(np.array(xs, dtype=np.uint64).view(np.int64))
    return pa.record_batch({"id": pa.array(out[0], pa.int64()), "a": pa.array(out[1], pa.int64()), "b": pa.array(out[2], pa.int64()), "first": pa.array(out[3], pa.int32()), "last": pa.array(out[4], pa.int32()), "h1": signed(out[5]), "h2": signed(out[6])})
