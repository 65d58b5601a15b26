"""Operator 11: ranked lexical search over dual-sorted wavelet trees.

Documents are dealt to shards by the tasks that read them, without a shuffle. A
shard numbers its documents by ascending id and holds one sequence of document
numbers: the postings of all its terms, each term's by descending impact. The
sequence is a wavelet tree (levelwise, as a wavelet matrix): a node stands for a
range of documents, and a term's postings in it are again a contiguous run in
order of impact, found by two rank queries. So the lists are sorted both ways:
the head of a run is the term's best impact among the documents of the node,
and going down navigates by document.

A query starts at the root with the runs of its terms. The weighted impacts of
the heads add up to a bound that no document below exceeds; the open nodes of
the best bounds are expanded first, some hundred of all queries at a time, each
node's runs being intersected with its halves. At a leaf the bound is the score.
A node goes when its bound is below the k-th best score known, which a task
carries from shard to shard. The answer is exact.

Three passes: texts to postings (a row a shard, written), counts of documents
by term and in all (summed up before their shuffle), and postings to the index,
as impacts need the counts of all documents. The index is a written table;
:func:`search` reads it once for each block of queries. A block is collected
and sent to the tasks; it has at most ``MOST_ASKED`` terms, and more queries
make more blocks. Each task returns at most k rows a query and shard, of which
Spark's rank limit leaves k a task before the shuffle.

Terms are told apart by 64 bits of a hash. Defined results: null texts and those
without a term match nothing and do not count; each document row is a document
of its own, also where ids repeat; null ids rank behind equal scores; rows of
queries that repeat in full count once, and the terms of different texts of one
query id add up; a query without a known term has no rows; other columns of
either table are not looked at.
"""

from __future__ import annotations

import contextlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytesnp as B
from .common import buffer, drop, runs, table, tidy

TOP = 20
#: A shard is one large row. Parquet's writer looks at sizes every hundred rows only, and a reader decodes a whole row group at once; so each row is looked at, and a group ends behind a shard or two.
ROW_GROUPS = {"parquet.block.size": str(1 << 23), "parquet.enable.dictionary": "false"} | {f"parquet.{x}.size.row.check.{y}": "1" for x in ("block", "page") for y in ("min", "max")}
SHARD_POSTINGS, SHARD_DOCS = 1 << 19, 1 << 15  # a shard is one row, which Spark and Python hold several times over: some 5 MB
MOST_ASKED = 1 << 20
AT_ONCE, FINE = 256, 3  # nodes of a query expanded at a time; levels above the leaves that are not put back among the open nodes

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct term of each row, in that order."""
    solid = _TERM[buf]
    edge = np.ones(len(buf) + 1, bool)
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[off] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = solid[start] if len(start) else np.empty(0, bool)
    start, end = start[keep], end[keep]
    known, inv = np.unique(B.hashes(B.lower_ascii(buf), start, end), return_inverse=True)
    row = np.searchsorted(off, start, "right") - 1
    both, count = np.unique(row * max(len(known), 1) + inv, return_counts=True)
    return both // max(len(known), 1), known[both % max(len(known), 1)], count


class _Batchwise:
    """Postings of documents, collected to shards."""

    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_docs = self.n_postings = 0

    def add(self, ids: pa.Array, buf: np.ndarray, off: np.ndarray) -> None:
        row, term, count = terms(buf, off)
        self.ids.append(ids)
        self.parts.append((row + self.n_docs, term, count))
        self.n_docs += len(ids)
        self.n_postings += len(row)

    def full(self) -> bool:
        return self.n_postings >= SHARD_POSTINGS or self.n_docs >= SHARD_DOCS

    def row(self) -> pa.RecordBatch:
        """Documents by ascending id (null last); postings by term and document."""
        ids = pa.concat_arrays(self.ids)
        doc, term, count = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        size = np.bincount(place[doc], weights=count, minlength=len(order)).astype(np.int64)
        known, slot = np.unique(term, return_inverse=True)
        by = np.lexsort((place[doc], slot))
        ends = np.searchsorted(slot[by], np.arange(len(known) + 1))
        blob = lambda x, t: pa.array([np.ascontiguousarray(x, dtype=t).tobytes()], pa.binary())
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.take(pa.array(order)))
        return pa.record_batch({"ids": listed, "sizes": blob(size, np.int64), "terms": blob(known, np.uint64), "ends": blob(ends, np.int64), "docs": blob(place[doc][by], np.uint32), "counts": blob(count[by], np.uint32)})


@contextlib.contextmanager
def _one_by_one(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile hands rows to Python one at a time: a shard is a row, and a batch of them is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@dataclass
class Index:
    """shards: a row a shard; frequencies: (term, df); both written tables. n_docs documents have a term, n_terms are all their terms."""

    shards: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def _nd(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: str | None = None) -> Index:
    """The index of all documents; with ``at`` its shards lie there and stay."""
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = named.schema["id"].dataType.simpleString()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = _Batchwise()
        for batch in batches:
            buf, off = buffer(batch.column("text"))
            for i, j in runs(off):
                open_.add(batch.column("id").slice(i, j - i), buf[off[i] : off[j]], off[i : j + 1] - off[i])
                if open_.full():
                    made, open_ = open_.row(), _Batchwise()
                    tidy()
                    yield made
        if open_.n_docs:
            yield open_.row()
            tidy()

    raw = table(named.mapInArrow(collect, f"ids array<{kind}>, sizes binary, terms binary, ends binary, docs binary, counts binary"), "postings", **ROW_GROUPS)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for known, ends in zip(batch.column("terms"), batch.column("ends"), strict=True):
                yield pa.record_batch({"term": pa.array(_nd(known, np.int64)), "df": pa.array(np.diff(_nd(ends, np.int64)))})

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes in batch.column("sizes"):
                n = _nd(sizes, np.int64)
                yield pa.record_batch({"docs": pa.array([int((n > 0).sum())]), "terms": pa.array([int(n.sum())])})

    with _one_by_one(docs.sparkSession):
        df = table(raw.select("terms", "ends").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "frequencies")
        n_docs, n_terms = (x or 0 for x in raw.select("sizes").mapInArrow(totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first())

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                sizes, known, ends, doc, tf = (_nd(batch.column(c)[i], t) for c, t in (("sizes", np.int64), ("terms", np.uint64), ("ends", np.int64), ("docs", np.uint32), ("counts", np.uint32)))
                norm = np.array([75 + 25 * n * n_docs // n_terms if n else 0 for n in sizes.tolist()], np.int64)
                tf = tf.astype(np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * norm[doc])
                term = np.repeat(np.arange(len(known)), np.diff(ends))
                by = np.lexsort((doc, -impact, term))
                levels = max(1, int(len(sizes) - 1).bit_length())
                seq, bits = doc[by], []
                for k in range(levels):
                    bit = (seq >> np.uint32(levels - 1 - k)) & np.uint32(1)
                    bits.append(np.packbits(bit.astype(bool)).tobytes())
                    seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
                blob = lambda x: pa.array([x], pa.binary())
                made = pa.record_batch({"ids": batch.column("ids").slice(i, 1), "n_docs": pa.array([len(sizes)], pa.int32()), "terms": blob(known.tobytes()), "ends": blob(ends.tobytes()), "bits": blob(b"".join(bits)), "impacts": blob(impact[by].astype(np.uint32).tobytes())})
                del sizes, known, ends, doc, tf, norm, impact, term, by, seq, bits, bit
                tidy()
                yield made

    with _one_by_one(docs.sparkSession):
        shards = table(raw.mapInArrow(turn, f"ids array<{kind}>, n_docs int, terms binary, ends binary, bits binary, impacts binary"), "wavelet-shards", at=at, **ROW_GROUPS)
    drop(raw)
    return Index(shards, df, n_docs, n_terms)


class Shard:
    """A shard in memory: its wavelet tree level by level, with ranks and the impacts in the order of each level."""

    def __init__(self, n_docs: int, known: np.ndarray, ends: np.ndarray, bits: np.ndarray, impacts: np.ndarray):
        self.terms, self.ends, n = known, ends, len(impacts)
        self.levels = max(1, int(n_docs - 1).bit_length())
        self.n_docs, self.width = n_docs, n + 1
        packed = bits.reshape(self.levels, -1)
        self.rank = np.zeros((self.levels, n + 1), np.int32)  # zeros before each place
        self.impacts = np.zeros((self.levels + 1, n + 1), np.int32)
        self.impacts[0, :n] = impacts
        for k in range(self.levels):
            bit = np.unpackbits(packed[k], count=n).astype(bool)
            np.cumsum(~bit, out=self.rank[k, 1:])
            self.impacts[k + 1, :n] = np.concatenate([self.impacts[k, :n][~bit], self.impacts[k, :n][bit]])
        self.zeros = self.rank[:, -1].astype(np.int64)
        self._rank, self._impacts = self.rank.ravel(), self.impacts.ravel()

    def halves(self, level: np.ndarray, path: np.ndarray, node: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """The halves of nodes (level, path) with runs [start, end) of terms: (parent, path, bound) of each half that holds a posting, and its runs by (half, start, end, weight)."""
        at = level[node] * self.width
        a, b = self._rank[at + start].astype(np.int64), self._rank[at + end].astype(np.int64)
        zeros = self.zeros[level[node]]
        half = np.concatenate([2 * node, 2 * node + 1])
        lo, hi = np.concatenate([a, zeros + start - a]), np.concatenate([b, zeros + end - b])
        w, below = np.concatenate([weight, weight]), np.concatenate([at, at]) + self.width
        held = hi > lo
        half, lo, hi, w, below = half[held], lo[held], hi[held], w[held], below[held]
        bound = np.zeros(2 * len(level), np.int64)
        np.add.at(bound, half, w * self._impacts[below + lo])
        order = np.argsort(half, kind="stable")
        some = np.flatnonzero(bound)
        new = np.zeros(2 * len(level), np.int64)
        new[some] = np.arange(len(some))
        half, lo, hi, w = half[order], lo[order], hi[order], w[order]
        return some >> 1, 2 * path[some >> 1] + (some & 1), bound[some], new[half], lo, hi, w


def _best(shard: Shard, slots: np.ndarray, weights: np.ndarray, k: int, least: int) -> list[tuple[int, int]]:
    """(score, document number) of at least the k best documents with a score above 0 and not below ``least``."""
    start, end = shard.ends[slots], shard.ends[slots + 1]
    top: list[int] = []  # a heap of the k best scores
    found: list[tuple[int, int]] = []
    bound = int((weights * shard._impacts[start]).sum())
    open_: list[tuple] = [(-bound, 0, 0, start, end, weights)]  # by best bound, then by documents of lower ids
    last = shard.levels - FINE

    while open_ and -open_[0][0] >= least:
        some = [heapq.heappop(open_) for _ in range(min(AT_ONCE, len(open_)))]
        level, path = (np.array([x[i] for x in some], np.int64) for i in (1, 2))
        node = np.repeat(np.arange(len(some)), [len(x[3]) for x in some])
        s, e, w = (np.concatenate([x[i] for x in some]) for i in (3, 4, 5))
        while len(level):
            parent, path, bounds, node, s, e, w = shard.halves(level, path, node, s, e, w)
            level = level[parent] + 1
            leaf = level == shard.levels
            for score, doc in zip(bounds[leaf].tolist(), path[leaf].tolist(), strict=True):
                if score >= least:
                    found.append((score, doc))
                    if len(top) < k:
                        heapq.heappush(top, score)
                    else:
                        heapq.heappushpop(top, score)
                    if len(top) == k:
                        least = max(least, top[0])
            good = (bounds >= least) & ~leaf
            fine = good & (level >= last)
            cut = np.searchsorted(node, np.arange(len(level) + 1))
            for i in np.flatnonzero(good & ~fine).tolist():
                a, b = cut[i], cut[i + 1]
                heapq.heappush(open_, (-int(bounds[i]), int(level[i]), int(path[i]), s[a:b], e[a:b], w[a:b]))
            keep = fine[node]
            new = np.cumsum(fine) - 1
            level, path = level[fine], path[fine]
            node, s, e, w = new[node[keep]], s[keep], e[keep], w[keep]
    return [x for x in found if x[0] >= least]


def weights(items: DataFrame, index: Index, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, weight) of the terms of each query that the index knows and that weigh anything; repeats add up."""
    named = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).distinct()
    kind = named.schema["item"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = buffer(batch.column("text"))
            for i, j in runs(off):
                row, term, n = terms(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                yield pa.record_batch({"item": batch.column("item").take(pa.array(row + i)), "term": pa.array(term.view(np.int64)), "n": pa.array(n)})

    asked = named.mapInArrow(count, f"item {kind}, term long, n long").groupBy("item", "term").agg(F.sum("n").alias("n"))
    w = F.floor(1000 * F.log(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return asked.join(index.frequencies, "term").select("item", "term", (w * F.col("n")).alias("weight")).where("weight > 0")


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score) of each query's k documents of the highest scores above 0; equal scores by ascending id."""
    asked = table(weights(items, index, id_col, text_col), "asked")
    kind = asked.schema["item"].dataType.simpleString()
    doc = index.shards.schema["ids"].dataType.elementType.simpleString()
    schema = f"item_id {kind}, doc_id {doc}, score long"
    blocks = max(1, -(-asked.count() // MOST_ASKED))
    found = [index.shards.mapInArrow(_searcher(asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow(), k), schema) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    with _one_by_one(items.sparkSession):
        best = table(out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"), "found")
    drop(asked)
    return best


def _searcher(asked: pa.Table, k: int):
    """Searches the shards of a task for one block of queries."""
    items = asked["item"].combine_chunks().dictionary_encode()
    names, who = items.dictionary, items.indices.to_numpy(zero_copy_only=False) if not items.null_count else items.indices.fill_null(len(items.dictionary)).to_numpy()
    names = pa.concat_arrays([names, pa.nulls(1, names.type)])
    term, weight = asked["term"].to_numpy().view(np.uint64), asked["weight"].to_numpy()
    order = np.lexsort((term, who))
    who, term, weight = who[order], term[order], weight[order]
    cut = np.searchsorted(who, np.arange(len(names) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[int]] = [[] for _ in range(len(names))]  # of each query, the k best scores of the task's shards so far
        for batch in batches:
            for i in range(len(batch)):
                known, ends, bits, impacts = (_nd(batch.column(c)[i], t) for c, t in (("terms", np.uint64), ("ends", np.int64), ("bits", np.uint8), ("impacts", np.uint32)))
                if not len(known):
                    continue
                shard = Shard(batch.column("n_docs")[i].as_py(), known, ends, bits, impacts)
                slot = np.searchsorted(known, term)
                slot[slot == len(known)] = 0
                has = known[slot] == term
                who_, docs, scores = [], [], []
                for q in range(len(names)):
                    mine = np.arange(cut[q], cut[q + 1])[has[cut[q] : cut[q + 1]]]
                    if not len(mine):
                        continue
                    top = sorted(_best(shard, slot[mine], weight[mine], k, best[q][-1] if len(best[q]) == k else 1), key=lambda x: (-x[0], x[1]))[:k]
                    best[q] = sorted(best[q] + [x[0] for x in top], reverse=True)[:k]
                    who_ += [q] * len(top)
                    scores += [x[0] for x in top]
                    docs += [x[1] for x in top]
                del shard  # the next one is not to be made beside it
                tidy()
                yield pa.record_batch({"item_id": names.take(pa.array(who_, pa.int64())), "doc_id": batch.column("ids")[i].values.take(pa.array(docs, pa.int64())), "score": pa.array(scores, pa.int64())})

    return run
