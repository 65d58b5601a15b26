"""Operator 7: benchmark decontamination by rare n-gram seeds and local alignment.

Seeds are the word n-grams of the test items. A first pass over the documents
counts the uses of every seed (aggregated before the shuffle); an item's seed is
left out as too common if it is used more than ``common`` times and four times
as often as the item's median seed, so at least half of an item's seeds remain.
A second pass lists each document's rare seeds, which a join leads to the items;
documents with ``least_seeds`` different seeds of an item are candidates for it.
In a last pass the candidates' texts alone are joined to their items: hits of an
item that lie close together make a passage, which is aligned to the item by
Smith-Waterman over words (+1 match, -1 mismatch or gap). A passage counts if
the score is at least ``least_score`` of the item's words.

Items and seeds are tables of any size; broadcast are membership filters of at
most 32 MB (:mod:`.filters`), which only spare rows that a join would drop.

Words are lower-cased (A-Z) and split at ASCII white space. Defined results:
null texts and items have no words; an item of fewer words than a seed is one
seed of the whole and matches where it occurs in full; equal ids are one
document (or item) whose best passage is returned; of passages with the same
score the first counts; a null id is an id; empty tables give an empty result;
very long texts are scanned whole; other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesnp as B
from . import filters
from .common import buffer, drop, runs, table

SEED_WORDS = 3
COMMON = 64
LEAST_SCORE = 0.5
LEAST_SEEDS = 2
_MATCH = "doc_id long, item_id long, score double, n_words long, start_word long, end_word long"


def _words(texts: list[str | None]) -> list[np.ndarray]:
    buf, off = buffer(pa.array([t or "" for t in texts], pa.string()))
    h, first = _hashed(buf, off)
    return [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _hashed(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = B.lower_ascii(buf)
    start, end, first = B.words(low, off)
    return B.hashes(low, start, end), first


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    acc = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        acc = B.mix(acc * np.uint64(3) + h[k : k + len(acc)])
    return acc


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: score, and first and last + 1 word of the passage that it covers."""
    m = len(passage)
    step = np.arange(m, dtype=np.int64)
    row = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1, dtype=np.int64)
    best = (0, 0, 0)
    for w in item:
        diag = row[:-1] + np.where(passage == w, 1, -1)
        up = row[1:] - 1
        cell = np.maximum(diag, up)
        from_ = np.where(diag >= up, begin[:-1], begin[1:])
        fresh = cell <= 0
        cell[fresh] = 0
        from_[fresh] = step[fresh] + 1
        # gaps along the passage: the best earlier cell, less one a word
        run = np.maximum.accumulate(cell + step)
        at = np.maximum.accumulate(np.where(cell + step == run, step, -1))
        row[1:] = np.maximum(run - step, 0)
        begin[1:] = np.where(row[1:] > 0, from_[at], step + 1)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def _seeds(items: DataFrame, n: int) -> DataFrame:
    """(gram, item_id, place) of every seed."""

    def cut(batches):
        for batch in batches:
            ids, words = batch.column("item_id"), _words(batch.column("text").to_pylist())
            grams = [_grams(w, min(n, len(w))) if len(w) else np.empty(0, np.uint64) for w in words]
            count = [len(g) for g in grams]
            yield pa.record_batch({
                "gram": pa.array(np.concatenate([*grams, np.empty(0, np.uint64)]).view(np.int64)), "item_id": ids.take(pa.array(np.repeat(np.arange(len(words)), count))),
                "place": pa.array(np.concatenate([np.arange(c) for c in count] or [np.empty(0, np.int64)]).astype(np.int32)), "size": pa.array(np.repeat([min(n, len(w)) for w in words], count).astype(np.int32)),
            })

    return items.mapInArrow(cut, "gram long, item_id long, place int, size int")


def _found(text: pa.Array, bits: np.ndarray, sizes: list[int]):
    """(first row, row of each gram, gram) of the n-grams that may be seeds, by runs of rows."""
    buf, off = buffer(text)
    for i, j in runs(off):
        h, first = _hashed(buf[off[i] : off[j]], off[i : j + 1] - off[i])
        row = np.repeat(np.arange(j - i), np.diff(first))
        for n in sizes:
            g = _grams(h, n)
            if len(g):
                inside = row[: len(g)] == row[n - 1 : n - 1 + len(g)]
                inside[inside] = filters.may_have(bits, g[inside].view(np.int64))
                yield i, row[: len(g)][inside], g[inside].view(np.int64)


def _passages(h: np.ndarray, w: np.ndarray, grams: np.ndarray, n: int, least_seeds: int, least_score: float):
    """(score, start, end) of the best passage of the words h that holds seeds of the item w, or None."""
    size = min(n, len(w))
    have = _grams(h, size)
    at = np.flatnonzero(np.isin(have, grams))
    best = None
    for part in np.split(at, np.flatnonzero(np.diff(at) > len(w)) + 1):
        if len(np.unique(have[part])) < min(least_seeds, len(w) - size + 1):
            continue
        lo, hi = max(0, int(part[0]) - 2 * len(w)), min(len(h), int(part[-1]) + 2 * len(w) + n)
        score, s, e = align(w, h[lo:hi])
        if score >= least_score * len(w) and (len(w) >= n or score == len(w)) and (best is None or score > best[0]):
            best = (score, lo + s, lo + e)
    return best


def matches(docs: DataFrame, items: DataFrame, n: int = SEED_WORDS, least_score: float = LEAST_SCORE, least_seeds: int = LEAST_SEEDS, common: int = COMMON, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, n_words (of the item), start_word, end_word of every match, the best for each pair."""
    sc = docs.sparkSession.sparkContext
    doc = F.col(id_col).cast("long")
    texts = docs.select(doc.alias("doc_id"), F.xxhash64(doc).alias("k"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    seeds = table(_seeds(items, n), "item-seeds")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # n sizes at most
    every = sc.broadcast(filters.build(seeds.select("gram")))

    def count(batches):
        for batch in batches:
            got = [g for _, _, g in _found(batch.column("text"), every.value, sizes)]
            g, c = np.unique(np.concatenate([*got, np.empty(0, np.int64)]), return_counts=True)
            yield pa.record_batch({"gram": pa.array(g), "c": pa.array(c)})

    used = texts.select("text").mapInArrow(count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("used"))
    known = seeds.join(used, "gram", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    usual = known.groupBy(F.col("item_id").alias("u")).agg(F.median("used").alias("usual"))
    known = known.join(usual, F.col("item_id").eqNullSafe(F.col("u"))).where((F.col("used") > 0) & (F.col("used") <= F.greatest(F.lit(common), 4 * F.col("usual"))))
    rare = table(known.select("gram", "item_id").distinct(), "item-rare-seeds")
    few = sc.broadcast(filters.build(rare.select("gram")))

    def hits(batches):
        for batch in batches:
            for i, row, g in _found(batch.column("text"), few.value, sizes):
                if len(g):
                    pair = np.unique(np.stack([row, g]), axis=1)
                    yield pa.record_batch({"k": batch.column("k").take(pa.array(pair[0] + i)), "gram": pa.array(pair[1])})

    least = F.least(F.lit(least_seeds), F.lit(1) + F.greatest(F.lit(0), F.col("words") - n))
    lengths = seeds.groupBy(F.col("item_id").alias("u")).agg((F.max("place") + F.max("size")).alias("words"))
    met = texts.select("k", "text").mapInArrow(hits, "k long, gram long").join(rare, "gram").groupBy("k", "item_id").agg(F.collect_set("gram").alias("grams"))
    met = met.join(lengths, F.col("item_id").eqNullSafe(F.col("u"))).where(F.size("grams") >= least).select("k", F.col("item_id").alias("i"), "grams")
    met = met.join(items, F.col("i").eqNullSafe(F.col("item_id"))).groupBy("k").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"), "grams")).alias("items"))
    found = table(met, "item-candidates")
    open_ = sc.broadcast(filters.build(found.select("k")))

    def narrow(batches):
        for batch in batches:
            yield batch.filter(pa.array(filters.may_have(open_.value, batch.column("k").to_numpy())))

    def score(batches):
        for batch in batches:
            rows = []
            for id_, text, items_ in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "items")), strict=True):
                h = _words([text])[0]
                for x, w in zip(items_, _words([x["item"] for x in items_]), strict=True):
                    got = _passages(h, w, np.array(x["grams"], np.int64).view(np.uint64), n, least_seeds, least_score)
                    if got:
                        rows.append((id_, x["item_id"], got[0] / len(w), len(w), got[1], got[2]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.record_batch({c: pa.array(v, t) for c, v, t in zip(("doc_id", "item_id", "score", "n_words", "start_word", "end_word"), cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)})

    out = texts.mapInArrow(narrow, "doc_id long, k long, text string").join(found, "k").mapInArrow(score, _MATCH)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", F.negative("start_word").alias("s"), "end_word", "n_words")).alias("b"))
    best = best.select("doc_id", "item_id", F.col("b.score").alias("score"), F.col("b.n_words").alias("n_words"), F.negative("b.s").alias("start_word"), F.col("b.end_word").alias("end_word"))
    out = table(best, "item-matches")  # some numbers a match
    for b in (every, few, open_):
        b.destroy()
    drop(seeds, rare, found)
    return out
