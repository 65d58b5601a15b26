"""Operator 2: n-gram Jaccard join with token-combination prefixes, and its classes.

A document is the set of its word shingles. Two link if their Jaccard
similarity is at least ``percent`` / 100; a class is what links connect.

* Documents of equal sets collapse to one node first.
* Shingles that often recur within a few megabytes of text are the frequent
  class: about the ``most_frequent`` most counted, which bounds what is broadcast
  (any class gives the same links).
* A set of n shingles differs from any partner in at most
  d = floor(n * (100 - percent) / percent) shingles, both ways together. The
  space of hashes is cut into m ranges, m the power of two from 1.18 d on, and the
  shingles of one range are a combination: up to 1 / 1.18 of n / d on average, and
  d differences spoil at most d of them. Ordered by any rule, the d + 1 first combinations of
  either set then hold one that both have. This is the extended prefix; the rule
  is: not all of frequent shingles, then the larger ones, then by hash. What two
  unlike texts share by chance or as a passage is seldom a whole combination,
  so the keys of several nodes stay in proportion to what is alike, where single
  shingles would be shared by ever more texts.
* Sets so near the next power of two that a partner has it take its ranges too.
  A set with d ranges or fewer (a small one) also has its d + 1 first shingles by
  hash as single keys: if neither of two partners has more than d, they share
  one of these.
* Keys that one node alone has go, and those of the same nodes are kept once.
* Each node goes to its most common key, its home. A home is compared, by exact
  intersections, in blocks of ``block`` nodes: each within itself and with the
  first one. That joins what is alike in a time that grows with the home; where
  classes remain apart, all nodes outside the home's largest class are compared
  with each other and with that class.
* Other keys that still hold nodes of several classes are open. Nodes that open
  keys connect are a family; a family of one block meets once. Of larger ones the
  keys are compared like homes, in rounds: each node names the most common of its
  open keys, and the nodes of every named key visit it. A key whose nodes have all
  met at one visited place is done, so nodes that share many keys meet a few times,
  not once a key. The last round takes all keys that are still open.

Hot keys are aggregated before they are shuffled, hot groups are cut into
blocks, only links that join two classes leave a task, and no pair is ever a
row. Every step is a written table that goes when it has been read. Tables of
ids and keys of few rows (see ``few``) are joined and grouped in one task, as
dealing them out takes longer; texts, keys of texts and sets are always dealt out.

Defined results: null or empty text has no shingles and is its own class; fewer
words than a shingle make one shingle of the whole; rows of one id are one
node of the graph, each compared by its own text (each row returned); null ids
are left out of the links and get a null class. Shingles are told apart by 64
bits of a hash, and by 56 of them where two sets are compared (seven bytes a
shingle are shuffled). Other columns stay out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import bytesnp as B
from . import filters
from .common import binaries, buffer, collected, drop, few, runs, small, table, tidy

MOST_FREQUENT = 200_000
COUNT_BYTES = 4 << 20
LEAST_COUNT = 4
BLOCK = 1_024
SPARE = 118  # percent of the most differences that are taken as ranges, so that more than these are filled
ROUNDS = 4  # in which nodes visit the most common of their open keys
_S1, _S2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def shingles(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (with repeats) of lower-cased texts, and the row of each."""
    buf = B.lower_ascii(buf)
    start, end, first = B.words(buf, off)
    count = np.diff(first)
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = B.hashes(buf, start, end)
    acc = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        acc = B.mix(acc * np.uint64(3) + h[k : k + len(acc)])
    row = np.repeat(np.arange(len(count)), count)
    ok = row[: len(acc)] == row[words - 1 : words - 1 + len(acc)] if len(acc) else np.empty(0, bool)
    out, rows = [acc[ok]], [row[: len(acc)][ok]]
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        whole = [int(np.bitwise_xor.reduce(B.mix(h[first[r] : first[r + 1]] + np.arange(1, count[r] + 1, dtype=np.uint64) * _S1))) ^ int(count[r]) for r in short]
        out.append(B.mix(np.array(whole, dtype=np.uint64) ^ _S2))
        rows.append(short)
    return np.concatenate(out), np.concatenate(rows)


def sets(buf: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in order, one after another; where each row begins."""
    h, row = shingles(buf, off, words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        keep = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
        h, row = h[keep], row[keep]
    return h, np.searchsorted(row, np.arange(len(off)))


def _first_of(row: np.ndarray, order: tuple[np.ndarray, ...], most: np.ndarray) -> np.ndarray:
    """Places of the first most[row] entries of each row in an order (last key first, as for lexsort)."""
    at = np.lexsort((*order, row))
    r = row[at]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return at[rank < most[r]]


def _combinations(h: np.ndarray, row: np.ndarray, often: np.ndarray, ranges: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and rows of the first combinations of each row, and how many ranges each row fills; h is in order within rows."""
    m = ranges[row].astype(np.uint64)
    part = ((h >> np.uint64(32)) * m) >> np.uint64(32)
    edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])])
    size = np.diff(np.r_[edge, len(h)])
    key = B.mix(np.add.reduceat(B.mix(h ^ _S1), edge) + B.mix(part[edge] * _S2 + m[edge]))
    plain = np.minimum.reduceat(often, edge)  # 1: all of them frequent
    r = row[edge]
    some = _first_of(r, (key, -np.minimum(size, 8), plain), most)
    return key[some], r[some], np.bincount(r, minlength=len(ranges))


def keys(h: np.ndarray, begin: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The index keys of sets (as of sets()) one after another, and where each set's begin; see the module."""
    n = np.diff(begin)
    row = np.repeat(np.arange(len(n)), n)
    if not len(h):
        return np.empty(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    often = np.zeros(len(h), np.int8)
    if len(frequent):
        at = np.searchsorted(frequent, h)
        at[at == len(frequent)] = 0
        often = (frequent[at] == h).astype(np.int8)
    most = n * (100 - percent) // percent + 1
    ranges = np.ones(len(n), np.int64)
    while (low := 100 * percent * ranges < SPARE * (100 - percent) * n).any():
        ranges[low] *= 2
    one, rows_one, filled = _combinations(h, row, often, ranges, most)
    near = (SPARE * (100 - percent) * n >= percent * percent * ranges) & (n > 0)  # a partner may be of the next power
    found, rows_ = [one], [rows_one]
    for which, double in ((near, 2), (filled < most, 0)):
        inside = which[row]
        if not inside.any():
            continue
        if double:
            k, r, _ = _combinations(h[inside], row[inside], often[inside], ranges * double, most)
        else:
            some = _first_of(row[inside], (h[inside],), most)
            k, r = B.mix(h[inside][some] ^ _S2), row[inside][some]
        found.append(k)
        rows_.append(r)
    k, r = np.concatenate(found), np.concatenate(rows_)
    at = np.lexsort((k, r))
    k, r = k[at], r[at]
    keep = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    return k[keep], np.searchsorted(r[keep], np.arange(len(n) + 1))


def _links(docs: list[int], comp: list[int], hist: list[tuple], sets_: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join classes, between documents of side 0 (or both) and 1, never compared before."""
    names: dict = {}
    parent = [names.setdefault(c, i) for i, c in enumerate(comp)]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets_])
    if not len(size) or not size.sum():
        return []
    _, token = np.unique(np.concatenate(sets_), return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)
    by = np.argsort(token, kind="stable")
    post, begin = owner[by], np.r_[0, np.cumsum(np.bincount(token))]
    first = np.r_[0, np.cumsum(size)]
    past = np.array(hist, dtype=np.int64).reshape(len(docs), -1)
    root = np.array([find(i) for i in range(len(docs))])
    out: list[tuple[int, int]] = []
    for x in range(len(docs)):
        if side[x] == 1:
            continue
        may = root != root[x]
        may[: x + 1] &= side[: x + 1] == 1
        if side[x] == 0:
            may &= side == 1
        for k in range(past.shape[1]):
            may &= past[:, k] != past[x, k]
        may &= (100 * size >= percent * size[x]) & (percent * size <= 100 * size[x])
        if not may.any():
            continue
        mine = token[first[x] : first[x + 1]]
        lens = begin[mine + 1] - begin[mine]
        at = np.repeat(begin[mine] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
        common = np.bincount(post[at], minlength=len(docs))
        for y in np.flatnonzero(may & (100 * common >= percent * (size + size[x] - common))):
            a, b = find(x), find(int(y))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((docs[x], docs[int(y)]))
                root = np.where(root == root[b if a < b else a], root[a if a < b else b], root)
    return out


def classes(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK, most_frequent: int = MOST_FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the class) of every row; see the module."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = _signed(docs, words, percent, most_frequent)
    known = signed.where("n > 0 and doc_id is not null")
    nodes = known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))  # equal sets have equal keys
    nodes = table(nodes.withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")
    alive = _shared(nodes)
    light = few(nodes).select("node", "rep", "h1", "h2", "n")
    who = small(alive.select("node").distinct().join(light.select("node", "rep", "h1"), "node"), "jaccard-open-nodes")
    verify = _Verifier(docs, who, words, percent)

    size = alive.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    best = alive.join(size, "key").groupBy("node").agg(F.max(F.struct("c", "key")).getField("key").alias("key"))
    place = small(best.join(best.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key"), "jaccard-homes")
    state = _labelled(place, [verify(_first_blocks(place, block), place)])
    wide = state.where(F.col("c") > block)
    links = _compared(wide.select("node", F.col("home").alias("key"), "comp"), verify, block, [])
    visited, sets_ = [small(place.select("node", "key"), "jaccard-visited")], None
    for how in ["families"] + ["rounds"] * ROUNDS + ["all"]:
        state, links = _labelled(place, links, state), []
        seen = small(alive.join(state.drop("c"), "node"), "jaccard-seen")
        open_ = _open(seen, visited)
        if open_.isEmpty():
            drop(seen, open_)
            break
        if sets_ is None:  # later rounds know no other nodes: what is open stays open or closes
            inside = small(seen.join(open_, "key").select("node", "key"), "jaccard-inside")
            drop(alive)
            alive = inside
            sets_ = verify.sets_of(alive)
        inside = seen.join(open_, "key")
        if how == "families":
            rows = _families(inside, block)
        else:
            keys_ = open_ if how == "all" else inside.groupBy("node").agg(F.max(F.struct("n", "key")).getField("key").alias("key"))
            rows = seen.join(keys_.select("key").distinct(), "key")
        rows = small(rows.select("node", "key", "comp", "home"), "jaccard-visits")
        visited.append(rows)
        drop(seen, open_)
        links = _compared(rows, verify, block, ["home"], sets_)
    state = _labelled(place, links, state)
    drop(alive, place, who, *visited, *([sets_] if sets_ is not None else []))

    known = few(signed).select("doc_id", "n", "h1", "h2").where("n > 0 and doc_id is not null")
    ids = known.groupBy("doc_id").agg(F.min(F.struct("h1", "h2", "n")).alias("a"), F.max(F.struct("h1", "h2", "n")).alias("z")).where("a <> z").select("doc_id")
    again = known.join(ids, "doc_id").join(light.select("h1", "h2", "n", "node"), ["h1", "h2", "n"])
    again = small(again.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("b")).select("a", F.explode("b").alias("b")), "jaccard-links")  # different texts of one id
    labels = few(connected_components(few(_named(state), again)))
    drop(again, state)
    joined = light.join(labels, "node", "left")
    least = joined.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    named = joined.join(least, "component", "left").select("h1", "h2", "n", F.coalesce("least", "rep").alias("component_id"))
    linked = known.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = few(signed).where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = small(linked.unionByName(alone), "jaccard-classes")  # three numbers a document
    drop(signed, nodes)
    return out


def _named(state: DataFrame) -> DataFrame:
    """The classes of _labelled() as links."""
    return state.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))


def _labelled(place: DataFrame, links: list[DataFrame], before: DataFrame | None = None) -> DataFrame:
    """node, home, c and comp (the class so far) of every node of place, written; of the links and the classes before, which go."""
    old = [] if before is None else [before]
    labels = few(connected_components(few(*map(_named, old), *links)))
    state = place.select("node", F.col("key").alias("home"), "c").join(labels.select("node", F.col("component").alias("comp")), "node", "left")
    state = small(state.withColumn("comp", F.coalesce("comp", "node")), "jaccard-state")
    drop(*links, *old)
    return state


def _families(inside: DataFrame, block: int) -> DataFrame:
    """Rows of open keys with their family for the key: nodes that open keys connect, where they are at most ``block``."""
    first = inside.groupBy("key").agg(F.min("node").alias("a"))
    both = small(inside.join(first, "key").select("a", F.col("node").alias("b")), "jaccard-families")
    of = few(connected_components(both))
    drop(both)
    within = of.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= block).select("component")
    of = of.join(within, "component").select("node", (-1 - F.col("component")).alias("family"))
    return inside.select("node", "comp", "home").distinct().join(of, "node").select("node", F.col("family").alias("key"), "comp", "home")


def _open(seen: DataFrame, visited: list[DataFrame]) -> DataFrame:
    """(key, n nodes) of the keys with nodes of several classes, unless all its nodes have met at one visited key.

    Where all have met, the node of the fewest visits was there too, and so was a
    bit of the place in what the masks of all of them share: those places alone
    are looked up for the other nodes.
    """
    groups = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "n")
    past = small(few(*(v.select("node", F.col("key").alias("at")) for v in visited)).distinct(), "jaccard-past")
    bits = [F.expr(f"shiftleft(1L, cast(pmod(xxhash64(at, {k}), 64) as int))") for k in range(2)]
    masks = past.groupBy("node").agg(F.bit_or(bits[0]).alias("m0"), F.bit_or(bits[1]).alias("m1"), F.count(F.lit(1)).alias("c"))
    held = small(seen.join(groups.select("key"), "key").select("node", "key").join(masks, "node"), "jaccard-held")
    common = held.groupBy("key").agg(F.bit_and("m0").alias("m0"), F.bit_and("m1").alias("m1"), F.min(F.struct("c", "node")).getField("node").alias("node"))
    places = common.where("m0 <> 0 and m1 <> 0").join(past, "node").where((F.col("m0").bitwiseAND(bits[0]) != 0) & (F.col("m1").bitwiseAND(bits[1]) != 0)).select("key", "at")
    places = small(places, "jaccard-places")
    met = held.select("node", "key").join(places, "key").join(past, ["node", "at"]).groupBy("key", "at").agg(F.count(F.lit(1)).alias("m"))
    met = met.groupBy("key").agg(F.max("m").alias("m"))
    out = small(groups.join(met, "key", "left").where("m is null or m < n").select("key", "n"), "jaccard-open")
    drop(past, held, places)
    return out


def _frequent(docs: DataFrame, words: int, most: int) -> np.ndarray:
    """Hashes of the frequent class in order."""

    def count(batches):
        for batch in batches:
            buf, off = buffer(batch.column("text"))
            for i, j in runs(off, COUNT_BYTES):
                found = [shingles(buf[off[a + i] : off[b + i]], off[a + i : b + i + 1] - off[a + i], words)[0] for a, b in runs(off[i : j + 1] - off[i])]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                often = n >= LEAST_COUNT
                yield pa.record_batch({"h": pa.array(h[often].view(np.int64)), "n": pa.array(n[often])})
            del buf, off
            tidy()

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= 10 * LEAST_COUNT)
    counted = small(counted.select("h", F.floor(8 * F.log2("n")).cast("int").alias("grade")), "jaccard-counts")
    grades = sorted(map(tuple, counted.groupBy("grade").count().collect()), reverse=True)  # some hundred rows at most
    held, least = 0, None
    for grade, n in grades:
        held += n
        if held > most:
            break
        least = grade
    out = np.empty(0, np.int64) if least is None else collected(counted.where(F.col("grade") >= least).select("h"))  # at most ``most``
    drop(counted)
    return np.sort(out.astype(np.int64).view(np.uint64))


def _signed(docs: DataFrame, words: int, percent: int, most_frequent: int) -> DataFrame:
    """doc_id, n, two fingerprints of the set, and its keys, of every row."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words, most_frequent))

    def sign(batches):
        for batch in batches:
            buf, off = buffer(batch.column("text"))
            for i, j in runs(off):
                h, begin = sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], words)
                n = np.diff(begin)
                one, two = _fingerprints(h, begin)
                flat, first = keys(h, begin, frequent.value, percent)
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(i, j - i), "n": pa.array(n), "h1": pa.array(one.view(np.int64)), "h2": pa.array(two.view(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(flat.view(np.int64))),
                })
            del buf, off
            tidy()

    out = table(docs.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, keys array<long>"), "jaccard-keys")
    frequent.destroy()
    return out


def _fingerprints(h: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, whatever the order."""
    n = np.diff(begin)
    full, at = n > 0, np.minimum(begin[:-1], max(0, len(h) - 1))
    one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(h):
        one[full] = np.add.reduceat(B.mix(h ^ _S1), at[full])
        two[full] = np.bitwise_xor.reduceat(B.mix(h * _S2), at[full])
    return one, two


def _shared(nodes: DataFrame) -> DataFrame:
    """(node, key) of the keys that several nodes have, those of the same nodes once."""
    counted = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key")
    counted = table(counted, "jaccard-shared-keys")
    bits = nodes.sparkSession.sparkContext.broadcast(filters.build(counted))

    def narrow(batches):
        for batch in batches:
            lists = batch.column("keys")
            k = lists.flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), lists.value_lengths().to_numpy())
            may = filters.may_have(bits.value, k)
            yield pa.record_batch({"node": pa.array(node[may]), "key": pa.array(k[may])})

    held = small(nodes.select("node", "keys").mapInArrow(narrow, "node long, key long").join(counted, "key"), "jaccard-entries")
    bits.destroy()
    groups = held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(xxhash64(node, 1))").alias("x"))
    groups = groups.groupBy("c", "s", "x").agg(F.min("key").alias("key")).select("key")
    alive = small(held.join(groups, "key").select("node", "key"), "jaccard-shared")
    drop(counted, held)
    return alive


# ------------------------------------------------------------ sets of the nodes that are compared


def _packed(h: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Sets of hashes one after another as a binary column, seven bytes a hash (its lowest byte goes)."""
    return binaries(np.ascontiguousarray(h.view(np.uint8).reshape(-1, 8)[:, 1:]).ravel(), 7 * begin)


def _unpacked(blob) -> np.ndarray:
    """The set of a value of _packed(); hashes without their lowest byte."""
    seven = np.frombuffer(blob, np.uint8).reshape(-1, 7)
    eight = np.zeros((len(seven), 8), np.uint8)
    eight[:, :7] = seven
    return eight.view(np.uint64).ravel()


class _Verifier:
    """Compares the sets of nodes in groups; who: node, rep (the document that has its set), h1."""

    def __init__(self, docs: DataFrame, who: DataFrame, words: int, percent: int):
        self.docs, self.who, self.words, self.percent = docs, who, words, percent

    def _sets(self, wanted: DataFrame, bits) -> DataFrame:
        """wanted with the set of each rep and h1: a filter spares the documents that are not wanted, a join follows."""
        words = self.words

        def gather(batches):
            for batch in batches:
                batch = batch.filter(pa.array(filters.may_have(bits.value, batch.column("doc_id").to_numpy())))
                buf, off = buffer(batch.column("text"))
                for i, j in runs(off):
                    h, begin = sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], words)
                    yield pa.record_batch({"rep": batch.column("doc_id").slice(i, j - i), "h1": pa.array(_fingerprints(h, begin)[0].view(np.int64)), "set": _packed(h, begin)})
                del buf, off
                tidy()

        held = self.docs.where("doc_id is not null").mapInArrow(gather, "rep long, h1 long, set binary")
        return held.join(wanted, ["rep", "h1"]).drop("rep", "h1")

    def sets_of(self, nodes: DataFrame) -> DataFrame:
        """(node, set) of nodes that are looked at again and again, written."""
        wanted = small(nodes.select("node").distinct().join(self.who, "node"), "jaccard-wanted")
        bits = self.docs.sparkSession.sparkContext.broadcast(filters.build(wanted.select("rep")))
        out = table(self._sets(wanted, bits), "jaccard-sets", compression="none")
        bits.destroy()
        drop(wanted)
        return out

    def __call__(self, rows: DataFrame, nodes: DataFrame, homes: tuple[str, ...] = (), sets: DataFrame | None = None) -> DataFrame:
        """Links (a, b) within the groups (key, kind, i, j) of rows, which are about nodes, written; sides 0 and 1 are held against each other, side -1 within."""
        percent = self.percent

        def group(_key: tuple, t: pa.Table) -> pa.Table:
            ids, first = np.unique(t["node"].to_numpy(), return_index=True)
            side = t["side"].to_numpy()[first]
            found = []
            if (side < 0).any() or (side == 0).any() and (side == 1).any():
                blobs = t["set"]
                past = [tuple(t[h][int(k)].as_py() for h in homes) for k in first]
                found = _links(ids.tolist(), t["comp"].to_numpy()[first].tolist(), past, [_unpacked(blobs[int(k)].as_buffer()) for k in first], side, percent)
            return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

        links = lambda held: small(held.groupBy("key", "kind", "i", "j").applyInArrow(group, "a long, b long"), "jaccard-links")
        if sets is not None:
            return links(rows.join(sets, "node"))
        wanted = small(nodes.select("node").distinct().join(self.who, "node"), "jaccard-wanted")
        bits = self.docs.sparkSession.sparkContext.broadcast(filters.build(wanted.select("rep")))
        out = links(self._sets(rows.join(wanted, "node"), bits))  # sets are dealt out by document, then by group
        bits.destroy()
        drop(wanted)
        return out


def _block_of(blocks) -> F.Column:
    return F.pmod(F.xxhash64("node", F.lit(5)), blocks).cast("int")


def _spot(kind: int, i, j, side):
    return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _spots(rows: DataFrame, spots, *more: str) -> DataFrame:
    return rows.select("node", "key", "comp", *more, F.explode(spots).alias("s")).select("node", "key", "comp", *more, "s.kind", "s.i", "s.j", "s.side")


def _first_blocks(place: DataFrame, block: int) -> DataFrame:
    """place (node, key, c) in groups: each block within itself, and the first block with each other one; three rows a node."""
    rows = place.where("c > 1").withColumn("comp", F.col("node")).withColumn("_n", F.ceil(F.col("c") / F.lit(block)).cast("int"))
    rows = rows.withColumn("_b", _block_of(F.col("_n")))
    alone = _spot(0, F.col("_b"), F.col("_b"), F.lit(-1))
    others = F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda o: _spot(1, F.lit(0), o, F.lit(0)))
    spots = F.when(F.col("_n") == 1, F.array(alone)).when(F.col("_b") == 0, F.concat(F.array(alone), others)).otherwise(F.array(alone, _spot(1, F.lit(0), F.col("_b"), F.lit(1))))
    return _spots(rows, spots)


def _compared(rows: DataFrame, verify: _Verifier, block: int, homes: list[str], sets: DataFrame | None = None) -> list[DataFrame]:
    """Links of rows (node, key, comp, homes) between different classes of a key: nodes outside its largest class with all others."""
    rows = rows.distinct()
    sizes = rows.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mains = sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).where("k > 1")
    blocks = lambda c: F.ceil(c / F.lit(block)).cast("int")
    mains = mains.select("key", F.col("m.comp").alias("main"), blocks(F.col("c") - F.col("m.c")).alias("no"), blocks(F.col("m.c")).alias("nm"), (F.col("c") <= block).alias("one"))
    rows = small(rows.join(mains, "key"), "jaccard-groups")
    out = []
    if not rows.isEmpty():
        apart = F.col("comp") != F.col("main")
        b = _block_of(F.when(apart, F.col("no")).otherwise(F.col("nm")))
        own = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda o: _spot(0, F.least(b, o), F.greatest(b, o), F.when(b == o, -1).when(b > o, 1).otherwise(0)))
        to_main = F.transform(F.sequence(F.lit(0), F.col("nm") - 1), lambda m: _spot(1, b, m, F.lit(0)))
        from_main = F.transform(F.sequence(F.lit(0), F.col("no") - 1), lambda o: _spot(1, o, b, F.lit(1)))
        all_in_one = F.array(_spot(0, F.lit(0), F.lit(0), F.lit(-1)))
        spots = F.when(F.col("one"), all_in_one).when(apart, F.concat(own, to_main)).otherwise(from_main)
        out.append(verify(_spots(rows, spots, *homes), rows, tuple(homes), sets))
    drop(rows)
    return out
