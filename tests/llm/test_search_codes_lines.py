"""Operators 11 to 13 against brute force, on odd rows and at their inner bounds."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquee.llm import lexical_search, line_dedup, queries, vector_codes
from tests.oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_wavelet_search", "op12_heap_codes", "op13_line_dedup"])
def test_whole_query_matches_sql(spark, name):
    assert rows_of_spark(queries.QUERIES[name](spark, SF)) == rows_of_sql(connect(SF), queries.ORACLES[name])


# ---------------------------------------------------------------- search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def searched(docs, items, k):
    held = [(i, Counter(w)) for i, t in docs if (w := _terms(t))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    asked = defaultdict(Counter)
    for i, t in set(items):
        asked[i].update(_terms(t))
    for item, q in asked.items():
        scores = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, n in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i, s))
        out += [(item, r + 1, i, s) for r, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: x[:2] + ((x[2] or 0),))[:k])]
    return sorted(out, key=repr)


def _docs(n, seed=0, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Été", "naïve", "日本", "X9"]
    return [(i, " ".join(rng.choice(words[: rng.choice([4, 20, len(words)])]) for _ in range(rng.choice([0, 1, 3, 12, 40])))) for i in range(n)]


ODD = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "?!--"), (None, "w1 w2 w3"), (5, "w1 w2 w3"), (5, "w1 w2 w3"), (1004, "w1 " * 30_000 + "rare"), (1005, "W1 w1\x00W1")]
ITEMS = [(1, "w1 w2 w2 rare"), (2, "Été été W5?"), (3, None), (4, "nowhere"), (None, "w7-w8 w9"), (1, "w1 w2 w2 rare"), (1, "w30"), (6, "w1")]


@pytest.mark.parametrize("shard", [7, 100, 1 << 15])
def test_search_is_exact(spark, monkeypatch, shard):
    """Also with many small shards, whose best scores carry on."""
    monkeypatch.setattr(lexical_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(lexical_search, "AT_ONCE", 3)
    docs = _docs(400) + ODD
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("other")).withColumn("rank", F.lit(0)).repartition(3)
    i = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit("x"))
    got = lexical_search.search(lexical_search.build(d), i, 5)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == searched(docs, ITEMS, 5)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "MOST_ASKED", 4)
    docs, items = _docs(80, 3), [(i, f"w{i} w{i + 1} w{2 * i}") for i in range(12)]
    got = lexical_search.search(lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"), 3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == searched(docs, items, 3)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for d in (none, one):
        assert lexical_search.search(lexical_search.build(d), items).collect() == []
    some = lexical_search.build(spark.createDataFrame(_docs(20), "doc_id long, text string"))
    assert lexical_search.search(some, items.where("false")).collect() == []


def test_shards_are_read_a_few_at_a_time(spark, monkeypatch, tmp_path):
    """A row group ends behind a few large shards, and one shard at a time goes to Python."""
    import pyarrow.parquet as pq

    name, at = "spark.sql.execution.arrow.maxRecordsPerBatch", tmp_path / "shards"
    before = spark.conf.get(name)
    docs = spark.range(24, numPartitions=1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 80000), i -> id || 'x' || i), ' ')").alias("text"))
    index = lexical_search.build(docs, at=f"file://{at}")
    groups = [m.row_group(i) for f in at.glob("*.parquet") for m in [pq.read_metadata(f)] for i in range(m.num_row_groups)]
    assert len(groups) == sum(g.num_rows for g in groups) > 3 and max(g.total_byte_size for g in groups) < 1 << 24
    handed = []
    one = lexical_search.table
    monkeypatch.setattr(lexical_search, "table", lambda df, what, **more: handed.append((what, spark.conf.get(name))) or one(df, what, **more))
    got = lexical_search.search(index, spark.createDataFrame([(1, "3x7 5x9 5x10")], "item_id long, text string"), 5).collect()
    assert [r.doc_id for r in got] == [5, 3] and ("found", "1") in handed and spark.conf.get(name) == before


def test_runs_of_a_tree_are_postings_by_impact():
    """Every node's run of a term is that term's postings among the node's documents, best first."""
    rng = np.random.default_rng(1)
    n_docs, n_terms = 37, 9
    pairs = np.unique(rng.integers(0, n_docs * n_terms, 180))
    term, doc = pairs // n_docs, pairs % n_docs
    impact = rng.integers(1, 50, len(pairs))
    by = np.lexsort((doc, -impact, term))
    term, doc, impact = term[by], doc[by], impact[by]
    levels, seq, bits = 6, doc, []
    for k in range(levels):
        bit = seq >> (levels - 1 - k) & 1
        bits.append(np.packbits(bit.astype(bool)))
        seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
    ends = np.searchsorted(term, np.arange(n_terms + 1))
    shard = lexical_search.Shard(n_docs, np.arange(n_terms), ends, np.concatenate(bits), impact)
    level, path = np.zeros(1, np.int64), np.zeros(1, np.int64)
    node, s, e, w = np.zeros(n_terms, np.int64), ends[:-1], ends[1:], np.arange(1, n_terms + 1)
    for k in range(levels):
        parent, path, bound, node, s, e, w = shard.halves(level, path, node, s, e, w)
        level = level[parent] + 1
        for i, t in enumerate(w - 1):
            below = (doc >> (levels - 1 - k) == path[node[i]]) & (term == t)
            assert shard.impacts[k + 1, s[i] : e[i]].tolist() == impact[below].tolist()
        assert bound.tolist() == [sum((t + 1) * impact[(doc >> (levels - 1 - k) == p) & (term == t)].max(initial=0) for t in range(n_terms)) for p in path]


# ---------------------------------------------------------------- codes


def lloyd(rows, parts, entries, rounds):
    """Codes by plain integers."""
    kept = sorted(((i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == length]
    cut = [p * length // parts for p in range(parts + 1)]
    cutting = lambda v: [tuple(v[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    xs = [cutting(v) for _, v, _ in kept]
    books = [[x[p] for x in xs[:entries]] for p in range(parts)]
    square = lambda a, b: sum((i - j) ** 2 for i, j in zip(a, b, strict=True))
    near = lambda x: [min(range(len(books[p])), key=lambda e: (square(x[p], books[p][e]), e)) for p in range(parts)]
    for _ in range(rounds):
        codes = [near(x) for x in xs]
        for p in range(parts):
            for e in range(len(books[p])):
                if mine := [x[p] for x, c in zip(xs, codes, strict=True) if c[p] == e]:
                    books[p][e] = tuple(sum(v) // len(mine) for v in zip(*mine, strict=True))
    codes = [near(x) for x in xs]
    errors = [sum(square(x[p], books[p][c[p]]) for p in range(parts)) for x, c in zip(xs, codes, strict=True)]
    by_label = defaultdict(int)
    for (_, _, lab), e in zip(kept, errors, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, bytes(c).hex(), e, by_label[lab]) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True)), key=repr), digest


def coded(spark, rows, **how):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit(0)).withColumn("id", F.lit(0)).repartition(3)
    out, books = vector_codes.encode(d, **how)
    got = vector_codes.with_label_errors(out)
    assert got.columns == ["id", "label", "code", "error", "label_error"]
    return sorted(((r.id, bytes(r.code).hex(), r.error, r.label_error) for r in got.collect()), key=repr), vector_codes.digest_of(books)


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize("block", [5, 4096])
def test_codes_are_those_of_plain_lloyd(spark, monkeypatch, block):
    """With ties, repeated rows, odd rows, and five rounds, so that drifts add up."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 6] + rng.normal(size=8) * 0.2)], i % 3 if i % 7 else None) for i in range(300)]
    rows += [(300 + i, [0.25 * (i % 3)] * 8, 1) for i in range(60)]  # copies, and parts equally far from two entries
    rows += [(10, rows[10][1], 2), (None, rows[3][1], 2), (900, None, 1), (901, [NAN] + [0.0] * 7, 1), (902, [None] + [0.0] * 7, 1), (903, [INF] + [0.0] * 7, 1), (904, [0.0] * 4, 1), (905, [], 1), (906, [-0.0] * 8, None)]
    for entries, rounds in ((4, 5), (12, 2), (1, 1)):
        assert coded(spark, rows, parts=4, entries=entries, rounds=rounds) == lloyd(rows, 4, entries, rounds)


def test_codes_of_few_rows_and_large_components(spark):
    few = [(3, [1.0, -1e5, 3.5, 2.0], 1), (1, [2e4, 5.0, -3.5, 1.0], None)]
    assert coded(spark, few, parts=2, entries=64, rounds=2) == lloyd(few, 2, 64, 2)
    odd = [(i, [float((i * j) % 11) for j in range(7)], 0) for i in range(40)]  # seven components in three parts
    assert coded(spark, odd, parts=3, entries=5, rounds=3) == lloyd(odd, 3, 5, 3)
    assert coded(spark, [(1, None, 1)]) == ([], hashlib.sha256(b"").hexdigest())


def test_heaps_look_at_few_parts(monkeypatch):
    """Where entries move little, most parts are never scanned again; results are those of a full scan."""
    rng = np.random.default_rng(2)
    book = rng.integers(-4000, 4000, (64, 4))
    x = book[rng.integers(0, 64, 20_000)] + rng.integers(-60, 61, (20_000, 4))
    heaps, drift, seen = vector_codes.Heaps(*vector_codes.scan(x, book), 64), np.zeros(64), []
    scan = vector_codes.scan
    monkeypatch.setattr(vector_codes, "scan", lambda some, b: (seen.append(len(some)), scan(some, b))[1])
    for _ in range(4):
        new = book + rng.integers(-9, 10, book.shape)
        drift = drift + vector_codes._moved([book], [new])[0]
        book, heaps = new, heaps.advance(x, new, drift)
        assert (heaps.entry() == vector_codes.squares(x, book).argmin(1)).all()
    assert sum(seen) < 4 * len(x) / 5


# ---------------------------------------------------------------- lines


def lined(docs, least=10, most=1):
    white = " \t\n\v\f\r"
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    at = defaultdict(set)
    last = (1 << 63) - 1
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(k := low(line.strip(white))) >= least:
                at[k].add(last if i is None else i)
    gone = lambda i, line: len(at.get(low(line.strip(white)), ())) > most and (last if i is None else i) > min(at[low(line.strip(white))])
    out = []
    for i, t in docs:
        old = (t or "").split("\n")
        new = [x for x in old if not gone(i, x)]
        out.append((i, None if t is None else "\n".join(new), len(old), len(old) - len(new)))
    return sorted(out, key=repr)


LINES = [
    (4, "Same line of text\nown line of four\n  SAME LINE of text \nshort"), (2, "same line of text\t\nshort\nsame line of text"), (3, "short\n\nonly here and long\r\nsame line of text"), (9, ""), (8, None), (7, "\n\n"),
    (None, "same line of text\nnull id line here"), (None, "null id line here"), (2, "another text of two\nown line of four"), (5, "éééééééééé\nééééééééé"), (6, "éééééééééé\nééééééééé\n same line of text"), (1, "x" * 3_000_000 + "\nshort\nlong enough line\n"), (10, "long enough line\n" * 1000 + "x" * 3_000_000), (10, "long enough line\n" * 1000 + "x" * 3_000_000),
]


@pytest.mark.parametrize("most", [1, 2])
def test_lines_go_as_by_hand(spark, most):
    d = spark.createDataFrame(LINES, "doc_id long, text string").withColumns({"gone": F.lit(1), "id": F.lit(2), "n_lines": F.lit("x"), "first": F.lit(3)}).repartition(4)
    got = line_dedup.remove_repeats(d, most_docs=most)
    assert got.columns == ["doc_id", "gone", "id", "first", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=repr) == lined(LINES, most=most)


def test_lines_of_nothing(spark):
    assert line_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
