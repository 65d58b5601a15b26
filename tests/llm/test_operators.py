"""The ten operators and the pipeline against brute force, with odd rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from marquee.llm import bytesnp, chat_format, decontamination, jaccard_join, packing, quality_rules, sentence_dedup, sharding, suffix_dedup, token_store, tokens, url_filters

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string"
LONG = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix a potion of jade and amber. "
OTHER = "Completely different words live here, nothing of which can be found in any other place of this small corpus. "


def rows():
    """Nulls, empties, ties, repeated rows, copies, near copies, shared passages, a very long text, a hot group."""
    near = " ".join(f"w{i}" for i in range(300))
    edited = near.replace("w150", "changed")
    texts = [None, "", " \n\t ", "one", "one two three", LONG, LONG, LONG + OTHER, "é" * 60 + LONG, OTHER * 3, near, edited, near.upper(), near + " tail", LONG * 400, "x" * 49, "x" * 50, "x" * 51, "a b c d e", "e d c b a"]
    out = [(i, t, "en", "s", 0 if t is None else len(t), "p") for i, t in enumerate(texts)]
    out += [(100 + i, "hot copy " + LONG, "en", "hot", 1, None) for i in range(30)]
    out += [(7, LONG + OTHER, "en", "s", 1, "p"), (None, LONG, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


# ---------------------------------------------------------------- 1


def brute_repeats(rs, width=50):
    by = collections.defaultdict(set)
    key = lambda i: float("inf") if i is None else i
    for i, t, *_ in rs:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            by[b[p : p + width]].add(key(i))
    out = []
    for i, t, *_ in rs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if min(by[b[p : p + width]]) < key(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [500, 1 << 20])
def test_suffix_dedup(docs, block_bytes):
    got = suffix_dedup.remove_repeats(docs, block_bytes=block_bytes, part_entries=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows())


def test_suffix_rows_of_one_order_are_not_compared(monkeypatch):
    s = suffix_dedup.Shape(50, 12, 1, (), ())
    texts = ["z" * 5 + "the quick brown fox jumps over the lazy dog again and again " + c * 30 for c in "abcd"]
    table = lambda ids: pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [texts[i] for i in ids], "block": pa.array([0] * len(ids), pa.int32())})
    none = suffix_dedup._table([], suffix_dedup._SCANNED)
    first, second = (suffix_dedup._scanning(s, True)((), suffix_dedup._building(s)((), table(ids)), none) for ids in ([0, 1], [2, 3]))
    calls, windows = [], suffix_dedup._windows
    monkeypatch.setattr(suffix_dedup, "_windows", lambda *a: calls.append(len(a[0])) or windows(*a))
    level = lambda t: t.filter(pc.equal(t["kind"], 1))
    out = suffix_dedup._finishing(s, False)((), table([0, 1]), first.filter(pc.equal(first["kind"], 0))).to_pylist()
    assert not calls and [r["n_removed"] > 0 for r in out] == [False, True]  # what was merged is not compared again
    one = suffix_dedup._building(s)((), table([0]))
    suffix_dedup._scanning(s, True)((), one.set_column(1, "block", pa.array([1], pa.int32())), level(first))
    assert not calls  # a copy of what the level holds, and a level by itself
    both = suffix_dedup._scanning(s, True, True, True)((), suffix_dedup._building(s)((), table([2, 3])), level(first))
    merged = suffix_dedup._merging(s)((), level(first), level(suffix_dedup._scanning(s, True)((), suffix_dedup._building(s)((), table([2, 3])), level(first))))
    assert level(both)["blob"].to_pylist() == merged["blob"].to_pylist()
    assert suffix_dedup._scanning(s, True, True, True)((), one.slice(0, 0), level(first)).equals(level(first))


def test_suffix_levels_merge_as_they_are_scanned(spark, docs, monkeypatch):
    names = []
    write = suffix_dedup.Family._write
    monkeypatch.setattr(suffix_dedup.Family, "_write", lambda self, df, name: names.append(name) or write(self, df, name))
    suffix_dedup.remove_repeats(docs, block_bytes=2000, part_entries=50)
    assert names.count("level") == 4 and names.count("merged") < 1


def test_suffix_dedup_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def added(tables, s, levels):
    """What the functions of one batch answer, in this process; appends the batch's level."""
    some = lambda t, c, x: t.filter(pc.equal(t[c], x))
    messages = pa.concat_tables([suffix_dedup._building(s)((), t) for t in tables])
    got = []
    for p in sorted(set(messages["part"].to_pylist())):
        held = [some(x, "part", p) for x in levels] or [suffix_dedup._table([], suffix_dedup._SCANNED)]
        got.append(suffix_dedup._scanning(s, True)((), some(messages, "part", p), held[-1]))
        got += [suffix_dedup._scanning(s, False)((), some(messages, "part", p), x) for x in held[:-1]]
    got = pa.concat_tables(got)
    levels.append(some(got, "kind", 1))
    out = []
    for t in tables:
        out += suffix_dedup._finishing(s, False)((), t, some(some(got, "kind", 0), "block", t["block"][0].as_py())).to_pylist()
    return [(x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], hashlib.sha256(x["kept"]).hexdigest()) for x in out]


@pytest.mark.parametrize(("parts", "hot", "piece"), [(1, False, None), (5, False, None), (7, True, None), (3, False, 300)])
def test_suffix_arrays_against_brute_force(parts, hot, piece, monkeypatch):
    """Texts of shared fragments with repeated ids, in batches and blocks, by ranges, with hot anchors, and long texts in pieces."""
    if piece:
        monkeypatch.setattr(suffix_dedup, "_PIECE", piece)
        monkeypatch.setattr(suffix_dedup, "runs", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    rng = random.Random(parts)
    base = ["".join(rng.choice(["ab", "cde", "fghi", "j", "klmno", "pq é", "rst\n"]) + " " for _ in range(200)) for _ in range(4)]
    rs = []
    for i in range(60):
        cuts = [(rng.choice(base), rng.randrange(400), rng.randrange(20, 160), rng.choice(["", "Q", "zz"])) for _ in range(rng.randrange(1, 6))]
        rs.append((rng.choice([i, i // 2]), "".join(x[a : a + n] + y for x, a, n, y in cuts)))
    rs.sort(key=lambda r: r[0])
    tables = lambda mine, k: [pa.table({"doc_id": pa.array([i for i, _ in mine[b::k]], pa.int64()), "text": pa.array([t for _, t in mine[b::k]], pa.string()), "block": pa.array([b] * len(mine[b::k]), pa.int32())}) for b in range(k)]
    all_ = suffix_dedup.Block(tables(rs, 1)[0], suffix_dedup.Shape(50, 12, 1, (), ())).rows
    grams = np.sort(np.ascontiguousarray(all_[:, :12]).view("S12").ravel())
    cuts = np.unique(grams[np.arange(1, parts) * len(grams) // parts]) if parts > 1 else grams[:0]
    full = lambda xs: tuple(x.ljust(12, b"\0") for x in xs.tolist())
    s = suffix_dedup.Shape(50, 12, parts, full(cuts), full(np.unique(grams)[::3]) if hot else ())
    levels, out = [], []
    for lo, hi in ((0, 10), (10, 25), (25, 60)):
        out += added([t for t in tables([r for r in rs if lo <= r[0] < hi], 3) if len(t)], s, levels)
    assert sorted(out, key=repr) == brute_repeats(rs)


def test_more_ranges_than_buckets(spark, monkeypatch):
    """Ranges beyond the number of buckets share them; results are the same."""
    monkeypatch.setattr(suffix_dedup, "MOST_BUCKETS", 3)
    rng = random.Random(3)
    base = ["".join(rng.choice(["ab", "cde", "fghi", "j", "klmno"]) + " " for _ in range(200)) for _ in range(3)]
    rs = [(i, "".join(x[a : a + rng.randrange(30, 160)] for x, a in ((rng.choice(base), rng.randrange(400)) for _ in range(4)))) for i in range(40)]
    docs = spark.createDataFrame(rs, "doc_id long, text string")
    assert suffix_dedup.shape_of(docs, sum(len(t) for _, t in rs), part_entries=50).parts > 3
    got = suffix_dedup.remove_repeats(docs, block_bytes=2000, part_entries=50).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_repeats(rs))


def test_entries_come_back():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 100, 3000).astype(np.uint8)
    s = suffix_dedup.Shape(50, 12, 1, (), ())
    lo, hi, at = suffix_dedup.anchors(buf, np.array([0, 1000, 3000]), 50, 12)
    rows = suffix_dedup._entries(buf, lo, hi, at, s)
    assert (suffix_dedup.unpacked(suffix_dedup.packed(rows, s), s) == rows).all()
    got = rows[suffix_dedup._ordered(rows)]
    assert [r.tobytes() for r in got] == sorted(r.tobytes() for r in rows)
    assert sum(hi - lo + 1) == 3000 - 2 * 49  # each window has one anchor
    for a, b, p, r in zip(lo, hi, at, rows, strict=True):
        assert r[: r[-2]].tobytes() == buf[p : b + 50].tobytes() and r[50 : 50 + r[-1]][::-1].tobytes() == buf[a:p].tobytes()


def test_family_outlives_a_call(spark, tmp_path):
    """Batches added one after another, each by a family opened anew from its folder, against brute force over all."""
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(90)) for _ in range(6)]
    rs = [(i, "".join(rng.choice(passages)[rng.randrange(30) :] + str(i * k) for k in range(rng.randrange(1, 4)))) for i in range(48)]
    at, out, sizes = f"file://{tmp_path}/family", [], []
    frame = lambda mine: spark.createDataFrame(mine, "doc_id long, text string")
    total = sum(len(t) for _, t in rs)
    family = suffix_dedup.Family(spark, suffix_dedup.shape_of(frame(rs[:6]), total, part_entries=200), at)
    for k in range(8):
        if k:
            family = suffix_dedup.Family.open(spark, at)
        got = suffix_dedup.removed_in_batch(family, frame(rs[6 * k : 6 * k + 6]), block_bytes=400)
        out += map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect())
        sizes.append([n for n, _ in family.levels])
    assert sorted(out, key=repr) == brute_repeats(rs)
    assert all(a >= 2 * b for s in sizes for a, b in zip(s, s[1:], strict=False)) and max(map(len, sizes)) > 1


# ---------------------------------------------------------------- 2


def brute_classes(rs, k, percent):
    sets_ = collections.defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in rs:
        w = words((t or "").translate(lower))
        s = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
        sets_[i].append(s)
    ids = sorted(i for i in sets_ if i is not None)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[a] < label[b] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets_[a] for y in sets_[b]):
                    label[b], changed = label[a], True
    return sorted(((i, len(s), label.get(i)) for i, ss in sets_.items() for s in ss), key=repr)


@pytest.mark.parametrize(("k", "percent", "most"), [(4, 85, 200_000), (5, 80, 0)])
def test_jaccard_join(docs, k, percent, most):
    got = jaccard_join.classes(docs, words=k, percent=percent, most_frequent=most, block=8).collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rows(), k, percent)


def test_jaccard_join_of_large_homes(spark):
    """Near copies and unlike texts that share frequent passages, in more blocks than one."""
    rng = np.random.default_rng(2)
    base, passage = [f"w{i}" for i in range(60)], [f"p{i}" for i in range(40)]
    out = []
    for i in range(60):  # near copies, some further away
        t = list(base)
        for k in rng.choice(60, int(rng.integers(0, 4)), replace=False):
            t[k] = f"x{i}_{k}"
        out.append((i, " ".join(t)))
    out += [(100 + i, " ".join(passage + [f"y{i}_{k}" for k in range(int(rng.integers(0, 6)))])) for i in range(40)]
    out += [(200 + i, " ".join(base[:50] + [f"z{i % 3}_{k}" for k in range(10 + i)])) for i in range(10)]
    rs = [(i, t, None, None, None, None) for i, t in out]
    for most in (0, 1000):
        got = jaccard_join.classes(spark.createDataFrame(rs, SCHEMA).repartition(3), words=2, percent=80, most_frequent=most, block=7).collect()
        assert sorted(map(tuple, got), key=repr) == brute_classes(rs, 2, 80)


@pytest.mark.parametrize("block", [4, 1024])
def test_jaccard_join_of_families(spark, block):
    """Copies edited to about the threshold, which share many keys: in one meeting, or in rounds where a family exceeds a block."""
    rng = random.Random(6)
    rs = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(80)]
        for _ in range(16):
            w = list(base)
            for at in rng.sample(range(80), rng.choice([0, 1, 2, 3, 4])):
                w[at] = f"x{rng.randrange(1000)}"
            rs.append((len(rs), " ".join(w)))
    got = jaccard_join.classes(spark.createDataFrame(rs, "doc_id long, text string"), words=4, percent=85, block=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_classes(rs, 4, 85)


def test_jaccard_join_of_few_rows_deals_out_little(spark):
    """Tables of few ids and keys take no shuffles, however many partitions these have; the classes are the same."""
    base = [f"w{i}" for i in range(60)]
    rs = [(i, " ".join(base[: 60 - i % 3] + [f"x{i % 4}"])) for i in range(12)]
    rs += [(20 + i, f"a{i} b{i} c{i} d{i}") for i in range(4)]
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    sc = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-rows", "")
        got = jaccard_join.classes(spark.createDataFrame(rs, "doc_id long, text string"), words=4, percent=85).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=repr) == brute_classes(rs, 4, 85)
    tracker = sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-rows") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(tracker.getStageInfo(s).numCompletedTasks for s in stages if tracker.getStageInfo(s))
    assert tasks < 700


def test_jaccard_join_empty(empty):
    assert jaccard_join.classes(empty).count() == 0


def test_frequent_combinations_find_linked_sets():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 85, 90):
        for n in (1, 2, 5, 9, 20, 33, 64, 100, 400):
            base = np.sort(rng.integers(0, 1 << 62, n).astype(np.uint64))
            for share in (0.0, 0.5, 1.0):
                frequent = np.sort(base[rng.random(n) < share])
                for _ in range(20):
                    k = int(n * (100 - percent) / (100 + percent))
                    other = np.unique(np.r_[np.delete(base, rng.choice(n, min(k, n - 1), replace=False)), rng.integers(0, 1 << 62, rng.integers(0, k + 1)).astype(np.uint64)])
                    common = len(np.intersect1d(base, other))
                    if 100 * common >= percent * (len(base) + len(other) - common):
                        both, begin = jaccard_join.keys(np.r_[base, other], np.array([0, len(base), len(base) + len(other)]), frequent, percent)
                        assert len(np.intersect1d(both[: begin[1]], both[begin[1] :]))


# ---------------------------------------------------------------- 3


def test_sentence_spans(docs, empty):
    out = {r.doc_id: r for r in sentence_dedup.remove_repeats(docs, run=2, least_words=6).collect()}
    assert out[5].text == LONG and out[5].n_removed == 0
    assert out[0].text is None and out[1].text == ""
    a, b = "Alpha beta gamma delta epsilon. Zeta eta theta iota kappa. ", "Unique words one. And two more. "
    d = docs.sparkSession.createDataFrame([(2, b + a, "x"), (1, a, "y"), (3, None, None)], "doc_id long, text string, N_sentences string")
    d = d.withColumns({c: F.lit(c) for c in ("row", "spans", "_row", "_spans", "removed_spans", "h1", "a", "first")})
    out = sentence_dedup.remove_repeats(d, run=2, least_words=6).collect()
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed, r.row, r.spans, r._row, r.h1, r.removed_spans) for r in out} == {
        1: (a, 2, 0, "row", "spans", "_row", "h1", []), 2: (b, 4, 2, "row", "spans", "_row", "h1", [[2, 3]]), 3: (None, 0, 0, "row", "spans", "_row", "h1", []),
    }
    assert sentence_dedup.remove_repeats(empty).count() == 0


def test_sentence_spans_without_floor(spark):
    short, single = "Come in. Sit down. ", " ".join(f"w{i}" for i in range(30)) + ". "
    d = spark.createDataFrame([(1, short + "First end here."), (2, "Second start. " + short), (3, single + "Third end."), (4, "Fourth start. " + single), (5, "One line"), (6, "One line"), (7, "Come in. Go out.")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in sentence_dedup.remove_repeats(d).collect()}
    assert got == {1: (short + "First end here.", 0), 2: ("Second start. ", 2), 3: (single + "Third end.", 0), 4: ("Fourth start. ", 1), 5: ("One line", 0), 6: ("", 1), 7: ("Come in. Go out.", 0)}


def test_sentence_spans_against_brute_force(docs):
    at, gone = {}, collections.defaultdict(set)
    for i, t in sorted({(float("inf") if r[0] is None else r[0], r[1] or "") for r in rows()}):
        held = [(k, p.split()) for k, p in enumerate(sentence_dedup.sentences(t)) if p.split()]
        for k in range(len(held)):
            for n in {1, 2} if len(held[k][1]) >= 25 or len(held) == 1 else {2}:
                if k + n <= len(held) and at.setdefault(" ".join(x for _, w in held[k : k + n] for x in w), (i, t, k)) != (i, t, k):
                    gone[i, t] |= {p for p, _ in held[k : k + n]}
    for r in sentence_dedup.remove_repeats(docs.select("doc_id", F.col("text").alias("t"), "text")).collect():
        i = float("inf") if r.doc_id is None else r.doc_id
        assert r.n_removed == len(gone[i, r.t or ""])


# ---------------------------------------------------------------- 4


def test_quality_features(docs):
    got = collections.Counter(tuple(r) for r in quality_rules.features(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = collections.Counter()
    for i, t, *_ in rows():
        w = words(t)
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {p for j, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for p in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)] += 1
    assert got == want


def test_decision_list_learns_held_out_rules():
    rng = np.random.default_rng(0)
    make = lambda n: [(float(a), float(b), int(a > 0.7 or b < 0.1)) for a, b in rng.random((n, 2))]
    rules = quality_rules.cover(make(2000), ["a", "b"])
    hit = lambda a, b: any(all(({"a": a, "b": b}[k] >= x) == up for k, up, x in r) for r in rules)
    assert np.mean([hit(a, b) == bool(y) for a, b, y in make(1000)]) > 0.93
    assert quality_rules.cover([], ["a"]) == [] and quality_rules.cover([(1.0, 0)] * 9, ["a"]) == []


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(docs, none).count() == len(rows())
    assert quality_rules.kept_rows(empty, none).count() == 0
    kept = {r.doc_id for r in quality_rules.kept_rows(docs, none).collect()}
    assert 10 in kept and 0 not in kept and 14 not in kept


def test_quality_with_clashing_names(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    extra = docs.withColumns({c: F.lit(c) for c in ("n_words", "_w", "kept", "_at", "Base_Failed", "_c0", "_id")})
    judged = quality_rules.judge(extra, none)
    assert {(r._w, r._at, r._c0) for r in judged.collect()} == {("_w", "_at", "_c0")} and dict(judged.dtypes)["kept"] == "boolean" and dict(judged.dtypes)["n_words"] == "bigint"
    kept = quality_rules.kept_rows(extra, none)
    assert kept.columns == extra.columns and {(r.n_words, r.kept, r._w, r.Base_Failed) for r in kept.collect()} == {("n_words", "kept", "_w", "Base_Failed")}


# ---------------------------------------------------------------- 5


def test_chat_pairs(spark):
    turns = [(0, 0, "user", "Hi"), (0, 1, "assistant", "A"), (1, 0, "user", "Hi"), (1, 1, "assistant", "B"), (2, 0, "user", "x"), (4, 0, None, None), (5, 0, None, None), (None, 0, "user", "y"), (6, None, "user", "q"), (7, 0, "user", "q")]
    got = {r.pair_id: r for r in chat_format.preference_pairs(chat_format.pairs_by_parity(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {0, 2, 3}
    assert got[0].prompt == "<|user|>\nHi<|end|>\n" and got[0].chosen == "<|assistant|>\nA<|end|>\n" and got[0].rejected_loss == "14:23"
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].prompt) == (1, "", "<|unknown|>\n<|end|>\n")


def test_chat_odd_rows(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id string"
    long = "word " * 200_000
    turns = [(-1, 0, "user", "a", "x"), (-2, 0, "user", "a", "x"), (-2, 1, "assistant", "b<|end|>\n", "x"), (0, 0, "user", "q", "x"), (1, 0, "user", long, "x"), (0, 0, "user", "q", "x")]
    got = {r.pair_id: r for r in chat_format.preference_pairs(chat_format.pairs_by_parity(spark.createDataFrame(turns, schema))).collect()}
    assert set(got) == {-1, 0}
    assert got[-1].n_prompt_turns == 1 and got[-1].chosen == "<|assistant|>\nb< |end|>\n<|end|>\n" and got[-1].chosen_loss == "14:32" and got[-1].rejected == ""
    assert got[0].n_prompt_turns == 0 and got[0].chosen.count("<|user|>\nq") == 2 and long in got[0].rejected
    two = spark.createDataFrame([(1, True, 4, 0, "user", "x"), (1, True, 2, 0, "user", "y"), (1, False, 3, 0, "user", "y")], "pair_id long, is_chosen boolean, conv_id long, turn long, role string, text string")
    r = chat_format.preference_pairs(two).collect()
    assert [(x.chosen_id, x.n_prompt_turns, x.chosen, x.prompt) for x in r] == [(2, 1, "", "<|user|>\ny<|end|>\n")]
    assert chat_format.preference_pairs(two.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_url_filters(spark):
    rules = [("com", "/en/", "block"), ("ok.com", "/en/7", "allow")]
    pages = [
        (1, "http://a.com/en/5", '<link rel="canonical" href="http://b.io/x">'), (2, "http://b.io/x/", None), (3, "http://WWW.c.io/y?b=1&utm_source=3", '<meta http-equiv="refresh" content="0; url=http://b.io/x#f">'), (4, None, None), (5, "http://q.io/1", ""),
        (6, "nohost", "x"), (7, "https://ok.com/en/77", '<link rel=canonical href="//z.io/1">'), (8, "http://z.io/1.html", '<link rel="canonical" href="http://b.com/en/1">'), (9, "http://b.com/en/1", None), (1, "http://a.com/en/5", None), (10, "http://notcom/en/1", None),
    ]
    judged = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert len(judged) == len(pages)
    got = {(r.page_id, r.host, r.rule, r.verdict) for r in judged}
    assert got == {
        (1, "a.com", "com/en/", "block"), (2, "b.io", None, "block"), (3, "www.c.io", None, "block"), (4, "", None, "allow"), (5, "q.io", None, "allow"), (6, "", None, "allow"),
        (7, "ok.com", "ok.com/en/7", "allow"), (8, "z.io", None, "allow"), (9, "b.com", "com/en/", "block"), (10, "notcom", None, "allow"),
    }


def test_relative_links(spark):
    cases = [
        ("http://a.com/x/y.html", "z.html", "http://a.com/x/z.html"), ("http://a.com/x/y", "../z?q=1#f", "http://a.com/z?q=1#f"), ("http://a.com", "z", "http://a.com/z"), ("http://a.com/x/", "./z/../w", "http://a.com/x/w"),
        ("http://a.com/x", "../../z", "http://a.com/z"), ("http://a.com/x?b=1", "?p=2", "http://a.com/x?p=2"), ("http://a.com/x", "#top", None), ("http://a.com/x", "mailto:me@b.c", None), ("https://a.com/x", "//b.org/z", "http://b.org/z"), ("http://a.com/x/y", "/z", "http://a.com/z"),
        ("http://a.com/x/y/z", "..", "http://a.com/x/"),
    ]
    got = spark.createDataFrame(cases, "url string, target string, want string").select("want", url_filters.absolute(F.col("url"), F.col("target")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    pages = [(1, "http://a.com/en/1", '<link rel="canonical" href="../b">' + "x" * 300_000), (2, "http://a.com/b", None), (3, "http://a.com/c", '<meta http-equiv="refresh" content="0; url=?p=2">')]
    rows_ = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("z")).withColumn("_key", F.lit(1)).withColumn("host", F.lit(2))
    assert {(r.page_id, r.rule, r.verdict) for r in url_filters.judge(rows_, [("com", "/en/", "block")]).collect()} == {(1, "com/en/", "block"), (2, None, "block"), (3, None, "allow")}
    assert url_filters.judge(rows_.limit(0), [("com", "/en/", "block")]).count() == 0


def test_url_filters_against_sql(spark):
    from marquee.llm import queries

    from ..oracle import connect, rows_of_spark, rows_of_sql

    pages = [(i, f"http://{h}/{p}{i % 3}", f'<link rel="canonical" href="{t}">') for i, (h, p, t) in enumerate((h, p, t) for h in ("a.com", "b.net", "c.org") for p in ("en/", "de/x/", "") for t in ("z", "../z", "./y/../z?q=1", "?k=1", "/en/2", "mailto:x", "http://c.org/es/1", "..", "#a"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = connect("/root/testdata/sf0.001")
    con.execute("drop view pages")
    con.register("pages", df.toPandas())
    assert rows_of_spark(url_filters.judge(df, queries.URL_RULES)) == rows_of_sql(con, queries.ORACLES["op6_url_filters"])


# ---------------------------------------------------------------- 7


def brute_align(a, b):
    best, prev = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, prev[j] + (1 if x == y else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 15)), rng.integers(0, 5, rng.integers(1, 30))
        score, start, end = decontamination.align(a.astype(np.uint64), b.astype(np.uint64))
        assert score == brute_align(a.tolist(), b.tolist())
        assert brute_align(a.tolist(), b[start:end].tolist()) == score


def test_decontamination(spark, docs, empty):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    d = [(1, f"noise {OTHER} {item.upper()} tail"), (2, f"x {item.replace('delta', 'other').replace('iota', '')} y"), (3, OTHER), (4, "alpha beta gamma " + OTHER), (5, None), (6, "short item"), (1, item)]
    items = spark.createDataFrame([(7, item), (8, None), (9, "short item")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.matches(spark.createDataFrame(d, "doc_id long, text string"), items).collect()}
    assert set(got) == {(1, 7), (2, 7), (6, 9)} and got[1, 7] == 1
    assert decontamination.matches(empty, items).count() == 0
    assert decontamination.matches(docs, items.limit(0)).count() == 0


def test_decontamination_against_every_pair(spark):
    """Every document of a table held against every item without seeds: what alignment alone finds is found."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    ds, bs = (pq.read_table(f"{sf}/{t}.parquet").to_pylist() for t in ("documents", "benchmark"))
    rng = np.random.default_rng(4)
    for b in bs[:20]:  # edited copies besides those that the table holds
        w = words(b["text"])
        for k in rng.choice(len(w), len(w) // 5, replace=False):
            w[k] = "edited"
        ds.append({"doc_id": 10_000 + b["item_id"], "text": OTHER + " ".join(w) + OTHER})
    item_words = decontamination._words([b["text"] for b in bs])
    want = set()
    for d, h in zip(ds, decontamination._words([d["text"] for d in ds]), strict=True):
        have = set(h.tolist())
        for b, w in zip(bs, item_words, strict=True):
            if len(w) and sum(x in have for x in w.tolist()) >= 0.5 * len(w):  # the score cannot be higher
                score, _, _ = decontamination.align(w, h)
                if score >= 0.5 * len(w) and (len(w) >= 3 or score == len(w)):
                    want.add((d["doc_id"], b["item_id"]))
    docs_ = spark.createDataFrame([(d["doc_id"], d["text"], "x", 1) for d in ds], "doc_id long, text string, item_id string, k int")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(docs_, spark.createDataFrame([(b["item_id"], b["text"]) for b in bs], "item_id long, text string")).collect()}
    assert len(want) >= 20 and got <= want and len(got & want) >= 0.9 * len(want)
    print("recall", len(got & want), "of", len(want))


def test_decontamination_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    long = "pad " * 300_000
    d = [(1, long + item + " " + long), (2, item), (2, "x " + item), (2, "nothing"), (None, item), (3, item + " q " + item)]
    got = {(r.doc_id, r.item_id): (r.score, r.start_word) for r in decontamination.matches(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame([(7, item), (7, item), (8, "")], "item_id long, text string")).collect()}
    assert got == {(1, 7): (1.0, 300_000), (2, 7): (1.0, 0), (None, 7): (1.0, 0), (3, 7): (1.0, 0)}


# ---------------------------------------------------------------- 8, 10


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    return collections.Counter((i, tuple([*e.ids, end])) for (i, *_), e in zip(rows(), t.encode_batch([r[1] or "" for r in rows()], add_special_tokens=False), strict=True))


@pytest.mark.parametrize(("name", "glue"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_are_those_of_the_plain_library_call(name, glue):
    import pyarrow as pa
    from tokenizers import Tokenizer

    a, b = twins(11)
    texts = [a, b, f"{a} {b} {a}", "foo <|endoftext|> bar", "<|EndOfText|>x", "<|startoftext|><|endoftext|>", "end <|endoftext", "|> no", None, "", "  a\tb\u00a0c\u2003d\n\n e"]
    t = Tokenizer.from_file(P.path(name))
    got = [ids[p:q].tolist() for _, ids, begin in tokens.Encoder(P.path(name), glue).column(pa.array(texts, pa.string()), 7) for p, q in zip(begin[:-1], begin[1:], strict=True)]
    assert got == [[*t.encode(x or "", add_special_tokens=False).ids, 7] for x in texts]


def test_packing_round_trip(docs, empty):
    pieces = packing.pack(docs, P.path("byte_bpe_50k.json"), length=64, with_ids=True).collect()
    flat = sorted((p.sequence_id, p.offset, p) for p in pieces)
    at = 0
    for seq, off, p in flat:
        assert seq * 64 + off == at and off + p["length"] <= 64 and zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32
        at += p["length"]
    got, now = collections.Counter(), []
    for _, _, p in flat:
        now += p.ids
        if p.start + p["length"] == p.doc_tokens:
            got[p.doc_id, tuple(now)] += 1
            now = []
    assert got == ids_of("byte_bpe_50k.json", 0)
    assert packing.pack(empty, P.path("byte_bpe_50k.json")).count() == 0


def test_token_store_round_trip(docs, empty):
    stored = token_store.write(docs, P.path("word_bpe_49k.json"), segment_ids=300)
    got = sorted(map(tuple, token_store.read(stored).collect()), key=lambda r: r[1])
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    ids = [r[0] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, x), n in ids_of("word_bpe_49k.json", 1).items() for _ in range(n))
    assert collections.Counter((i, n, c) for i, _, n, c in got) == want
    assert token_store.read(token_store.write(empty, P.path("word_bpe_49k.json"))).count() == 0


def test_token_store_of_one_repeated_id(spark):
    rs = [(1 << 60 if i % 3 else None, f"word {i}", None, None, None, None) for i in range(200)] + [(-5, "x", None, None, None, None)]
    stored = token_store.write(spark.createDataFrame(rs, SCHEMA).repartition(5), P.path("word_bpe_49k.json"), segment_ids=20)
    got = sorted(map(tuple, token_store.read(stored).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 67 + [-5] + [1 << 60] * 133
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got]).tolist()[:-1]]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, u in ((1, 0), (5, 10), (3000, 10**6), (700, 800), (90, 1 << 62), (1000, 0)):
        v = np.sort(rng.integers(0, u + 1, n))
        ef = token_store.EliasFano.load(token_store.EliasFano.build(v).dump())
        assert (ef.selects(np.arange(n)) == v).all() and [ef.select(i) for i in range(n)] == v.tolist()
    assert len(token_store.EliasFano.build(np.arange(0, 10**6, 300)).dump()) < 8 * 10**6 / 300 / 4


# ---------------------------------------------------------------- 9


def test_sharding(spark, docs, empty):
    many = docs.unionByName(spark.range(3000).select((F.col("id") + 1000).alias("doc_id"), F.when(F.col("id") % 3 == 0, "the hot text").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"), *(F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"), ("part", "string")))))
    for most_rows in (sharding.MOST_ROWS, 3):
        check_shards(many, sharding.shards_by_bytes(many, most_rows=most_rows).collect())
    assert sharding.shards_by_bytes(empty).count() == 0


def check_shards(many, got):
    texts = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in many.collect())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == texts
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums.values()) - min(sums[s] for s in range(16)) <= 2 * max(r["size"] for r in got)


# ---------------------------------------------------------------- helpers and pipeline


def test_slice_hashes_depend_on_bytes_alone():
    buf = np.frombuffer(b"abcabcabd" * 1000, np.uint8)
    s = np.array([0, 3, 9, 6])
    a = bytesnp.hashes(buf, s, s + 3)
    assert a[0] == a[1] == a[2] != a[3]
    wide = bytesnp.hashes(buf, np.array([0, 9, 1]), np.array([900, 909, 901]))
    assert wide[0] == wide[1] != wide[2] and (bytesnp.hashes(buf, s, s + 3, 1) != a).all()


def twins(k):
    """The Thue-Morse word of 2**k letters and its complement, which fool any polynomial modulo 2**64 from k = 11 on."""
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_structured_words_are_told_apart():
    a, b = twins(11)
    buf = np.frombuffer((a + b).encode(), np.uint8)
    n = len(a)
    h = bytesnp.hashes(buf, np.array([0, n]), np.array([n, 2 * n]))
    assert h[0] != h[1]
    sets_, begin = jaccard_join.sets(np.frombuffer(f"{a} x y z{b} x y z".encode(), np.uint8), np.array([0, n + 6, 2 * n + 12]), 4)
    assert sets_[begin[0]] != sets_[begin[1]]


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline as C

    labels = [(i, int(i % 5 > 0)) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w10 w11 w12 w13 w14 w15 w16 w17 w18 w19 w20")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    body = " ".join(f"v{i}" for i in range(120))
    more = [(500, body, "en", "s", 1), (501, body, "en", "s", 1), (502, " ".join(f"w{i}" for i in range(120)), "en", "s", 1), (503, " ".join(f"u{i}" for i in range(120)) + " " + body[:200], "en", "s", 1)]
    part = "A shared passage that is rather long é " * 3
    more += [(510, "\ufffd " + " ".join(f"a{i}" for i in range(80)) + part, "en", "s", 1), (511, part + " ".join(f"b{i}" for i in range(80)), "en", "s", 1), (511, part + " ".join(f"c{i}" for i in range(80)), "en", "s", 1), (512, part[:60], "en", "s", 1)]
    base = docs.select(*C.COLUMNS).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    now, seen = base, []
    for name, stage in C.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert out.columns == C.COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
    assert {500, 501, 502, 503} <= seen[0] and 0 not in seen[0]
    assert 501 not in seen[1] and {500, 502, 503} <= seen[1]
    cut = spark.read.parquet(str(tmp_path / "suffix_array_dedup")).where("doc_id = 503").first()
    assert body[:150] not in cut.text and cut.text.startswith("u0 u1") and cut.n_chars == len(cut.text)
    assert 502 not in seen[3] and {500, 503} <= seen[3] == seen[4]
    assert sorted(r.text[:4] for r in spark.read.parquet(str(tmp_path / "suffix_array_dedup")).where("doc_id in (510, 511)").collect()) == ["b0 b", "c0 c", "\ufffd a0"]
    packed = spark.read.parquet(str(tmp_path / "packing"))
    assert {"ids", "sequence_id"} <= set(packed.columns) and packed.where("size(ids) <> length").count() == 0


def test_pipeline_of_an_empty_table(spark, empty, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = empty.select(*C.COLUMNS)
    for _, stage in C.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.count() == 0
