"""Duplicates and venue links against plain loops, on hot keys, and at size."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.functions import geo, names, text
from marquee.operators import linking, resolution

VENUE = "id long, name string, zip_code string, lat double, lng double, n_events long, created_at timestamp"


def grams(words):
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def metres(a, b):
    if None in (*a, *b):
        return None
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(h))


class Name:
    """A venue's name, judged value by value."""

    def __init__(self, raw):
        fold = lambda s: [w for w in re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFD", s.lower().replace("&", " et ")).encode("ascii", "ignore").decode()).split()]

        def telling(words):
            return list(dict.fromkeys(w for w in words if w not in names.GENERIC_WORDS and not re.match(names.AREA_CODE, w)))

        def tokens(s):
            words = fold(s)
            at = max((i for i, w in enumerate(words) if w == "a" and 0 < i < len(words) - 1), default=None)
            if at is not None and len(telling(words[:at])) >= 2:
                words = words[:at]
            return telling(words)

        self.tokens = tokens(raw)
        self.key = "".join(sorted(self.tokens))
        bare = [w for w in re.sub(r"\b75\d{3}\b|\b\d{1,2}(e|er|eme)\b", " ", " ".join(fold(raw))).split() if w not in text.ARTICLES and w not in text.VENUE_NOISE]
        self.plain = " ".join(bare) or " ".join(fold(raw))
        parts = [tokens(p) for p in re.split(names.PART_MARKS, raw) if p.strip(" )")]
        self.complex, self.halls = set(parts[0] if parts else ()), [set(p) for p in parts[1:] if p]

    def compatible(self, o):
        if not self.key or not o.key:
            return False
        if self.key == o.key:
            return True
        digits = [{w for w in n.tokens if w.isdigit()} for n in (self, o)]
        if bool({*self.tokens} & {*names.OPEN_PLACES}) != bool({*o.tokens} & {*names.OPEN_PLACES}) or all(digits) and digits[0] != digits[1] or {self.key, o.key} & {*names.GENERIC_KEYS}:
            return False
        for a, b in ((self, o), (o, self)):
            if a.complex & {*b.tokens} and any(not h <= {*b.tokens} for h in a.halls):
                return False
        s, t = {*self.tokens}, {*o.tokens}
        short, long_ = sorted((self.key, o.key), key=len)
        return s <= t or t <= s or len(short) >= 4 and short in long_ or jaccard(grams(self.tokens), grams(o.tokens)) >= 0.5


def one_place(a, b):
    if a["zip"] and b["zip"] and a["zip"] != b["zip"]:
        return False
    m = metres(a["at"], b["at"])
    x, y = a["name"], b["name"]
    if x.key and x.key == y.key or x.plain == y.plain and len(x.plain) >= 3:
        key = x.key if x.key == y.key else x.plain.replace(" ", "")
        if key in names.GENERIC_KEYS:
            return m is not None and m < 60
        if len(key) < 4:
            return m is not None and m < 60 or bool(a["zip"] and a["zip"] == b["zip"] and (m is None or m < 1500))
        return m is None or m < 1500
    return m is not None and m < 60 and x.compatible(y)


def are_apart(a, b):
    m = metres(a["at"], b["at"])
    return bool(a["zip"] and b["zip"] and a["zip"] != b["zip"]) or m is not None and (m >= 1500 or m < 60 and not one_place(a, b))


def linked(rows, spark):
    """The greedy choice, link by link in the order of kind and hash; that order is the one thing taken from Spark."""
    by_id = {r[0]: {"zip": r[2], "at": (r[3], r[4]), "name": Name(r[1])} for r in rows}
    ids = sorted(by_id)
    kinds = {}
    for i in ids:
        r = next(x for x in rows if x[0] == i)
        kinds.setdefault(r[1:5] if one_place(by_id[i], by_id[i]) else i, []).append(i)
    node = {i: min(g) for g in kinds.values() for i in g}
    nodes = sorted(set(node.values()))
    pairs = [(0 if (x := by_id[a]["name"]).key and x.key == by_id[b]["name"].key or x.plain == by_id[b]["name"].plain and len(x.plain) >= 3 else 1, a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if one_place(by_id[a], by_id[b])]
    ordered = spark.createDataFrame(pairs, "k int, a long, b long").orderBy("k", F.xxhash64("a", "b"), "a", "b").collect() if pairs else []
    group = {n: {n} for n in nodes}
    for _, a, b in ordered:
        g, h = group[a], group[b]
        if g is not h and not any(are_apart(by_id[x], by_id[y]) for x in g for y in h):
            for n in (whole := g | h):
                group[n] = whole
    return {frozenset(i for i in ids if node[i] in g) for g in {frozenset(g) for g in group.values()}}


def grouped(spark, rows):
    got = {r.alias: r.canonical for r in linking.link_venues(spark.createDataFrame(rows, VENUE)).collect()}
    out = {}
    for r in rows:
        out.setdefault(got.get(r[0], r[0]), set()).add(r[0])
    return {frozenset(g) for g in out.values()}


T = datetime(2025, 1, 1, tzinfo=UTC)
#: names of one place and of others near by, after the kinds of cases that a catalogue of halls has
PLACES = [
    (1, "42Nord", "75004", 48.8564, 2.3564, 69), (2, "42Nord Jazz Club", "75004", 48.8564, 2.3564, 129), (3, "42 NORD - Jazz Club & Bar", "75004", None, None, 31),
    (4, "LUCARNE THEATRE ANNE VALMY", None, None, None, 0), (5, "Lucarne Théâtre Anne-Valmy", "75009", 48.8722, 2.3292, 51),
    (6, "La Rive Sonore", "92100", 48.8241, 2.2326, 101), (7, "Rive Sonore", "92100", 48.8265, 2.2329, 50), (8, "La Rive Sonore à Boulogne-sur-Mer", None, None, None, 17),
    (9, "La Rive Sonore - Auditorium", None, None, None, 31), (10, "La Rive Sonore - Grande Rive", "92100", 48.8338, 2.2433, 26), (11, "La Rive Sonore - Pianos Orlan", "92100", 48.8262, 2.2294, 5),
    (12, "Valogne", "75008", None, None, 3), (13, "Studio Valogne", "75008", None, None, 3), (14, "Théâtre Valogne", "75008", 48.8692, 2.3137, 14), (15, "THEATRE VALOGNE - STUDIO VALOGNE", "75008", 48.8778, 2.3163, 95), (16, "ORSETTI - THEATRE VALOGNE", None, None, None, 0),
    (17, "Midnight", "75001", 48.859937, 2.347751, 26), (18, "Midside", "75001", 48.859937, 2.347751, 49), (19, "Midnight Midside", "75001", 48.859935, 2.34776, 1), (20, "Le Midnight/Midside", "75001", 48.859865, 2.347731, 32), (21, "MIDSIDE JAZZ CLUB", None, None, None, 0),
    (22, "Théâtre 84", "92240", None, None, 21), (23, "Théâtre 84 Scène Nationale", "92240", None, None, 8), (24, "Théâtre 84, scène nationale de Valcour", "92240", 48.8208, 2.3016, 1), (25, "Valcour scène nationale – Théâtre 84", None, None, None, 18),
    (26, "Place du Donjon", "", 48.857584, 2.346989, 0), (27, "Théâtre du Donjon", "75001", 48.857614, 2.346758, 108), (28, "Métro Donjon", "75001", None, None, 1), (29, "Sur les Berges de Loire, Rampe Donjon", "75004", 48.856895, 2.350849, 1),
    (30, "Café Roo Donjon - The Australian Bar", "75001", 48.859443, 2.348015, 15), (31, "Silver Comedy Donjon", "75004", 48.859814, 2.35069, 2), (32, "THEATRE LYRIQUE DU DONJON (TLD)", None, None, None, 0),
    (33, "Médiathèque", None, None, None, 1), (34, "Médiathèque", None, None, None, 2), (35, "Galerie", "75003", 48.86, 2.36, 1), (36, "Galerie Satin", "75003", 48.86, 2.36, 1),
]


def test_places_that_are_one_and_places_that_are_not(spark):
    rows = [(*r, T) for r in PLACES]
    got = {r.alias: r.canonical for r in linking.link_venues(spark.createDataFrame(rows, VENUE)).collect()}
    assert {k: got.get(k) for k in (1, 3, 4, 7, 8, 12, 13, 14, 19, 20, 21, 23, 24)} == {1: 2, 3: 2, 4: 5, 7: 6, 8: 6, 12: 15, 13: 15, 14: 15, 19: 18, 20: 18, 21: 18, 23: 22, 24: 25}
    assert not set(got) & {9, 10, 11, 16, 17, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36}
    assert not set(got.values()) & set(got)
    assert grouped(spark, rows) == linked(rows, spark)


def test_the_canonical_one_and_links_made_by_hand(spark):
    old, new = T, T + timedelta(days=300)
    rows = [(1, "Le Pan Musical", "75011", None, None, 5, old), (2, "Pan Musical", "75011", 48.86, 2.38, 5, new), (3, "PAN MUSICAL PARIS", None, None, None, 5, old)]
    link = lambda x: {r.alias: r.canonical for r in linking.link_venues(x).collect()}
    assert link(spark.createDataFrame(rows, VENUE)) == {1: 2, 3: 2}
    rows[0] = (*rows[0][:5], 9, old)
    assert link(spark.createDataFrame(rows, VENUE)) == {2: 1, 3: 1}
    held = spark.createDataFrame(rows, VENUE).withColumn("canonical_venue_id", F.when(F.col("id") == 3, 77))
    assert link(held) == {2: 1}
    assert link(spark.createDataFrame([], VENUE)) == {}
    odd = [(1, None, None, None, None, None, None), (2, "", "x", 48.0, None, 1, T), (3, "!", None, 91.0, 2.0, 1, T)]
    assert link(spark.createDataFrame(odd, VENUE)) == {}


@pytest.mark.parametrize("seed", range(3))
def test_rounds_decide_as_the_loop_does(spark, monkeypatch, seed):
    """Random names, post codes and places in a few streets: many vetoes, chains and crowded cells."""
    monkeypatch.setattr(linking, "HOT", 4)
    rng = random.Random(seed)
    words = ["alpha", "bravo", "charlie", "delta", "club", "theatre", "12", "14", "place", "galerie"]
    rows = []
    for i in range(130):
        name = rng.choice([" ", " ", " - "]).join(rng.choice(words) for _ in range(rng.choice([1, 2, 2, 3])))
        at = (48.85 + rng.choice([0, 0, 0.0003, 0.006, 0.02]) + rng.random() * 2e-4, 2.35 + rng.random() * 4e-4) if rng.random() < 0.7 else (None, None)
        rows.append((i, name, rng.choice([None, None, "75001", "75002"]), *at, i, T))
    rows += [(200 + i, *rows[i][1:]) for i in range(0, 130, 9)]
    assert grouped(spark, rows) == linked(rows, spark)


def test_a_hundred_thousand_venues_of_one_name(spark):
    """A street of 400 spots, 250 venues a spot: one component, whose groups end where it gets too long."""
    v = spark.range(100_000).select("id", F.lit("Salle Zephyr").alias("name"), F.lit(None).cast("string").alias("zip_code"), (48.8 + (F.col("id") % 400) * 0.001).alias("lat"), F.lit(2.3).alias("lng"), F.col("id").alias("n_events"), F.lit(T).alias("created_at"))
    got = linking.link_venues(v).join(v.select(F.col("id").alias("alias"), "lat"), "alias").groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.min("lat").alias("lo"), F.max("lat").alias("hi")).collect()
    assert sum(r.n for r in got) + len(got) == 100_000
    assert 400 / 14 <= len(got) <= 150 and all((r.hi - r.lo) * 111_195 < 1500 for r in got)


# ---------------------------------------------------------------- duplicates

OUTING = "id long, source string, title string, start_date timestamp, day_first date, day_last date, time_known boolean, venue long, venue_name string, zip_code string, lat double, lng double, status string, quality_score int, created_at timestamp"


def _outings(n, seed, venues=3):
    rng = random.Random(seed)
    words = ["nuit", "electro", "jazz", "quartet", "monet", "lumiere", "grand", "bal"]
    spots = [(v, rng.choice(["Alpha Hall", "Le Alpha Hall", "Bravo", "Bravo 12"]), rng.choice([None, "75001", "75002"]), *((48.85 + rng.choice([0, 0.001, 0.02]), 2.35) if rng.random() < 0.7 else (None, None))) for v in range(venues)]
    out = []
    for i in range(n):
        start = T + timedelta(days=rng.choice([0, 0, 1, 2, 40, 41]), minutes=rng.choice([0, 0, 30, 200]))
        last = start + timedelta(days=rng.choice([0, 0, 0, 3, 50]))
        v, name, zip_code, lat, lng = rng.choice(spots)
        title = " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3])))
        out.append((i, f"s{rng.randrange(3)}", title, start, start.date(), last.date(), rng.random() < 0.7, rng.choice([v, v, None]), name, zip_code, lat, lng, "active", rng.randrange(100), start))
    out += [(n + i, *out[i][1:]) for i in range(0, n, 11)]
    return [*out, (5000, "s0", "jazz", None, None, None, True, 0, None, None, None, None, "active", 1, T), (5001, "s1", None, T, T.date(), None, None, 0, None, None, None, None, "active", None, None)]


def same_outing(a, b):
    if a[1] == b[1] or a[4] is None or b[4] is None or not (a[4] <= max(b[5] or b[4], b[4]) and b[4] <= max(a[5] or a[4], a[4])):
        return False
    sim = jaccard(*(grams(w for w in (x[2] or "").split() if w not in text.TITLE_NOISE) for x in (a, b)))
    m = metres((a[10], a[11]), (b[10], b[11]))
    if a[7] is not None and a[7] == b[7] or m is not None and m < 150:
        return sim > 0.55
    slot = a[4] == b[4] and (not (a[6] and b[6]) or abs(a[3] - b[3]) <= timedelta(minutes=45))
    return slot and sim >= 0.8 and not (a[9] and b[9] and a[9] != b[9]) and not (m is not None and m > 1500) and Name(a[8] or "").compatible(Name(b[8] or ""))


def _blocked(a, b):
    """Pairs of the second rule also need a word of the venue's name, or the key, in common, and one day each."""
    if a[7] is not None and a[7] == b[7] or (m := metres((a[10], a[11]), (b[10], b[11]))) is not None and m < 150:
        return True
    x, y = Name(a[8] or ""), Name(b[8] or "")
    return a[4] == a[5] and b[4] == b[5] and bool({*x.tokens, x.key} & {*y.tokens, y.key})


@pytest.mark.parametrize(("seed", "hot"), [(0, 1), (1, 1), (2, 64)])
def test_no_pair_is_lost_in_hot_keys(spark, monkeypatch, seed, hot):
    rows = _outings(160, seed)
    monkeypatch.setattr(resolution.overlapping_pairs, "__defaults__", (resolution.SIMILAR, hot, 32))
    got = {tuple(r) for r in resolution.duplicate_pairs(spark.createDataFrame(rows, OUTING)).collect()}
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and same_outing(a, b) and _blocked(a, b)}
    assert got


def test_duplicates_by_components(spark):
    rows = _outings(120, 5)
    edges = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and same_outing(a, b) and _blocked(a, b)]
    group = {r[0]: {r[0]} for r in rows}
    for a, b in edges:
        for n in (whole := group[a] | group[b]):
            group[n] = whole
    by_id, want = {r[0]: r for r in rows}, set()
    for g in {frozenset(x) for x in group.values() if len(x) > 1}:
        sources = [by_id[i][1] for i in g]
        ranged = [i for i in g if by_id[i][4] != by_id[i][5]] if len(set(sources)) < len(sources) else []
        best = max(ranged or g, key=lambda i: (by_id[i][13] or 0, -by_id[i][14].timestamp(), i))
        want |= {(i, best) for i in g if i != best}
    assert {tuple(r) for r in resolution.duplicates(spark.createDataFrame(rows, OUTING)).collect()} == want


def test_a_venue_with_a_hundred_thousand_outings(spark):
    """Pairs that are judged grow as the rows do, and the planted ones are found."""
    n = 100_000
    k = F.col("id")
    title = F.concat(F.substring(F.sha1((k % (n - 500)).cast("string")), 1, 7), F.lit(" "), F.substring(F.sha1((k % (n - 500)).cast("string")), 9, 6))
    day = F.date_add(F.lit(T.date()), (k % 500 % 300).cast("int"))
    rows = spark.range(n).select("id", F.concat(F.lit("s"), (k >= n - 500).cast("int").cast("string")).alias("source"), F.transform(F.array(title), text.trigrams)[0].alias("grams"), F.array(F.lit("v|1")).alias("left"), F.array(F.lit("v|1")).alias("right"), F.unix_date(day).alias("first"), F.unix_date(day).alias("last"))
    pairs = resolution.overlapping_pairs(rows).collect()
    assert {(i, n - 500 + i) for i in range(500)} <= {tuple(p) for p in pairs}
    assert len(pairs) < n
