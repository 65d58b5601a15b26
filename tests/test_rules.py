"""Cleanup rules on odd rows, samples of sources, components on both sides of their bound, letters of other scripts."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import cleanup, discovery, graph

NOW = datetime(2026, 10, 7, 12, tzinfo=UTC)


def test_rules_act_in_order_and_say_so(spark):
    rows = [
        (1, "paris_opendata", "Bal", "active", datetime(2027, 1, 5, 19), None, ["x"], "ok", False), (2, "x", "Concert annulé ce soir", "draft", datetime(2027, 1, 5, 19), None, None, None, False), (3, "x", "ANNULÉ - Bal", "active", datetime(2027, 1, 5, 19), None, [], None, True),
        (4, "x", "Le mariage annulé", "active", datetime(2027, 1, 5, 19), None, [], None, None), (5, None, None, None, None, None, None, None, None), (6, "lebonbon", "Dix bars", "active", datetime(2020, 1, 1), None, [], None, False),
    ]
    d = spark.createDataFrame(rows, "id long, source string, title string, status string, start_date timestamp_ntz, end_date timestamp_ntz, reasons array<string>, Cleaned_By string, has_activity boolean")
    got = {r.id: r for r in cleanup.cleaned(d, cleanup.rules(NOW)).collect()}
    assert {i: (r.status, r.reasons, r.cleaned_by) for i, r in got.items()} == {
        1: ("active", ["x", "tz_fixed"], ["zone_of_open_data"]), 2: ("cancelled", ["title_cancelled"], ["called_off"]), 3: ("active", [], []), 4: ("active", [], []), 5: (None, [], []), 6: ("rejected", ["editorial_not_event"], ["expired", "editorial"]),
    }
    assert got[1].start_date == datetime(2027, 1, 5, 18)
    again = cleanup.cleaned(cleanup.cleaned(d, cleanup.rules(NOW)), cleanup.rules(NOW))  # a rule that left its reason does not act again
    assert {r.id: r.reasons for r in again.collect()} == {i: r.reasons for i, r in got.items()}
    assert sorted(map(tuple, cleanup.counts(cleanup.cleaned(d, cleanup.rules(NOW))).collect())) == [("called_off", 1), ("editorial", 1), ("expired", 1), ("zone_of_open_data", 1)]
    assert cleanup.cleaned(d.limit(0), cleanup.rules(NOW)).collect() == []


def test_samples_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 40).cast("string"))).alias("source"))
    take = lambda d: {(r.source, r.k) for r in discovery.sampled(d, "source", "k", 50).collect()}
    assert take(rows) == take(rows.repartition(7)) and max(sum(s == x for s, _ in take(rows)) for x in ("big", "s1")) == 50
    sample = spark.createDataFrame([("a", "in", True, True, False)] * 60 + [("a", "out", True, True, False)] * 40 + [("b", None, None, None, None), ("c", "in", True, False, False)], "source string, zone string, cultural boolean, official boolean, cultural_name boolean")
    got = {r.source: r for r in discovery.judged(sample, "source").collect()}
    assert {s: (r.mode, r.reason) for s, r in got.items()} == {"a": ("all", "in the zone"), "b": (None, "nothing in the zone"), "c": (None, "too few rows")}
    assert 0.49 < got["a"].least_share < 0.6 and got["b"].least_share == 0 and discovery.margin(100) < 0.1


@pytest.mark.parametrize("few", [0, 5, 100_000])
@pytest.mark.parametrize("shape", ["chain", "star", "hubs", "random"])
def test_components_on_both_sides_of_the_bound(spark, few, shape):
    rng = random.Random(1)
    name = lambda i: f"n{i:04d}"
    edges = {
        "chain": [(i, i + 1) for i in range(120)], "star": [(0, i) for i in range(1, 120)], "hubs": [(h * 50, h * 50 + i) for h in range(3) for i in range(1, 40)] + [(0, 50)],
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(110)],
    }[shape]
    edges = [(name(a), name(b)) for a, b in edges] + [(None, "n0001"), ("n0001", "n0001")]
    root = {n: n for e in edges for n in e if n}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and (x := find(a)) != (y := find(b)):
            root[max(x, y)] = min(x, y)
    ends = {n for a, b in edges if a and b and a != b for n in (a, b)}
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a string, b string"), few=few).collect()}
    assert got == {n: find(n) for n in ends}


def test_letters_of_other_scripts(spark):
    cases = {"Жанна Щукина": "zhanna shchukina", "ΘΈΑΤΡΟ ψυχή": "theatro psukhe", "東京": "", "Été & Œuvre": "ete et oeuvre", "Большой": "bol shoi", None: None}
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(text.words_of(F.col("c")).alias("w")).collect()
    assert [r.w for r in rows] == list(cases.values())


def test_artists_of_titles_and_sources(spark):
    """Names, programmes, genres, composers and phrases; source names first; the venue is no artist."""
    none = None
    cases = [
        ("Zolan Ferr x Mira Quay", "concerts", none, none, [("Zolan Ferr", "title"), ("Mira Quay", "title")]), ("Deathcal + special guests : Fungo", "soirees", none, none, [("Deathcal", "title"), ("Fungo", "title")]), ("Zolan Ferr x Mira Quay", "theatre", none, none, []), ("Zolan Ferr", none, none, none, []),
        ("Eaux of Deep Metal", "concerts", none, none, [("Eaux of Deep Metal", "title")]), ("Jazz from Nowhere", "concerts", none, none, []), ("Bach, Liszt & Odile Brandt", "concerts", none, none, [("Odile Brandt", "title")]), ("Autour de minuit", "concerts", none, none, []), ("Boum 1986", "concerts", none, none, []),
        ("Lost + Baratin", "concerts", none, "Baratin", [("Lost", "title")]), ("Pop - les Classiques", "concerts", ["Charles Vent", "charles vent", "TBA", "Halle Nord", None, "x" * 130], "Halle Nord", [("Charles Vent", "source")]), ("Maître Mou", "theatre", ["Hilde Besson"], none, [("Hilde Besson", "source")]),
        ("Zolan Ferr", "concerts", ["No Information"], none, [("Zolan Ferr", "title")]), (none, "concerts", none, none, []), ("", "concerts", [], "", []), ("a + b + " * 4000, "concerts", none, none, []), ("Leo Odin, JR.", "concerts", none, none, [("Leo Odin JR.", "title")]), ("Lot @ la Grange", "concerts", none, none, [("Lot", "title")]),
    ]
    from marquee.functions import artists

    rows = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, title string, category string, given array<string>, venue string")
    got = {r.i: [(a.name, a.origin) for a in r.a] for r in rows.select("i", artists.of_outing(F.col("title"), F.col("category"), F.col("given"), F.col("venue")).alias("a")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}
