"""What the findings of a review showed: each of these failed before its finding was settled."""

import pytest
from pyspark.sql import functions as F

from marquee.functions import text, titles
from marquee.operators import quality, resolution


def test_url_rules_of_the_contract(spark):
    pytest.importorskip("public_tokenizers")
    from marquee.llm import queries, url_filters

    assert queries.URL_RULES == [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
    pages = [(1, "http://a.net/de/1", None), (2, "http://x.example.net/de/80", None), (3, "http://a.com/en/1", None), (4, "http://example.com/en/7", None), (5, "http://o.org/es/", None)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("com/en/", "block"), 4: ("example.com/en/7", "allow"), 5: ("org/es/", "block")}


def test_truncated_before_a_line_break(spark):
    """The end of the cut is its last character, a line break or not."""
    cases = [("Hawhre there.\nmore", 15, "Hawhre there.…"), ("one two more words", 9, "one…"), ("one\x0btwo three four", 9, "one\x0btwo…"), ("one two", 7, "one two"), (None, 5, None)]
    for given, n, want in cases:
        df = spark.createDataFrame([(given,)], "x string")
        assert df.select(text.truncated(F.col("x"), n)).first()[0] == want, given


def test_promoted_once(spark):
    """Fifteen points are given once, also where the status is decided."""
    rows = [(1, 30, "draft"), (2, 35, "draft"), (3, 34, "draft"), (4, 90, "active")]
    df = spark.createDataFrame(rows, "id long, score int, status string").withColumns({"soft": F.array(F.lit("venue_not_geocoded")), "hard": F.array().cast("array<string>"), "lat": F.lit(48.86)})
    assert sorted((r.id, r.score, r.status, r.soft) for r in quality.promoted(df).collect()) == [(1, 45, "draft", []), (2, 50, "active", []), (3, 49, "draft", []), (4, 100, "active", [])]


def test_every_mark_goes(spark):
    """Of several marks before colons or in brackets none is left."""
    cases = [("Le concert est annulé : Forum 0 annulée : demain", "Le concert est : Forum 0 : demain", True, False), ("Bal [COMPLET] (annulé) [COMPLET] ici", "Bal ici", True, True)]
    for given, want, *says in cases:
        f = spark.createDataFrame([(given,)], "x string").select(titles.flagged(F.col("x")).alias("f")).first().f
        assert (f.clean, f.cancelled, f.sold_out) == (want, *says)
        assert spark.createDataFrame([(given,)], "x string").select(titles.for_matching(F.col("x")).alias("t")).first().t == want


def test_marks_at_the_ends_all_go(spark):
    """more than two marks before or after a title, too."""
    cases = [("Complet - annulé : sold out - complet / Bal", "Bal", True, True), ("Bal - complet, sold out ! | complet - sold out", "Bal", False, True), ("Annulé - complet - annulé - Bal - complet - annulé - complet", "Bal", True, True), ("Complet - Bal : annulé", "Bal", True, True), ("Complet - complet - complet", "complet", False, True)]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", titles.flagged(F.col("x")).alias("f"), titles.for_matching(F.col("x")).alias("t")).orderBy("i").collect()
    for r, (_, want, *says) in zip(rows, cases, strict=True):
        assert (r.f.clean, r.t, r.f.cancelled, r.f.sold_out) == (want, want, *says), r


_KEYED = "with k as (select c_custkey, unnest([c_mktsegment || c_nationkey, round(c_acctbal / 100)::bigint::varchar]) k from customer) select distinct a.c_custkey a, b.c_custkey b from k a join k b on a.k = b.k and a.c_custkey < b.c_custkey"


def test_classes_lose_no_pair(spark):
    """Pairs of representatives and members, spelled out, are all pairs of rows that share a key."""
    from marquee.operators import resolution
    from marquee.plans import registry

    from .oracle import connect

    def spelled(found):
        of, linked = {}, set()
        for r in found:
            if r.member:
                of.setdefault(r.a, {r.a}).add(r.b)
        for r in found:
            if not r.member:
                linked |= {(min(x, y), max(x, y)) for x in of.get(r.a, {r.a}) for y in of.get(r.b, {r.b})}
        return linked | {(x, y) for xs in of.values() for x in xs for y in xs if x < y}

    sf = "/root/testdata/sf0.01"
    assert spelled(registry.QUERIES["er_06_blocking_pairs"](spark, sf).collect()) == set(connect(sf).execute(_KEYED).fetchall())
    copies = spark.range(3000).select("id", F.lit("one").alias("x"), F.lit(None).cast("string").alias("y"))
    assert resolution.class_pairs(copies, ["x", "y"], F.array("x")).count() == 2999
    for name, rule in (("er_02_compatible_names", "compatible"), ("er_03_place_pairs", "all")):
        found = registry.QUERIES[name](spark, sf).collect()
        assert any(r.member for r in found)
        ids = {x for r in found for x in (r.a, r.b)}
        if rule == "all":  # every two venues of a block
            assert spelled(found) == {(x, y) for x in ids for y in ids if x < y and x % 50 == y % 50}


def test_title_items_once(spark):
    """A member who follows several keys of a title gets it once, from whichever was followed before it came; followed for a second time counts from the first."""
    from datetime import UTC, datetime

    from marquee.operators import members

    day = lambda n: datetime(2026, 1, n)
    follows = spark.createDataFrame([(1, "jazz", day(1)), (1, "soiree jazz", day(20)), (2, "jazz", day(20)), (2, "soiree jazz", day(1)), (3, "jazz", day(20)), (4, "jazz", None), (5, None, day(1)), (6, "jazz", day(20)), (6, "jazz", day(2)), (7, "metal", day(1))], "user_id long, artist_key string, followed_at timestamp_ntz")
    outings = spark.createDataFrame([(1, "Soirée jazz", "concerts", day(25), day(10), "active", None), (2, "Jazz", "expos", day(25), day(10), "active", None)], "id long, title string, category_slug string, start_date timestamp_ntz, created_at timestamp_ntz, status string, canonical_id long")
    none = spark.createDataFrame([], "id long")
    got = members.title_items(follows, outings, none, datetime(2026, 1, 12, tzinfo=UTC))
    assert sorted((r.user_id, r.id) for r in got.collect()) == [(1, 1), (2, 1), (6, 1)]
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Aggregate" not in top  # not a row for each key, told apart afterwards


def test_title_items_by_runs_of_dates(spark, monkeypatch):
    """Members meet dates run by run: with short runs and many shares the items are those of the plain loop; the next member comes soon, so that a file's ids repeat at a short distance."""
    import random
    from datetime import UTC, datetime, timedelta
    from itertools import groupby

    from marquee.operators import members

    first, rng = datetime(2026, 1, 1), random.Random(3)
    schema, dated = "user_id long, artist_key string, followed_at timestamp_ntz", "id long, title string, category_slug string, start_date timestamp_ntz, created_at timestamp_ntz, status string, canonical_id long"
    none, now = spark.createDataFrame([], "id long"), datetime(2026, 1, 1, tzinfo=UTC)
    hour = lambda n: first + timedelta(hours=n)
    keys, said = ["jazz", "soiree jazz", "metal", "jazz metal"], ["Soirée jazz", "Jazz metal", "Metal", "Du jazz", "Opéra"]
    follows = [(u, rng.choice(keys), hour(rng.randrange(50))) for u in range(40) for _ in range(rng.randrange(4))]
    outings = [(i, rng.choice(said), "concerts", hour(500 + i // 2), hour(i // 2), "active", None) for i in range(90)]
    has = lambda title, key: f" {key} " in f" {title.lower().replace('é', 'e')} "
    want = {(u, o[0], o[3]) for u, key, at in follows for o in outings if has(o[1], key) and o[4] > at}
    args = spark.createDataFrame(follows, schema), spark.createDataFrame(outings, dated), none, now
    for run, share in ((512, 1 << 20), (4, 8)):
        monkeypatch.setattr(members, "RUN", run, raising=False)
        monkeypatch.setattr(members, "SHARE", share, raising=False)
        assert sorted((r.user_id, r.id, r.start_date) for r in members.title_items(*args).collect()) == sorted(want)
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more members and dates than a broadcast holds
    try:
        follows = spark.range(40).selectExpr("id user_id", "'jazz' artist_key", "timestamp_ntz '2026-01-01' followed_at")
        outings = spark.range(3000).selectExpr("id", "'Jazz' title", "'concerts' category_slug", "timestamp_ntz '2026-02-01' + make_dt_interval(0, 0, int(id)) start_date", "timestamp_ntz '2026-01-02' created_at", "'active' status", "cast(null as long) canonical_id")
        met = [r.user_id for r in members.title_items(follows, outings, none, now).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(met) == 40 * 3000 and max(len(list(g)) for _, g in groupby(met)) <= 512


def test_objects_are_read_once(spark):
    """No filter or second branch of the plan parses the objects of a page again."""
    from marquee.plans import registry

    plan = registry.QUERIES["src_10_tourism"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") + plan.lower().count("parse_json") == 1, plan.lower().count("parsejson")


@pytest.mark.parametrize(("hot", "many"), [(1, 1), (1, 512), (64, 512)])
def test_pairs_of_a_key_are_alike(spark, hot, many):
    """what leaves the join of a key is judged, so no titles are sent along with pairs that differ."""
    titles = ["nuit du jazz 1", "nuit du jazz 2", "bal des pompiers", "visite du jardin"]
    rows = spark.createDataFrame([(i, f"s{i % 3}", titles[i % 4], 10 * (i // 12), 10 * (i // 12) + 70 * (i % 2)) for i in range(48)], "id long, source string, title string, first int, last int")
    keyed = rows.select("id", "source", "first", "last", text.trigrams(F.col("title")).alias("grams"), F.array(F.lit("p|1")).alias("left"), F.array(F.lit("p|1"), F.lit("p|2")).alias("right"))
    got = [tuple(p) for p in resolution.overlapping_pairs(keyed, resolution.SIMILAR, hot, 32, many=many).collect()]
    alike = lambda a, b: titles[a.id % 4] == titles[b.id % 4] or {a.id % 4, b.id % 4} == {0, 1}
    each = rows.collect()
    assert sorted(got) == [(a.id, b.id) for a in each for b in each if a.id < b.id and a.source != b.source and a.first <= b.last and b.first <= a.last and alike(a, b)]


def test_texts_are_folded_once_for_an_index(spark):
    """the folded text is no part of what is done for each run of three characters."""
    from marquee.operators import search_index

    df = spark.createDataFrame([(1, "Théâtre"), (2, "né"), (3, None)], "id long, x string")
    got = df.select("id", search_index.grams(text.fold(F.col("x"))).alias("grams"))
    assert {r.id: r.grams for r in got.collect()} == {1: ["the", "hea", "eat", "atr", "tre"], 2: [], 3: []}
    assert got._jdf.queryExecution().optimizedPlan().toString().lower().count("translate(") == 1
