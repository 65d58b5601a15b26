"""What is kept between runs, pages of sites, and alerts that go on for members who lack some."""

from __future__ import annotations

import json
import os
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import drops, members, search_index
from marquee.plans.stores import SELECTORS
from marquee.sources import listing_pages, tourism

WEEK, NOW = date(2026, 10, 5), datetime(2026, 10, 7, 12, tzinfo=UTC)


def picks(spark, rows):
    return spark.createDataFrame(rows, "user_id long, id long, pos int")


def given(df):
    return {r.user_id: r.ids for r in df.collect()}


def test_a_drop_is_given_once_a_week(spark, tmp_path):
    at = f"file://{tmp_path}"
    first = [(1, 10 * p, p) for p in range(1, 8)] + [(2, 5, 1), (2, 5, 1), (2, 6, 1)]
    assert given(drops.give(picks(spark, first), at, WEEK)) == {1: [10, 20, 30, 40, 50], 2: [5, 6]}
    again = [(1, 99, 1), (2, 98, 1), (3, 97, 1)]
    assert given(drops.give(picks(spark, again), at, WEEK)) == {1: [10, 20, 30, 40, 50], 2: [5, 6], 3: [97]}
    assert given(drops.give(picks(spark, []), at, WEEK)) == given(drops.stored(spark, at, WEEK))
    assert given(drops.stored(spark, at, WEEK + timedelta(days=7))) == {}
    assert given(drops.give(picks(spark, again[:1]), at, WEEK + timedelta(days=7))) == {1: [99]}


def test_a_run_that_was_lost_leaves_nothing(spark, tmp_path):
    """Files of a run that was not committed are not read; one done again gives what it would have given."""
    at = f"file://{tmp_path}"
    lost = tmp_path / f"week={WEEK}" / "run=00000000000000000001-lost"
    spark.createDataFrame([(1, [666])], drops.SCHEMA).write.parquet(f"file://{lost}")
    os.remove(lost / "_SUCCESS")
    assert given(drops.stored(spark, at, WEEK)) == {}
    assert given(drops.give(picks(spark, [(1, 7, 1)]), at, WEEK)) == {1: [7]}
    # a run beside it that gave to the same member, later: the earlier one counts
    spark.createDataFrame([(1, [8]), (4, [9])], drops.SCHEMA).write.parquet(f"{at}/week={WEEK}/run=99999999999999999999-late")
    assert given(drops.stored(spark, at, WEEK)) == {1: [7], 4: [9]}


def test_a_task_that_fails_half_way_does_not_change_a_drop(spark, tmp_path):
    at = f"file://{tmp_path}"
    fail = F.udf(lambda x: 1 // (x - 3), "int")
    with pytest.raises(Exception, match="ZeroDivision"):
        drops.give(picks(spark, [(i, i, 1) for i in range(8)]).withColumn("pos", fail("id")), at, WEEK)
    assert given(drops.stored(spark, at, WEEK)) == {}
    assert given(drops.give(picks(spark, [(3, 1, 1)]), at, WEEK)) == {3: [1]}


def test_what_is_left_of_a_drop(spark):
    rows = spark.createDataFrame([(1, [3, 1, 2, 9]), (2, [1])], drops.SCHEMA)
    o = spark.createDataFrame([(1, NOW - timedelta(days=2), None), (2, NOW + timedelta(days=1), None), (3, NOW - timedelta(days=9), NOW + timedelta(days=1))], "id long, start_date timestamp, end_date timestamp")
    o = o.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_date", "end_date")})
    assert sorted(map(tuple, drops.shown(rows, o, NOW).collect()), key=repr) == [(1, 0, 3, 1), (1, 1, 2, 1), (2, None, None, 1)]
    assert spark.range(1).select(drops.week_start(F.lit("2026-10-04 22:30:00").cast("timestamp_ntz")).alias("w")).first().w == WEEK  # Monday in Paris


def test_the_index_finds_what_a_scan_finds(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.createDataFrame([(i, x, i % 3, f"Salle {'Jazz' if i % 3 else 'Été'}") for i, x in enumerate(["Nuit du métal", "Metallos", "jazz & rock", None, "", "ja", "ajazza", "Un été à Paris", "metal jazz", "étés"] * 3)], "id long, x string, venue_id long, venue string")
    fields = [("texts", "id", text.fold(F.col("x"))), ("names", "venue_id", text.fold(F.col("venue")))]
    search_index.rebuild(rows, fields[0][2], at, "texts")
    search_index.rebuild(rows.select(F.col("venue_id").alias("id"), "venue").distinct(), fields[1][2], at, "names")
    for tokens in (["metal"], ["jazz"], ["ete"], ["paris", "ete"], ["nowhere"], ["jazz", "metal"], ["ja"], []):
        want = rows
        for t in tokens:
            want = want.where(F.coalesce(text.token_match(fields[0][2], t), F.lit(False)) | F.coalesce(text.token_match(fields[1][2], t), F.lit(False)))
        got = search_index.matching(rows, fields, tokens, at)
        assert got.columns[0] == "id" and sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), tokens
    plan = search_index.current(spark, at, "texts").where("folder = 3 and gram = 'jaz'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan and "EqualTo(gram,jaz)" in plan


def test_a_rebuild_that_shrinks_too_far_is_refused(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = spark.range(400).select("id", F.lit("une longue nuit").alias("x"))
    search_index.rebuild(rows, F.col("x"), at, "i")
    with pytest.raises(ValueError, match="would replace"):
        search_index.rebuild(rows.limit(50), F.col("x"), at, "i")
    assert search_index.candidates(spark, at, "i", "nuit").count() == 400
    search_index.rebuild(rows.where("id < 150"), F.col("x"), at, "i")
    assert search_index.candidates(spark, at, "i", "nuit").count() == 150


# ---------------------------------------------------------------- texts and pages


def said(value, language=None, out=None):
    """The recursive walk, value by value: (other language, text) in order."""
    out = [] if out is None else out
    if isinstance(value, bool) or value is None:
        return out
    if isinstance(value, (str, int, float)):
        if str(value).strip():
            out.append((language not in (None, "fr"), str(value).strip()))
    elif isinstance(value, list):
        for x in value:
            said(x, language, out)
    elif "@value" in value:
        said(value["@value"], value.get("@language") or language, out)
    elif not ("@id" in value and len(value) <= 2):
        import re

        for k in sorted(value):
            if re.fullmatch(r"@?[a-z]{2}(-[A-Za-z]{2})?|@none", k):
                said(value[k], None if k == "@none" else k.lstrip("@")[:2], out)
    return out


def test_texts_of_any_depth(spark):
    deep = "unten"
    for i in range(30):
        deep = [{"@value": deep}] if i % 3 else {"de": deep}
    cases = ["x", "", 7, 1.5, True, None, [], {}, {"fr": ["a", "b"], "en": "c"}, [[["d"]], {"@id": "u", "name": "n"}, {"@id": "u", "fr": "e", "x": "f"}, {"@none": "g"}], {"@value": {"@value": ["h", {"en": "i"}]}, "@language": "de"}, {"@fr-FR": [[" j "]], "xyz": "k", "@en": {"fr": "l"}}, deep, ["[{", {"en": '}"]'}]]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(cases)] + [(99, None)], "i int, v string").select("i", tourism.texts(F.parse_json("v")).alias("t"))
    got = {r.i: r.t for r in rows.collect()}
    assert {i: got[i] for i in range(len(cases))} == {i: [t for o, t in sorted(said(v), key=lambda x: x[0])] for i, v in enumerate(cases)}
    assert not got[99]


PAGE = """<!DOCTYPE html><body><nav><ul><li><a href=/a>Un</a><li><a href=/b>Deux</a><li><a href=/c>Trois</a></ul></nav>
<ul class=list><li><a href="e/1">Premier &amp; seul</a> une soirée <i>longue</i><br>12/10/2026<li><a href="e/2">Deuxième</a> une soirée encore<p>13/10/2026
<li>Sans lien, une annonce quelconque<li><a href="e/3">Troisième</a> une autre soirée<script>if (a<b) x("<li>")</script></li><li><a href="e/4">Quatrième</a> la dernière soirée</ul></div></body>"""


def test_records_by_what_repeats():
    paths = {"title": ["a"], "url": ["a@href"], "none": ["b.x"]}
    got = listing_pages.records(PAGE, paths)
    assert got == [{"title": t, "url": f"e/{i + 1}"} for i, t in enumerate(["Premier & seul", "Deuxième", "Troisième", "Quatrième"])]
    assert listing_pages.records("", paths) == [] and listing_pages.records("no <b", paths) == [] and listing_pages.records("<a href=x>one</a>", paths) == []
    assert listing_pages.tree(PAGE).text().startswith("Un Deux Trois Premier & seul une soirée longue 12/10/2026")
    long = "<ul>" + "".join(f"<li><a href='{i}'>Une soirée numéro {i}</a>" for i in range(20_000))
    assert len(listing_pages.records(long, paths)) == 20_000
    assert listing_pages.tree("<div>" * 5_000 + "deep").text() == "deep"


def test_selectors():
    page = "<div class='card big' itemscope itemtype='https://x/Event'><h2> </h2><h3 class=t><a href='/1'>Un</a></h3><meta itemprop=d content=''><meta itemprop='d e' content=2026></div><div class=card><a>Deux</a></div>"
    got = listing_pages.records(page, {"record": [".card"], "title": ["h2", ".t a", "a"], "day": ["[itemprop=d]@content"], "kind": ["@itemtype"]})
    assert got == [{"title": "Un", "day": "2026", "kind": "https://x/Event"}, {"title": "Deux"}]
    assert [len(listing_pages.records(page, {"record": [p], "t": ["a"]})) for p in ("div.card.big", "[itemtype=https://x/Event]", "[itemscope]", "div.none", "h3 a")] == [1, 1, 1, 0, 0]


def test_pages_become_events(spark):
    pages = [(1, 1, '<article class="ev"><h2>Bal</h2><a class=t href="//o.example/x">y</a><p class=when>du 3 au 9 mai 2027 à 20h<p class=price>de 5 à 12,50 €</article><article class=ev><h2>Sans date</h2></article>'), (0, 2, None), (5, 3, "<p>a site without selectors"), (0, 4, "<b")]
    found = listing_pages.read(spark.createDataFrame(pages, "site int, key long, value string"), spark.createDataFrame(SELECTORS, "site int, field string, path string, rank int"))
    got = [r.asDict() for r in listing_pages.events(found, F.lit("https://s.example/l"), date(2026, 10, 7)).collect()]
    assert [(r["key"], r["pos"], r["url"], r["title"], r["start_date"], r["end_date"].date(), r["time_known"], r["price_min"], r["price_max"], r["price_status"], r["is_cancelled"]) for r in got] == [(1, 0, "https://o.example/x", "Bal", datetime(2027, 5, 3, 18), date(2027, 5, 9), True, 500, 1250, "paid", False)]
    urls = [("a", "https://s.example/x/a"), ("/a", "https://s.example/a"), ("?q", "https://s.example/x/?q"), ("https://o/z", "https://o/z"), ("mailto:a@b", None), ("#top", None), (None, None)]
    base = F.lit("https://s.example/x/y?z=1#t")
    assert [r.u for r in spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "i int, u string").orderBy("i").select(listing_pages.absolute(F.col("u"), base).alias("u")).collect()] == [w for _, w in urls]


# ---------------------------------------------------------------- alerts


@pytest.mark.parametrize("depth", [1, 3, 20])
def test_alerts_go_on_for_members_who_lack_some(spark, monkeypatch, depth):
    """First dates that were delivered, refused or older than the follow do not count; the answer is that of the whole list."""
    monkeypatch.setattr(members, "DEEPER", 2)
    ntz = lambda df, *cs: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cs})
    day = lambda n: NOW + timedelta(days=n)
    follows = ntz(spark.createDataFrame([(u, a, day(-100 if u % 4 else 0.5)) for u in range(12) for a in range(u % 5 + 1)], "user_id long, artist_key long, followed_at timestamp"), "followed_at")
    outings = ntz(spark.createDataFrame([(i, day(10 + i // 2), day(-3 + (i % 6)), day(1) if i % 5 == 0 else None) for i in range(60)], "id long, start_date timestamp, created_at timestamp, on_sale_at timestamp"), "start_date", "created_at", "on_sale_at")
    artists = spark.createDataFrame([(i, a) for i in range(60) for a in range(5) if (i * 7 + a * 3) % 4 == 0 or i % 11 == a], "id long, artist_key long")
    went = spark.createDataFrame([(u, u) for u in range(12)], "user_id long, id long")
    delivered = spark.createDataFrame([(u, i, "new_date") for u in range(0, 12, 3) for i in range(40)], "user_id long, id long, kind string")
    settings = spark.createDataFrame([(2, "on_sale", False), (5, "new_date", False), (7, "new_date", True)], "user_id long, kind string, wanted boolean")
    for s in (None, settings):
        want = members.selected_items(members.alert_items(follows, artists, outings, went, NOW), delivered, s, 6)
        got = members.alerts(follows, artists, outings, went, delivered, NOW, 6, s, depth)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_pages_of_plain_tags_are_read_as_any_other():
    plain = ["<!DOCTYPE html><body><nav><li><a href=/a>Un<li>Deux</nav><script>var x = '<p>';</script><!-- c --><P Class='a b' hidden>Caf&eacute; &amp; th\u00e9<p>x<br/>y</div></body>", "<ul><li><a href='u'>t</a><li>q", ""]
    odd = ["a < b", "<a href='?a=1&b=2'>", "<title>a <b></title>", "<td x = 1>", "<![CDATA[x]]>", "<script>a</script", "<a"]
    dump = lambda n: (n.tag, n.attributes, [x if isinstance(x, str) else dump(x) for x in n.inside])
    for page in plain + odd:
        reader = listing_pages._Reader()
        reader.feed(page)
        reader.close()
        assert dump(listing_pages.tree(page)) == dump(reader.tree.root())
    assert all(listing_pages._plain(p) is not None for p in plain) and all(listing_pages._plain(p) is None for p in odd)


def test_what_a_card_says_is_worked_out_once_a_row(spark):
    rows = spark.createDataFrame([(1, 0, {"title": "t", "when": "le 12 mars 2027 \u00e0 20h30"})], "key int, pos int, fields map<string,string>")
    out = listing_pages.events(rows, F.lit("https://s.example/l"), date(2026, 10, 7))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("duree") == 1  # the pattern of lengths is in every copy of the dates
    assert out.count() == 1
