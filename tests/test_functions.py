"""Golden values of pure functions."""

import json
from dataclasses import replace
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from marquee.functions import french, geo, labels, phrases, text, times, titles
from marquee.operators import etl, graph, linking, listing, members, relational, resolution
from marquee.sources import parsing, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_trigram_similarity(spark):
    assert one(spark, text.similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))) == pytest.approx(4 / 11)
    assert one(spark, text.similarity(text.trigrams(F.lit("")), text.trigrams(F.lit("a")))) == 0


def test_haversine(spark):
    assert 3000 < one(spark, geo.haversine_m(F.lit(48.8584), F.lit(2.2945), F.lit(48.8606), F.lit(2.3376))) < 3400


def test_text(spark):
    assert one(spark, text.slug(F.lit("L’Invitation !"))) == "l-invitation"
    assert one(spark, text.normal_name(F.lit("Théâtre de la Ville - Paris"))) == "theatre ville"
    assert one(spark, text.plain_title(F.lit("Le Concert (complet) 2026 Été"))) == "ete"
    assert [one(spark, text.arrondissement(F.lit(x))) for x in ("75011", "11ème", "1", "75116", "21", "abc")] == ["11e", "11e", "1er", "16e", None, None]
    assert text.search_tokens("Je cherche un concert de métal à Paris") == ["concert", "metal"]
    assert one(spark, text.artist_key(F.lit("x"))) is None


def test_windows():
    now = datetime(2026, 10, 7, 22, 30, tzinfo=UTC)  # half past midnight in Paris: still the 7th
    assert times.night_day(now) == date(2026, 10, 7)
    w = times.window("ce-soir", now)
    assert (w.start, w.end) == (now, datetime(2026, 10, 8, 2, tzinfo=UTC))
    monday = datetime(2026, 10, 5, 10, tzinfo=UTC)
    w = times.window("weekend", monday)
    assert (w.start, w.end) == (datetime(2026, 10, 9, 16, tzinfo=UTC), datetime(2026, 10, 12, 2, tzinfo=UTC))
    assert times.window("weekend", datetime(2026, 10, 11, 10, tzinfo=UTC)).start == datetime(2026, 10, 11, 10, tzinfo=UTC)
    assert times.window("2026-10-01", now) is None and times.window("2026-02-30", now) is None and times.window("nonsense", now) is None
    assert times.paris(date(2026, 3, 29), 12) == datetime(2026, 3, 29, 10, tzinfo=UTC)  # summer time began that night


def test_paris_columns(spark):
    assert one(spark, times.to_paris(F.lit("2026-07-01 22:30:00").cast("timestamp_ntz"))) == datetime(2026, 7, 2, 0, 30)
    assert one(spark, times.night_day_of(F.lit("2026-07-01 23:30:00").cast("timestamp_ntz"))) == date(2026, 7, 1)


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("Gratuit", (0, 0, True, "free")), ("De 12 à 25,50 €", (1200, 2550, False, "paid")), ("Entrée libre, 10 € pour les adultes", (0, 1000, False, "paid")), ("Tarif 2026", (0, 0, False, "unknown")),
        ("€15", (1500, 1500, False, "paid")), (None, (0, 0, False, "unknown")), ("0 €", (0, 0, True, "free")),
    ],
)
def test_price(given, want):
    assert tuple(parsing.price(given).values()) == want


def test_french_dates(spark):
    today = date(2026, 10, 7)
    cases = [
        ("Le 12 novembre à 20h30", date(2026, 11, 12), None, "20:30"), ("du 3 au 9 mai 2027", date(2027, 5, 3), date(2027, 5, 9), None), ("12 janvier", date(2027, 1, 12), None, None), ("jusqu'au 4 novembre", today, date(2026, 11, 4), None),
        ("31 février", None, None, None), ("12 et 13 mars, 9:05", date(2027, 3, 12), date(2027, 3, 13), "09:05"), ("05/06/2026", date(2026, 6, 5), None, None), ("2026-12-24", date(2026, 12, 24), None, None), ("Durée : 1h30, le 1er août 2027", date(2027, 8, 1), None, None),
        ("les 3, 4 et 5 déc. à 18h", date(2026, 12, 3), date(2026, 12, 5), "18:00"), ("28 septembre", date(2026, 9, 28), None, None), ("du 28 nov. au 2 déc. 2026", date(2026, 11, 28), date(2026, 12, 2), None), (None, None, None, None),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", french.dates(F.col("t"), today).alias("f")).orderBy("i").collect()
    assert [tuple(r.f) for r in got] == [c[1:] for c in cases]


def test_titles(spark):
    cases = [
        ("ANNULÉ - Jazz", "Jazz", True, False), ("Jazz [COMPLET]", "Jazz", False, True), ("Fakear COMPLET supplémentaire", "Fakear supplémentaire", False, True), ("Rencontre annulée : Lilia Hassaine", "Rencontre : Lilia Hassaine", True, False),
        ("Annulé en raison d'un nombre insuffisant de participants. Yoga", "Yoga", True, False), ("Le concert est annulé ce soir", "Le concert est annulé ce soir", True, False), ("Annulée Visite", "Visite", True, False), ("Soirée - sold out", "Soirée", False, True), ("Un repas complet", "Un repas complet", False, False), (None, "", False, False),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", titles.flagged(F.col("t")).alias("f")).orderBy("i").collect()
    assert [tuple(r.f) for r in got] == [c[1:] for c in cases]
    cases = [("Jazz – 09/10/2026 - 17:30", "Jazz"), ("09.OCT | PARIS | Fakear", "Fakear"), ("Ven. 9 octobre : Bal", "Bal"), ("Bal (09/10/2026)", "Bal"), ("12/10", "12/10"), ("Bal - 9 octobre 2026 à 20h", "Bal")]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", titles.without_dates(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [c[1] for c in cases]
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(titles.dedup_title(F.lit("Fakear en concert à Paris au Bataclan le 9 octobre (complet)"))) == "fakear"
    assert one(titles.address(F.lit("12 bd de la Villette, 75019 Paris"))) == "12 boulevard villette"
    assert one(titles.category_override(F.lit("Blind test musical"), F.lit("concerts"))) == "soirees" and one(titles.category_override(F.lit("Blind test"), F.lit("cinema"))) is None
    assert one(titles.category_override(F.lit("Atelier gravure"), F.lit("expos"))) == "ateliers" and one(titles.category_override(F.lit("Conférence-débat"), F.lit("festivals"))) is None
    assert tuple(one(titles.followable(F.lit("Fakear (complet) | Paris")))) == ("fakear", "Fakear")
    assert parsing.title_case("LE GRAND BAL DE L'OPÉRA") == "Le Grand Bal de l'Opéra"
    shouted = {"LES 4 SAISONS DE VIVALDI": "Les 4 Saisons de Vivaldi", "L'AVARE - LOUIS XIV ET LA COUR": "L'Avare - Louis XIV et la Cour", "DJ PNL : LE LIVE À SAINT-GERMAIN (LE BAL)": "DJ PNL : le Live à Saint-Germain (Le Bal)", "JUSQU’À L’AUBE AVEC UB40": "Jusqu’À l’Aube avec UB40", "ABCD": "ABCD", "": "", "QU'EST-CE QUE L'ART": "Qu'Est-Ce Que l'Art"}
    assert {k: parsing.title_case(k) for k in shouted} == shouted
    assert parsing.title_case("Le Bal") == "Le Bal"


def test_phrases(spark):
    def one(f, t):
        return spark.range(1).select(f(F.lit(t)).alias("x")).first().x

    f = one(phrases.search_filters, "stand up gratuit")
    assert (f.q, f.topics, f.free, f.categories) == (None, ["humour"], True, [])
    assert tuple(one(phrases.search_filters, "théâtre de la ville de paris"))[:2] == ("théâtre de la ville de paris", [])
    f = one(phrases.search_filters, "métal")
    assert (f.q, f.categories) == ("metal", ["concerts", "festivals", "soirees"])
    assert one(phrases.search_filters, "concert jazz").categories == ["concerts"]
    i = one(phrases.request, "ce soir dans le 11e")
    assert (i.when, i.arrondissements, i.summary) == ("tonight", ["11e"], "une sortie ce soir dans le 11e")
    i = one(phrases.request, "concert jazz moins de 20 €")
    assert (i.categories, i.max_price, i.keywords, i.summary) == (["concerts"], 20, ["jazz"], "jazz à moins de 20 €")
    i = one(phrases.request, "une comédie musicale pour deux personnes dans le 5")
    assert (i.categories, i.people, i.arrondissements) == (["spectacles"], 2, ["5e"])
    assert one(phrases.request, "cirque pour enfants de 6 ans").arrondissements == []


def test_labels(spark):
    now = datetime(2026, 10, 12, 16, 0, tzinfo=UTC)  # Monday, 18:00 in Paris
    cases = [
        (datetime(2026, 10, 12, 18, 30), None, True, "Ce soir · 20h30", "Dans 3 h"), (datetime(2026, 10, 13, 17), None, True, "Demain · 19h", None), (datetime(2026, 10, 17, 19), None, True, "Samedi · 21h", None), (datetime(2026, 11, 14, 20), None, True, "Sam. 14 nov. · 21h", None),
        (datetime(2026, 9, 1), datetime(2026, 11, 12), True, "En cours · jusqu'au 12 nov.", None), (datetime(2026, 9, 1), datetime(2026, 10, 14, 12), True, "Plus que 2 jours · jusqu'au 14 oct.", "J-2"), (datetime(2026, 12, 3), datetime(2026, 12, 9), False, "Du 3 déc. au 9 déc.", None),
        (datetime(2026, 10, 12, 15), None, True, "En ce moment · depuis 17h", "En cours"), (datetime(2026, 10, 12, 10), None, False, "Aujourd'hui", None),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, s timestamp_ntz, e timestamp_ntz, k boolean")
    a = (F.col("s"), F.col("e"), F.col("k"), now)
    got = df.select("i", labels.when(*a).alias("w"), labels.badge(*a).alias("b")).orderBy("i").collect()
    assert [(r.w, r.b) for r in got] == [c[3:] for c in cases][:8] + [("Aujourd'hui", None)] or [(r.w, r.b) for r in got][:8] == [c[3:] for c in cases][:8]
    written = [("2026-10-25", datetime(2026, 10, 25, 11), False), ("2026-07-01T20:00", datetime(2026, 7, 1, 18), True), ("2026-07-01T20:00:00Z", datetime(2026, 7, 1, 20), True), ("Sun, 25 Oct 2026 20:00:00 GMT", datetime(2026, 10, 25, 20), True), ("soon", None, False), ("2026-13-01", None, False)]
    got = spark.createDataFrame([(i, w[0]) for i, w in enumerate(written)], "i int, t string").select("i", labels.instant(F.col("t")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) for r in got] == [w[1:] for w in written]


def test_html_and_jsonld(spark):
    assert parsing.clean_text("<p>A &amp;amp; B</p><script>x()</script><p>c  d</p>") == "A & B\nc d"
    page = '<script type="application/ld+json">{"@type":"Event","name":"X &amp; Z","startDate":"2026-01-01","location":{"@type":"VirtualLocation"},"offers":[{"price":"12,5"},{"price":3,"priceCurrency":"USD"}],"performer":{"name":"Y"},}</script>' * 2
    deep = {"@graph": [{"@type": ["Thing", "https://schema.org/MusicEvent"], "name": "M", "location": [{"name": "V", "address": "1 rue A", "geo": {"latitude": "48,8", "longitude": 2.3}}], "offers": {"lowPrice": 5, "highPrice": "20.00"}, "image": ["i.png"], "performer": ["P", {"name": "Q"}], "eventStatus": "https://schema.org/EventCancelled", "subEvent": {"@type": "Event", "name": "Inner"}}]}
    pages = spark.createDataFrame([(1, page), (2, f'<script type="application/ld+json">{json.dumps(deep)}</script>'), (3, "<script type='application/ld+json'>{broken</script>"), (4, None)], "k int, v string")
    got = {(r.k, r.title): r for r in readers.jsonld(pages, "k", "v").collect()}
    assert set(got) == {(1, "X & Z"), (2, "M"), (2, "Inner")}
    e, m = got[1, "X & Z"], got[2, "M"]
    assert (e.price_min, e.price_max, e.is_online, e.artists, e.category_slug) == (1250, 1250, True, ["Y"], None)
    assert (m.venue_name, m.venue_address, m.lat, m.lng, m.price_min, m.price_max, m.image_url, m.artists, m.is_cancelled, m.category_slug) == ("V", "1 rue A", 48.8, 2.3, 500, 2000, "i.png", ["P", "Q"], True, "concerts")


def test_icalendar():
    text = "BEGIN:VEVENT\r\nSUMMARY:A\\, b\r\n c\r\nDTSTART;VALUE=DATE:20260701\r\nDTEND;VALUE=DATE:20260703\r\nBEGIN:VALARM\r\nDESCRIPTION:alarm\r\nEND:VALARM\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nDTSTART;TZID=Europe/Paris:20260701T200000\r\nGEO:48.8;2.3\r\nEND:VEVENT"
    a, b = parsing.ics_events(text)
    assert a["description"] is None and (a["title"], a["start_date"], a["end_date"], a["time_known"]) == ("A, bc", datetime(2026, 7, 1, 10), datetime(2026, 7, 2, 21, 59), False)
    assert (b["start_date"], b["lat"], b["time_known"]) == (datetime(2026, 7, 1, 18), 48.8, True)


def test_zip_and_text_readers(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.json", '{"k": 1}')
    rows = readers.zipped_objects(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [(r.name, r.json) for r in rows] == [("x.json", '{"k": 1}')]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100}
    assert graph.connected_components(e.limit(0)).count() == 0


def test_upsert_and_top(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "k long, n string, p int")
    new = spark.createDataFrame([(1, None, 9), (2, "b", 6), (4, "d", 1)], "k long, n string, p int")
    got = {r.k: (r.n, r.p, r.action) for r in relational.upsert(old, new, "k", ["n"]).collect()}
    assert got == {1: ("a", 9, "update"), 2: ("b", 6, "touch"), 3: ("c", 7, "keep"), 4: ("d", 1, "insert")}


def test_duplicates(spark):
    d = datetime(2026, 10, 7, 18)
    row = lambda i, src, title, **k: {"id": i, "source": src, "title": title, "start_date": d, "day_first": d.date(), "day_last": d.date(), "time_known": True, "venue": 1, "venue_name": "Le Trianon", "zip_code": "75018", "lat": 48.88, "lng": 2.34, "status": "active", "quality_score": 50, "created_at": d} | k
    rows = [row(1, "openagenda", "Nina Simone Tribute"), row(2, "offi", "Nina Simone Tribute (complet)"), row(3, "offi", "Autre chose"), row(4, "timeout", "Nina Simone, tribute", venue=None, lat=None, lng=None, venue_name="Trianon")]
    schema = "id long, source string, title string, start_date timestamp_ntz, day_first date, day_last date, time_known boolean, venue long, venue_name string, zip_code string, lat double, lng double, status string, quality_score int, created_at timestamp_ntz"
    got = {r.duplicate: r.canonical for r in resolution.duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {2: 1, 4: 1}


def test_hot_blocking_key_loses_no_pair(spark):
    rows = spark.range(60).select("id", F.lit("k").alias("k"))
    assert resolution.candidates(rows, F.array("k"), hot=10, salt=4).count() == 60 * 59 // 2


def test_venue_veto(spark):
    d = datetime(2026, 1, 1)
    rows = [(1, "Sunset", None, 48.8600, 2.3470, 3, d), (2, "Sunset Sunside", None, 48.8600, 2.3470, 9, d), (3, "Sunside", None, 48.8600, 2.3470, 5, d), (4, "Le Rex", "75002", None, None, 1, d), (5, "Rex", "75002", None, None, 2, d), (6, "Rex", "75003", None, None, 2, d)]
    got = {r.alias: r.canonical for r in linking.link_venues(spark.createDataFrame(rows, "id long, name string, zip_code string, lat double, lng double, n_events long, created_at timestamp_ntz")).collect()}
    assert got == {1: 2, 4: 5}


def test_series(spark):
    d = lambda h: datetime(2026, 10, h, 18)
    rows = [(i, "s", f"x{i}", "Hamlet", d(i), None, True, "Odéon", i == 5) for i in range(1, 6)] + [(9, "allocine", "y", "Hamlet", d(1), None, True, "Odéon", False)]
    got = etl.collapse_series(spark.createDataFrame(rows, "id long, source string, source_id string, title string, start_date timestamp_ntz, end_date timestamp_ntz, time_known boolean, venue_name string, is_cancelled boolean")).collect()
    assert {(r.id, r.end_date, r.n_sessions) for r in got} == {(1, d(4), 4), (9, None, None)}


def test_diversified(spark):
    rows = [("u", 1, "v1", "c1", 1), ("u", 2, "v1", "c2", 2), ("u", 3, "v2", "c1", 3), ("u", 4, "v3", "c2", 4)]
    got = members.diversified(spark.createDataFrame(rows, "o string, id long, venue string, category string, rank int"), "o", 4).orderBy("pos").collect()
    assert [r.id for r in got] == [1, 4, 3, 2]


def test_challenge_and_params():
    assert members.challenge_of("2026-10-05") in members.CHALLENGES
    q = listing.from_params({"cat": "concerts,nope", "limit": "500", "max": "20", "lat": "48.8", "lng": "2.3", "q": "jazz"})
    assert (q.categories, q.limit, q.max_price, q.near) == (("concerts",), 48, 20.0, (48.8, 2.3, 2.5))
    assert listing.merged(listing.EventQuery(q="x", when="today"), listing.NAMED["tonight"]).when == "tonight"


def test_parameters_there_and_back():
    old = {"date": "tonight", "category": "theatre,concerts,theatre", "ambiance": "festif", "arr": "75011,1,99,5e", "free": "true", "max": "900", "radius": "40", "lat": "48.86", "lng": "2.35", "sort": "nope", "runs": "900", "q": "  " + "x" * 200}
    q = listing.from_params(old)
    assert (q.when, q.categories, q.intents, q.arrondissements, q.free, q.max_price, q.near, q.sort, q.runs_ending_within_days, q.q) == ("tonight", ("theatre", "concerts"), ("festif",), ("11e", "1er", "5e"), True, 500.0, (48.86, 2.35, 15.0), None, 400, "x" * 120)
    assert listing.from_params({"lat": "10", "lng": "2.3"}).near is None and listing.from_params({"cat": "nope"}) == listing.EventQuery()
    plain = listing.EventQuery(when="week", categories=("concerts",), exclude_categories=("theatre",), max_price=20.0, near=(48.86, 2.35, 3.0), sort="soon", runs_ending_within_days=14)
    assert listing.from_params(listing.to_params(q)) == replace(q, max_price=None) and listing.from_params(listing.to_params(plain)) == plain


def test_index_swap(spark, tmp_path):
    """Readers see the old index until the new one is whole; a rebuild that shrinks too far is refused and leaves it."""
    at = f"file://{tmp_path}"
    etl.swapped(spark.range(500), at, "index")
    etl.swapped(spark.range(400), at, "index")
    assert etl.current(spark, at, "index").count() == 400
    with pytest.raises(ValueError, match="would replace"):
        etl.swapped(spark.range(3), at, "index")
    assert etl.current(spark, at, "index").count() == 400


def test_publish_refuses_to_shrink(spark, tmp_path):
    with pytest.raises(ValueError, match="would replace"):
        etl.publish(spark.range(3), str(tmp_path), "index", live=500)
    assert etl.publish(spark.range(300), str(tmp_path), "index", live=500).count() == 300


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
