"""Venues of one place: links with a veto, merged in rounds.

Links are pairs of venues that are the same place by the rules of
:func:`same_place`. They are taken in one order, equal names first, then by a
hash; a link merges the two groups of its ends unless some pair of their members
is known to be apart (:func:`apart`). That is a greedy choice, but not a
sequential one: a link that comes first among all links of both its groups can
be decided whatever the others do, so every round decides all of those at once,
and a random order makes them a constant part of all links. A veto is for ever,
as groups only grow; so each round first drops all links that are vetoed by now,
from summaries of the groups (post code, box of places, names) where these
decide, else by the pairs of members. No component, and no group, has to be in
one task.

Venues that agree in name, post code and place are one node from the start.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, names, text
from .scratch import drop, settled, table

# Metres within which places are one spot, and from which on they are apart; post codes that mean another.
NEAR_M, FAR_M = 60, 1500
SAME_ZIP = {"75116": "75016"}
FINE, COARSE = (0.001, 0.0013), (0.0137, 0.0211)  # degrees of cells that are at least as wide as NEAR_M and FAR_M
HOT = 256  # nodes of a fine cell from which on only those that share part of a name meet


def _zip(c: Column) -> Column:
    code = text.zip_code(c)
    return reduce(lambda out, kv: F.when(code == kv[0], kv[1]).otherwise(out), SAME_ZIP.items(), code)


def _metres(a: str, b: str) -> Column:
    return geo.haversine_m(*(F.col(f"{p}.{x}") for p in (a, b) for x in ("lat", "lng")))


def zips_conflict(a: str, b: str) -> Column:
    """Both post codes are known and differ."""
    return F.coalesce(F.col(f"{a}.zip") != F.col(f"{b}.zip"), F.lit(False))


def same_place(a: str, b: str) -> Column:
    """Whether two nodes (aliases of frames with s, zip, lat, lng) are one place.

    Of equal names: not known to be far; near, if the name is a generic one; near, or of one known post code, if it is short.
    Of others: near, with compatible names.
    """
    s, t, m = F.col(f"{a}.s"), F.col(f"{b}.s"), _metres(a, b)
    near, not_far = F.coalesce(m < NEAR_M, F.lit(False)), F.coalesce(m < FAR_M, F.lit(True))
    key = F.when(s["key"] == t["key"], s["key"]).otherwise(F.replace(s["plain"], F.lit(" "), F.lit("")))
    one_zip = F.coalesce(F.col(f"{a}.zip") == F.col(f"{b}.zip"), F.lit(False))
    equal = F.when(key.isin(*names.GENERIC_KEYS), near).when(F.length(key) < names.SHORT_KEY, near | (one_zip & not_far)).otherwise(not_far)
    return ~zips_conflict(a, b) & F.when(names.same_name(s, t), equal).otherwise(near & names.compatible(s, t))


def apart(a: str, b: str) -> Column:
    """Whether two nodes are known to be different places: post codes, far from each other, or one spot with other names."""
    m = _metres(a, b)
    return zips_conflict(a, b) | F.coalesce(m >= FAR_M, F.lit(False)) | (F.coalesce(m < NEAR_M, F.lit(False)) & ~same_place(a, b))


def nodes(venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(p, s, zip, lat, lng) of the nodes, and (id, p) of the venues: those that agree in all of it, and are one place by it, are one node."""
    rows = venues.select("id", F.coalesce("name", F.lit("")).alias("name"), _zip(F.col("zip_code")).alias("zip"), *(F.when(F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.col(x).cast("double")).alias(x) for x in ("lat", "lng")))
    kinds = rows.groupBy("name", "zip", "lat", "lng").agg(F.min("id").alias("p")).withColumn("s", names.signature(F.col("name")))
    kinds = table(kinds.alias("a").withColumn("one", same_place("a", "a")), "venue-kinds")
    by = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("name", "zip", "lat", "lng")]
    of = table(rows.alias("r").join(kinds.alias("k"), reduce(Column.__and__, by)).select("r.id", F.when(F.col("k.one"), F.col("k.p")).otherwise(F.col("r.id")).alias("p"), "s", "k.zip", "k.lat", "k.lng"), "venue-nodes")
    return of.where("id = p").select("p", "s", "zip", "lat", "lng"), of.select("id", "p")


def links(of: DataFrame) -> DataFrame:
    """(a, b, kind) of all pairs of nodes that are one place: 0 of equal names, 1 of others. Pairs are judged where they meet, and only links leave."""
    located = F.col("lat").isNotNull()
    name_keys = F.array_distinct(F.filter(F.array(F.col("s.key"), F.concat(F.lit("n:"), F.col("s.plain"))), lambda k: ~k.isin("", "n:")))
    keyed = of.withColumn("k", F.explode(name_keys))

    def met(left: DataFrame, right: DataFrame, on: list[str], also: Column) -> DataFrame:
        both = left.alias("a").join(right.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on])
        both = both.where(also & same_place("a", "b"))
        kind = F.when(names.same_name(F.col("a.s"), F.col("b.s")), 0).otherwise(1)
        return both.select(F.least("a.p", "b.p").alias("a"), F.greatest("a.p", "b.p").alias("b"), kind.alias("kind"))

    def celled(rows: DataFrame, size: tuple[float, float]) -> tuple[DataFrame, DataFrame]:
        i, j = geo.cell(F.col("lat"), F.col("lng"), *size)
        around = rows.where(located).withColumn("c", F.explode(geo.neighbours(i, j)))
        return rows.where(located).withColumn("c", F.struct(i.alias("i"), j.alias("j"))), around

    ordered = F.col("a.p") < F.col("b.p")
    loose = met(keyed.where(~located), keyed, ["k"], F.col("b.lat").isNotNull() | ordered)
    named = met(*celled(keyed, COARSE), ["k", "c"], ordered)
    # a cell with many nodes: compatible names share a word, a trigram of one, or four letters of the key
    own, around = celled(of, FINE)
    crowded = table(around.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT), "crowded-cells")
    four = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s.key") - 3, F.lit(1))), lambda i: F.substr(F.col("s.key"), i, F.lit(4)))
    marks = F.array_distinct(F.concat(F.col("s.tokens"), F.col("s.grams"), four))

    def spread(rows: DataFrame) -> DataFrame:
        x = rows.join(crowded, "c", "left")
        return x.withColumn("k", F.explode(F.when(F.col("n").isNotNull(), marks).otherwise(F.array(F.lit("")))))

    near = met(spread(own), spread(around), ["c", "k"], ordered)
    return loose.unionByName(named).unionByName(near).groupBy("a", "b").agg(F.min("kind").alias("kind"))


def _vetoed(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of the links between groups of which some pair is apart."""
    box = members.groupBy("g").agg(F.max("zip").alias("zip"), *(f(x).alias(f"{n}_{x}") for x in ("lat", "lng") for f, n in ((F.min, "min"), (F.max, "max"))), F.min("s.key").alias("min_key"), F.max("s.key").alias("max_key"))
    pair = edges.select("a", "b").join(box.alias("x"), F.col("a") == F.col("x.g")).join(box.alias("y"), F.col("b") == F.col("y.g"))
    low = lambda f, v: f(F.col(f"x.min_{v}"), F.col(f"y.min_{v}"))
    high = lambda f, v: f(F.col(f"x.max_{v}"), F.col(f"y.max_{v}"))
    unplaced = F.col("x.min_lat").isNull() | F.col("y.min_lat").isNull()
    gap = lambda v: F.radians(F.greatest(low(F.greatest, v) - high(F.least, v), F.lit(0.0)))
    side = lambda v: F.radians(high(F.greatest, v) - low(F.least, v))
    top = F.greatest(F.abs(low(F.least, "lat")), F.abs(high(F.greatest, "lat")))
    least = geo.EARTH_M * F.greatest(gap("lat"), 0.99 * gap("lng") * F.cos(F.radians(top)))  # no two members are nearer
    most = geo.EARTH_M * (side("lat") + side("lng"))  # no two are farther
    one_key = (F.col("x.min_key") != "") & (F.col("x.min_key") == F.col("x.max_key")) & (F.col("x.min_key") == F.col("y.min_key")) & (F.col("y.min_key") == F.col("y.max_key"))
    no = zips_conflict("x", "y") | (~unplaced & (least >= FAR_M))
    yes = unplaced | ((most < FAR_M) & (one_key | (least >= NEAR_M)))
    judged = table(pair.select("a", "b", F.when(no, "no").when(yes, "yes").otherwise("look").alias("by_box")), "judged-links")
    look = judged.where("by_box = 'look'").join(members.alias("m"), F.col("a") == F.col("m.g")).join(members.alias("n"), F.col("b") == F.col("n.g"))
    return judged.where("by_box = 'no'").select("a", "b").union(look.where(apart("m", "n")).select("a", "b")).distinct()


def groups(of: DataFrame, edges: DataFrame) -> DataFrame:
    """(p, g): the group of each node that has a link, named by its least node; links(a, b, kind) are taken by kind and hash, with the veto."""
    order = F.struct(F.col("kind"), F.xxhash64("a", "b").alias("h"), F.col("a"), F.col("b"))
    edges = table(edges.select("a", "b", order.alias("w")), "links")
    ends = edges.select("a").union(edges.select("b")).distinct().toDF("p")
    members = table(of.join(ends, "p").withColumn("g", F.col("p")), "members")
    while True:
        vetoed = _vetoed(edges, members)
        left = table(edges.join(vetoed, ["a", "b"], "left_anti"), "links")
        drop(edges)
        edges = left
        if edges.isEmpty():
            break
        best = edges.select(F.col("a").alias("g"), "w").union(edges.select(F.col("b").alias("g"), "w")).groupBy("g").agg(F.min("w").alias("m"))
        first = edges.join(best.toDF("a", "m"), "a").where("w = m").drop("m").join(best.toDF("b", "m"), "b").where("w = m")
        into = table(first.select(F.col("b").alias("old"), F.col("a").alias("new")), "merges")  # of a group, one at most
        now = members.join(into, F.col("g") == F.col("old"), "left").withColumn("g", F.coalesce("new", "g")).drop("old", "new")
        now = table(now, "members")
        drop(members)
        members = now
        x, y = (into.toDF(f"{c}_old", f"{c}_new") for c in "ab")
        after = edges.join(x, F.col("a") == F.col("a_old"), "left").join(y, F.col("b") == F.col("b_old"), "left").select(F.coalesce("a_new", "a").alias("a"), F.coalesce("b_new", "b").alias("b"), "w")
        after = table(after.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w")), "links")
        drop(edges, into)
        edges = after
    return settled(members.select("p", "g"), "groups")


def link_venues(venues: DataFrame) -> DataFrame:
    """(alias, canonical) of venues(id, name, zip_code, lat, lng, n_events, created_at) that are one place.

    Venues with a canonical_venue_id, if there is such a column, are left alone. The canonical one has the most events, then a
    place, then the earliest creation, then the greatest id.
    """
    if "canonical_venue_id" in venues.columns:
        venues = venues.where("canonical_venue_id is null")
    of, member = nodes(venues)
    group = groups(of, links(of))
    whole = member.join(group, "p", "left").select("id", F.coalesce("g", "p").alias("g"))
    rank = F.struct(F.coalesce("n_events", F.lit(0)).alias("n"), (F.col("lat").isNotNull() & F.col("lng").isNotNull()).alias("located"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), F.col("id").alias("i"))
    ranked = whole.join(venues, "id").select("g", "id", rank.alias("r"))
    best = ranked.groupBy("g").agg(F.max_by("id", "r").alias("canonical"))
    return whole.join(best, "g").where("id <> canonical").select(F.col("id").alias("alias"), "canonical")
