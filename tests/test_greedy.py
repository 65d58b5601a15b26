"""Greedy choices against the plain loop over all rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest

from marquee.operators import editorial, members


def plain_picks(rows, k, per_category, per_day, long_runs):
    ranked = sorted(rows, key=lambda r: (-r["score"], r["start_date"], r["id"]))
    out = []
    for strict in (True, False):
        for r in ranked:
            if len(out) >= k or r in out:
                continue
            venue = lambda x: x["venue_id"] if x["venue_id"] is not None else ("id", x["id"])
            long_ = lambda x: x["end_date"] is not None and x["end_date"] > x["start_date"] + timedelta(hours=12)
            day = lambda x: (x["start_date"] + timedelta(hours=2)).date()  # noqa: E731  October: summer time
            if any(venue(x) == venue(r) or x["title"] == r["title"] for x in out) or long_(r) and sum(map(long_, out)) >= long_runs:
                continue
            if strict and (sum((x["category_slug"] or "autre") == (r["category_slug"] or "autre") for x in out) >= per_category or not long_(r) and sum(not long_(x) and day(x) == day(r) for x in out) >= per_day):
                continue
            out.append(r)
    return [r["id"] for r in out]


@pytest.mark.parametrize("seed", range(4))
def test_picked(spark, seed):
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    rows = []
    for i in range(300):
        start = datetime(2026, 10, int(rng.integers(5, 9)), 18)
        rows.append({"id": i, "venue_id": pick(None, *range(6)) if seed else int(i % 3), "title": f"t{rng.integers(12)}", "category_slug": pick(None, "concerts", "expos"), "start_date": start, "end_date": pick(None, start + timedelta(days=3)), "score": int(rng.integers(10))})
    schema = "id long, venue_id long, title string, category_slug string, start_date timestamp_ntz, end_date timestamp_ntz, score int"
    for k, c, d, n in ((8, 2, 2, 2), (5, 1, 1, 0)):
        got = [r.id for r in editorial.picked(spark.createDataFrame(rows, schema), k, c, d, n).orderBy("pos").collect()]
        assert got == plain_picks(rows, k, c, d, n)
    assert editorial.picked(spark.createDataFrame([], schema), 3, 1, 1, 1).count() == 0


def plain_diversified(rows, k):
    pool, used, out, last = sorted(rows, key=lambda r: (r[4], r[1])), {}, [], None
    key = lambda r: r[2] if r[2] is not None else ("id", r[1])
    while pool and len(out) < k:
        fresh = [r for r in pool if not used.get(key(r)) and (last is None or r[3] != last)]
        second = [r for r in pool if used.get(key(r), 0) < 2]
        r = (fresh or second or pool)[0]
        pool.remove(r)
        used[key(r)], last = used.get(key(r), 0) + 1, r[3]
        out.append(r[1])
    return out


@pytest.mark.parametrize("k", [1, 3, 6])
def test_diversified(spark, k):
    rng = np.random.default_rng(k)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    rows = [(o, i, pick(None, "a", "b", "c") if o else pick("a", "b"), pick("x", "y") if o else "x", int(rng.integers(50))) for o in range(3) for i in range(120)]
    got = {}
    for r in members.diversified(spark.createDataFrame(rows, "o int, id long, venue string, category string, rank int"), "o", k).orderBy("o", "pos").collect():
        got.setdefault(r.o, []).append(r.id)
    assert got == {o: plain_diversified([r for r in rows if r[0] == o], k) for o in range(3)}
