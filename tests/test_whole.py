"""Queries that once read a part of a table, over the whole of it: their SQL without that cut."""

from datetime import datetime, time, timedelta
from zoneinfo import ZoneInfo

import pytest

from marquee.plans import registry

from .oracle import connect, rows_of_spark, rows_of_sql

SF = "/root/testdata/sf0.001"
FIFTH = ["src_01_jsonld", "src_03_microdata", "src_04_icalendar", "src_05_tribe", "src_08_open_agenda", "src_11_ticketing", "dte_03_french_dates"]
PARIS = "(case when month(o_orderdate) between 4 and 8 then 2 else 1 end)"


@pytest.fixture(scope="module")
def con():
    c = connect(SF)
    c.execute("create table paris (day date, h int)")
    days = [datetime.combine(x, time(12)) for (x,) in c.execute("select distinct o_orderdate::date from orders").fetchall()]
    c.executemany("insert into paris values (?, ?)", [(x.date(), ZoneInfo("Europe/Paris").utcoffset(x) // timedelta(hours=1)) for x in days])
    return c


def whole(name, *cuts):
    sql = registry.ORACLES[name]
    for cut, put in cuts:
        sql = sql.replace(cut, put)
    return sql


@pytest.mark.parametrize("name", FIFTH)
def test_reads_all_orders(spark, con, name):
    sql = whole(name, ("o_orderkey % 5 = 0 and ", ""), (" where o_orderkey % 5 = 0", ""))
    assert rows_of_spark(registry.QUERIES[name](spark, SF)) == rows_of_sql(con, sql)


@pytest.mark.parametrize("name", ["src_06_open_data", "src_21_artist_events"])
def test_reads_all_months(spark, con, name):
    sql = whole(name, (" where o_orderkey % 5 = 0 and month(o_orderdate) not in (3, 9, 10)", ""), (PARIS, "(select h from paris where day = o_orderdate::date)"))
    assert rows_of_spark(registry.QUERIES[name](spark, SF)) == rows_of_sql(con, sql)


def test_reads_zero_prices(spark, con):
    assert rows_of_spark(registry.QUERIES["num_01_prices"](spark, SF)) == rows_of_sql(con, whole("num_01_prices", (" where o_orderkey % 80 > 0", "")))


@pytest.mark.parametrize(("name", "cut"), [("txt_02_fold_ligatures", "left(text, 80)"), ("txt_03_slug", "left(text, 60)")])
def test_folds_whole_texts(spark, con, name, cut):
    assert rows_of_spark(registry.QUERIES[name](spark, SF)) == rows_of_sql(con, whole(name, (cut, "text")))


def test_sets_of_all_events(spark):
    sf = "/root/testdata/sf0.01"  # on the smallest tables the first 300 events give the same result
    assert rows_of_spark(registry.QUERIES["set_06_array_sets"](spark, sf)) == rows_of_sql(connect(sf), whole("set_06_array_sets", (" where event_id < 300", "")))
