"""Joins, aggregates, set operations and windows of the catalogue, over any tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(rows: DataFrame, key: str, canonical: str, columns: list[str]) -> DataFrame:
    """Alias resolution, exactly one hop: each column is its canonical row's, else its own."""
    c = rows.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_{x}") for x in columns))
    return rows.join(c, F.col(canonical) == F.col("_k"), "left").select(
        *(x for x in rows.columns if x not in columns), F.coalesce("_k", key).alias("resolved"), *(F.coalesce(f"_{x}", x).alias(x) for x in columns)
    )


def counted(rows: DataFrame, other: DataFrame, key: str, name: str = "n") -> DataFrame:
    """rows with how many rows of other share their key, 0 included; other is aggregated before the join."""
    n = other.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return rows.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def without(rows: DataFrame, *others: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose keys occur in none of the others."""
    return reduce(lambda a, b: a.join(b[0].select(b[1]).distinct(), b[1], "left_anti"), others, rows)


def top(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows of a group in each task before the shuffle."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def latest(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The last row of each key by one aggregation, without a sort."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def shares(rows: DataFrame, owner: str, kind: str) -> DataFrame:
    """Per owner: how often each kind occurs, and its rounded percentage."""
    n = rows.groupBy(owner, kind).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(owner))
    return n.withColumn("percent", F.floor(100 * F.col("n") / total + 0.5).cast("int"))


def round_robin(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """position: one of each group in turn, groups in the order of their first row."""
    w = Window.partitionBy(group).orderBy(*order)
    first = F.min(F.struct(*order)).over(Window.partitionBy(group))
    ranked = rows.withColumn("_turn", F.row_number().over(w)).withColumn("_first", first)
    return ranked.select(*rows.columns, F.col("_turn").alias("turn"), F.col("_first").alias("group_first"))


def runs(rows: DataFrame, key: str, at: str, most_days: int, most_gap: int) -> DataFrame:
    """Per key: span and longest gap in days, and whether it reads as one run."""
    gap = F.datediff(at, F.lag(at).over(Window.partitionBy(key).orderBy(at)))
    out = rows.withColumn("_gap", gap).groupBy(key).agg(F.datediff(F.max(at), F.min(at)).alias("span_days"), F.coalesce(F.max("_gap"), F.lit(0)).alias("gap_days"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("is_run", (F.col("span_days") <= most_days) & (F.col("gap_days") <= most_gap))


def shared_values(rows: DataFrame, value: str, title: str, least: int) -> DataFrame:
    """rows, the value null where at least ``least`` titles share it (a placeholder)."""
    many = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.countDistinct(title).alias("_n")).where(F.col("_n") >= least).select(value, F.lit(True).alias("_many"))
    return rows.join(many, value, "left").withColumn(value, F.when(F.col("_many").isNull(), F.col(value))).select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_old_if_null: list[str], known: dict[str, Column] | None = None) -> DataFrame:
    """A snapshot after an upsert: insert, update by column, or leave; with what happened to each row.

    Columns in keep_old_if_null take the new value unless it is null; ``known``
    gives the condition (over ``new_*``) under which other columns are taken.
    """
    cols = [c for c in old.columns if c != key]
    a = old.select(key, *(F.col(c).alias(f"old_{c}") for c in cols), F.lit(True).alias("_old"))
    b = new.select(key, *(F.col(c).alias(f"new_{c}") for c in cols), F.lit(True).alias("_new"))
    both = a.join(b, key, "full")

    def value(c: str) -> Column:
        o, n = F.col(f"old_{c}"), F.col(f"new_{c}")
        if c in keep_old_if_null:
            return F.coalesce(n, o)
        ok = (known or {}).get(c, F.lit(True)) & F.col("_new").isNotNull()
        return F.when(ok | F.col("_old").isNull(), n).otherwise(o)

    changed = reduce(Column.__or__, [~value(c).eqNullSafe(F.col(f"old_{c}")) for c in cols])
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").when(changed, "update").otherwise("touch")
    return both.select(key, *(value(c).alias(c) for c in cols), action.alias("action"))


def fused(lists: DataFrame, item: str, rank: str, which: str) -> DataFrame:
    """Rank fusion: each list l gives an item at rank i max(0, 40 - i) / 40 / (l + 1), and a quarter for being in it."""
    part = F.greatest(F.lit(0.0), (40 - F.col(rank)) / 40) / (F.col(which) + 1) + 0.25
    return lists.groupBy(item).agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("lists"))


def banded(rows: DataFrame, key: str, value: str, width: float, item: str) -> DataFrame:
    """Pairs (a, b), a < b, of items of one key whose values differ by less than a width: joined by band, so a large key is cut into as many parts as it has bands."""
    band = F.floor(F.col(value) / width)
    a = rows.select(F.col(item).alias("a"), F.col(key).alias("_k"), F.col(value).alias("_x"), band.alias("_b"))
    b = rows.select(F.col(item).alias("b"), F.col(key).alias("_k"), F.col(value).alias("_y"), F.explode(F.array(band - 1, band, band + 1)).alias("_b"))
    return a.join(b, ["_k", "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("_x") - F.col("_y")) < width)).select("a", "b")


def overlapping(rows: DataFrame, key: str, start: str, end: str, item: str) -> DataFrame:
    """Pairs (a, b), a < b, of items of one key whose dates overlap: joined by month, each pair in the first month that both have; an end before its start has no months."""
    month = lambda x: F.year(x) * 12 + F.month(x)
    held = rows.where(F.col(start) <= F.col(end)).select(item, key, start, end, F.explode(F.sequence(month(F.col(start)), month(F.col(end)))).alias("_m"))
    a, b = held.toDF("a", "_k", "_sa", "_ea", "_m"), held.toDF("b", "_k", "_sb", "_eb", "_m")
    met = a.join(b, ["_k", "_m"]).where("a < b and _sa <= _eb and _sb <= _ea")
    return met.where(F.col("_m") == month(F.greatest("_sa", "_sb"))).select("a", "b")
