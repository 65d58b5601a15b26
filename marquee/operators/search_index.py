"""A search index of trigrams, in generations.

A generation is two written tables: postings (a row for each trigram of a text
and the text's id), in folders by a hash of the trigram and sorted inside, so
that a search reads only the folders of its trigrams and in them the row groups
that can hold these; and the number of postings of each trigram. A token is
looked up by its trigrams, the rarest few: ids in all of their lists are
candidates, and only rows of candidates are read and tested. A new generation
is built beside the old one and becomes the current one by the switch of one
pointer; one that would shrink the index to under a share is refused.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import etl

FOLDERS = 64
MOST_LISTS = 4  # of a token, the shortest ones that are intersected


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def grams(c: Column) -> Column:
    """Distinct runs of three characters of a folded text; an empty array where it is shorter or null."""
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))
    return F.array_distinct(F.filter(text.let(F.coalesce(c, F.lit("")), runs), lambda g: F.length(g) == 3))  # a text is folded once, not for each run


def rebuild(rows: DataFrame, folded: Column, path: str, name: str, least_share: float = 0.3, small: int = 200) -> None:
    """Makes a generation of rows(id) by a folded text, and the current one of it; ValueError if over ``small`` indexed ids would fall to under ``least_share`` of them."""
    texts = rows.select("id", folded.alias("text")).repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)  # a table's row groups may be fewer than the cores
    each = texts.select("id", F.explode(grams(F.col("text"))).alias("gram"))
    postings = each.withColumn("folder", _folder(F.col("gram"))).repartition("folder").sortWithinPartitions("folder", "gram", "id")
    etl.swapped(postings, path, name, least_share, small, by="folder", counted="id")
    spark = rows.sparkSession
    lists = current(spark, path, name).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    lists.write.mode("overwrite").parquet(f"{_at(spark, path, name)}-lists")


def _at(spark: SparkSession, path: str, name: str) -> str:
    return spark.read.parquet(f"{path}/{name}/current").first()["at"]


def current(spark: SparkSession, path: str, name: str) -> DataFrame:
    return etl.current(spark, path, name)


def candidates(spark: SparkSession, path: str, name: str, token: str) -> DataFrame | None:
    """(id) of the texts that may hold a folded token; None if it is too short to be looked up."""
    asked = sorted({token[i : i + 3] for i in range(len(token) - 2)})
    if not asked:
        return None
    sizes = spark.read.parquet(f"{_at(spark, path, name)}-lists").where(F.col("gram").isin(asked)).orderBy("n", "gram").collect()  # a row for each trigram of the token
    if len(sizes) < len(asked):  # one of them is nowhere
        return current(spark, path, name).select("id").limit(0)
    rare = [r["gram"] for r in sizes[:MOST_LISTS]]
    folders = [r[0] for r in spark.createDataFrame([(g,) for g in rare], "g string").select(_folder(F.col("g"))).distinct().collect()]
    found = current(spark, path, name).where(F.col("folder").isin(folders) & F.col("gram").isin(rare))
    return found.groupBy("id").agg(F.count_distinct("gram").alias("k")).where(F.col("k") == len(rare)).select("id")


def matching(rows: DataFrame, fields: list[tuple[str, str, Column]], tokens: list[str], path: str) -> DataFrame:
    """rows of which every token matches one of the fields: (index, the column of rows that it indexes, folded text).

    For each token the candidates of all fields come from their postings, and the texts of those rows alone are tested.
    """
    spark = rows.sparkSession
    out = rows
    for token in tokens:
        found = [(key, ids) for name, key, _ in fields if (ids := candidates(spark, path, name, token)) is not None]
        hit: Callable[[Column], Column] = lambda t, token=token: F.coalesce(text.token_match(t, token), F.lit(False))
        test = reduce(Column.__or__, (hit(t) for _, _, t in fields))
        if len(found) == len(fields):
            keyed = [out.join(ids.withColumnRenamed("id", key), key, "left_semi").select("id") for key, ids in found]
            out = out.join(reduce(DataFrame.union, keyed).distinct(), "id", "left_semi")
        out = out.where(test)
    return out
