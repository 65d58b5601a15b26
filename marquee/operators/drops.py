"""The weekly drop: a few picks a member, made once a week and shown unchanged until the week is over.

What was given is kept in a folder, a sub-folder of files for each run that gave
some. A run gives only to members who have nothing yet, and counts only as a
whole: its folder is read once Spark has committed it, so a run that was lost
half-way leaves nothing, and doing it again does not change what others got. If
two runs at once give to one member, the earlier folder counts for everybody.
"""

from __future__ import annotations

import time
import uuid
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

SIZE = 5
SCHEMA = "user_id long, ids array<long>"


def week_start(at: Column) -> Column:
    """The Monday of the Paris week of a UTC instant."""
    return F.date_trunc("week", times.to_paris(at)).cast("date")


def _runs(spark: SparkSession, path: str, week: date) -> list[str]:
    """Committed runs of a week, the earliest first; there is one a call, not one a row."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/week={week}")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [str(s.getPath()) for s in fs.listStatus(at)]
    return sorted(p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def stored(spark: SparkSession, path: str, week: date) -> DataFrame:
    """(user_id, ids) given in a week."""
    runs = _runs(spark, path, week)
    if not runs:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(*runs).withColumn("run", F.input_file_name())
    return rows.groupBy("user_id").agg(F.min_by("ids", "run").alias("ids"))


def give(picks: DataFrame, path: str, week: date, size: int = SIZE) -> DataFrame:
    """(user_id, ids) of the week, after members who had nothing have got the first ``size`` of picks(user_id, id, pos); members without picks get nothing, and may later."""
    spark = picks.sparkSession
    had = stored(spark, path, week)
    mine = picks.select(F.col("user_id").cast("long"), F.col("id").cast("long"), "pos").join(had.select("user_id"), "user_id", "left_anti")
    new = mine.groupBy("user_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("pos", "id"))), 1, size)["id"].alias("ids"))
    new.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/week={week}/run={time.time_ns():020d}-{uuid.uuid4().hex[:8]}")
    return stored(spark, path, week)


def shown(given: DataFrame, outings: DataFrame, now: datetime) -> DataFrame:
    """(user_id, pos, id, n_ended): what of a drop is left to show, in its order, and how many of it are over; ids that no longer exist are in neither."""
    live = times.effective_end(F.col("start_date"), F.col("end_date")) >= times.stamp(now)
    each = given.select("user_id", F.posexplode("ids").alias("at", "id")).join(outings.select("id", live.alias("live")), "id")
    by = each.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("at", "id")))).alias("left"), F.count_if(~F.col("live")).alias("n_ended"))
    return by.select("user_id", F.posexplode_outer("left").alias("pos", "x"), "n_ended").select("user_id", "pos", "x.id", "n_ended")
