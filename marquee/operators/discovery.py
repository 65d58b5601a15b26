"""Which sources are worth reading: a bounded sample of each, what the sample says, and a verdict.

The sample of a source is its rows of the least hashes, which is the same
whatever the order or the partition of rows, and which tasks cut to its size
before the shuffle: a source with a third of all rows sends no more than any
other. Shares come with the lower bound of their confidence interval, so that a
source of which little was seen is not judged as surely as one of which much was.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many rows of a source are looked at, and what is asked of official and of other ones.
SAMPLE = 100
LEAST_CULTURAL, LEAST_CULTURAL_OTHER = 0.25, 0.4
LEAST_ROWS_OTHER, LEAST_IN_ZONE = 5, 3
WHOLE_SHARE, WHOLE_SHARE_OTHER = 0.5, 0.8
Z = 1.96  # of 95 %


def sampled(rows: DataFrame, source: str, id_col: str, most: int = SAMPLE, seed: int = 7) -> DataFrame:
    """At most ``most`` rows of each source."""
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(source).cast("string"), F.col(id_col).cast("string")))
    place = F.row_number().over(Window.partitionBy(source).orderBy(hashed, id_col))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def lower_bound(hits: Column, n: Column) -> Column:
    """Of the share that hits of n let expect (Wilson's interval); 0 of nothing."""
    p = hits / n
    spread = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))
    return F.when(n > 0, F.greatest((p + Z * Z / (2 * n) - spread) / (1 + Z * Z / n), F.lit(0.0))).otherwise(0.0)


def judged(sample: DataFrame, source: str) -> DataFrame:
    """(source, n, n_in, n_out, n_cultural, share, least_share, mode, reason) of sample(source, zone, cultural, official, cultural_name, department).

    zone: in, out, online or null (unknown). mode: ``all`` to read a source whole, ``dept`` to ask it for departments only, null
    to leave it. A source is official if a row says so.
    """
    k = F.count_if
    s = sample.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), k(F.col("zone") == "in").alias("n_in"), k(F.col("zone") == "out").alias("n_out"), k("cultural").alias("n_cultural"), F.coalesce(F.bool_or("official"), F.lit(False)).alias("official"), F.coalesce(F.bool_or("cultural_name"), F.lit(False)).alias("named"),
    )
    located = F.col("n_in") + F.col("n_out")
    share = F.when(located > 0, F.col("n_in") / located).otherwise(0.0)
    cultural = F.col("n_cultural") / F.col("n") >= F.when(F.col("official"), LEAST_CULTURAL).otherwise(LEAST_CULTURAL_OTHER)
    reason = (
        F.when(F.col("n_in") == 0, "nothing in the zone").when(~F.col("official") & (F.col("n") < LEAST_ROWS_OTHER), "too few rows").when(~cultural & ~(F.col("named") & F.col("official")), "off topic")
        .when(~F.col("official"), F.when(share >= WHOLE_SHARE_OTHER, "in the zone").otherwise("mostly out of the zone")).when(share >= WHOLE_SHARE, "in the zone").when(F.col("n_in") < LEAST_IN_ZONE, "too few in the zone").otherwise("partly in the zone")
    )
    mode = F.when(F.col("reason") == "in the zone", "all").when(F.col("reason") == "partly in the zone", "dept")
    out = s.withColumns({"share": share, "least_share": lower_bound(F.col("n_in"), located), "reason": reason})
    return out.withColumn("mode", mode).select(source, "n", "n_in", "n_out", "n_cultural", "share", "least_share", "mode", "reason")


def margin(n: int) -> float:
    """How far a share seen in n rows may be off, at most."""
    return Z * math.sqrt(0.25 / n) if n else 1.0
