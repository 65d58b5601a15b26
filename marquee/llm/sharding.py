"""Operator 9: shards of near equal bytes by sampled splitters, native throughout.

Records are ordered by (hash of the text, id, a tie number), so equal texts lie
together, and dealt to ranges of that order. The splitters between ranges are
quantiles of a sample that takes each record with a probability in proportion to
its size: at most ``FAN`` - 1 of them, as literals. A range that then holds too
many bytes or rows is sampled again by itself and subdivided into at most
``FAN`` ranges, whose splitters are one row of a small table; so a text that a
third of all rows repeat is spread by their ids, and a range stays near
``MOST_ROWS`` rows up to some ten thousand million rows (beyond that ranges
grow, results stay the same). Sums of bytes and rows for each range, added up,
give every record its place in the whole order with windows of one range each;
the shard is where the middle of its bytes falls, so shards differ by one record
at most.

Broadcast are at most FAN rows of FAN splitters (2 MB) and FAN * FAN sums (2 MB).

Defined results: null text has no bytes; rows that repeat in full are kept
apart by a tie number; null ids come first among equal texts; an empty table
gives an empty result. Extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, table

FAN = 256
MOST_ROWS = 250_000
DRAWN = 32  # records drawn for each range, as expected
_KEY = "named_struct('k', _k, 'i', _i, 't', _tie)"


def _at_or_below(splitters: str) -> Column:
    """How many of the sorted splitters (at most FAN - 1) lie at or below a record's key, by binary search."""
    mid = "int((s.lo + s.hi) div 2)"
    step = f"if(s.lo >= s.hi, s, if(get({splitters}, {mid}) <= {_KEY}, named_struct('lo', {mid} + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', {mid})))"
    return F.expr(f"aggregate(sequence(1, {FAN.bit_length()}), named_struct('lo', 0, 'hi', size({splitters})), (s, x) -> {step}, s -> s.lo)")


def _splitters(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(_range, splitters): quantiles of a size-weighted sample of each range of wanted (_range, bytes, want; at most FAN rows)."""
    draw = F.xxhash64("_k", "_i", "_tie").bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    rate = F.lit(float(DRAWN)) * F.col("want") / F.col("bytes")
    some = rows.join(F.broadcast(wanted), "_range").where(draw < F.col("size") * rate)
    by = Window.partitionBy("_range").orderBy("_k", "_i", "_tie")
    some = some.select("_range", "want", F.expr(_KEY).alias("key"), "_k", "_i", "_tie", F.greatest(F.col("size").cast("double"), 1 / rate).alias("w"))
    run = F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(Window.partitionBy("_range"))
    some = some.select("_range", "want", "key", "_k", "_i", "_tie", F.floor(run * F.col("want")).alias("q"))
    cut = some.withColumn("before", F.lag("q", 1, 0).over(by)).where("q > before and q < want")
    return cut.groupBy("_range").agg(F.sort_array(F.collect_set("key")).alias("splitters"))


def shards_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; see the module."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_k"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63) + 1)).alias("_i"), F.monotonically_increasing_id().alias("_tie"),
    )
    keyed = table(keyed, "shard-keys")  # written once: tie numbers stay as they are
    total, count = keyed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count:
        return keyed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    ranges = max(1, min(FAN, count // 64))
    whole = keyed.withColumn("_range", F.lit(0))
    first = _splitters(whole, whole.sparkSession.range(1).select(F.lit(0).alias("_range"), F.lit(total).alias("bytes"), F.lit(ranges).alias("want"))).first()
    literal = ", ".join(f"named_struct('k', {x['k']}L, 'i', {x['i']}L, 't', {x['t']}L)" for x in (first["splitters"] if first else []))
    ranged = keyed.withColumn("_range", _at_or_below(f"array({literal})") if literal else F.lit(0))
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    want = F.greatest(F.ceil(2 * F.col("bytes") * ranges / total), F.ceil(F.col("rows") / most_rows))
    over = sums.where((F.col("bytes") > 2 * total / ranges) & (F.col("rows") > 64) | (F.col("rows") > most_rows)).select("_range", "bytes", F.least(want, F.lit(FAN)).alias("want"))
    over = table(over, "shard-overfull")
    inner = table(_splitters(ranged, over), "shard-splitters")
    ranged = ranged.join(F.broadcast(inner), "_range", "left").withColumn("splitters", F.expr("coalesce(splitters, array())"))
    ranged = ranged.withColumn("_range", F.col("_range") * FAN + _at_or_below("splitters")).drop("splitters")
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))  # at most FAN * FAN rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = table(sums.select("_range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_rows")), "shard-sums")
    w = Window.partitionBy("_range").orderBy("_k", "_i", "_tie")
    placed = ranged.select("_range", "doc_id", "size", "text_crc32", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_end"), (F.row_number().over(w) - 1).alias("_row"))
    placed = placed.join(F.broadcast(sums), "_range").select("doc_id", "size", "text_crc32", (F.col("_end") + F.col("_bytes")).alias("_end"), (F.col("_row") + F.col("_rows")).alias("_row"))
    shard = F.expr(f"int(least({shards - 1}L, (2 * _end - size) * {shards} div (2 * {total}L)))")
    placed = table(placed.select("doc_id", "size", "text_crc32", "_row", shard.alias("shard")), "shard-places")
    drop(keyed, over, inner, sums)
    first = {r[0]: r[1] for r in placed.groupBy("shard").agg(F.min("_row")).collect()}  # one row a shard
    starts = "array(" + ",".join(f"{first.get(s, 0)}L" for s in range(shards)) + ")"
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_row") - F.expr(f"get({starts}, shard)")).alias("slot"))
