"""Operator 5: preference formatting.

A pair has a chosen and a rejected conversation. Their longest common prefix of
turns is rendered once, as the prompt; what follows in each is its completion,
with the spans of characters that count for the loss: the text of assistant
turns and the end mark after it. Everything else is masked.

One shuffle brings both conversations of a pair together; all else is native
expressions over that row. A conversation, which ends up as one rendered string,
is one row.

Defined results: null role is ``unknown``, null text empty; turns are in order
of (turn, role, text), repeated rows included, null turns first; turns without
a conversation are left out, as are pairs that lack one side; of several
conversations on one side the least id counts; equal conversations give a full
prompt and empty completions. ``<|`` in a role or text is rendered as ``< |``,
so that no text holds a mark. Extra columns stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def pairs_by_parity(turns: DataFrame) -> DataFrame:
    """turns with pair_id and side: conversation 2k is chosen over 2k + 1."""
    return turns.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("is_chosen"), "conv_id", "turn", "role", "text").where("conv_id is not null")


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(END))), "")


def _loss(turns: Column) -> Column:
    """Spans [start, end) of assistant texts with their end marks, as 'start:end' joined by commas."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + len(END)
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.array_join(F.aggregate(turns, zero, step)["spans"], ",")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Rows of turns(pair_id, is_chosen, conv_id, turn, role, text) as formatted pairs."""
    plain = lambda c, none: F.replace(F.coalesce(c, F.lit(none)), F.lit("<|"), F.lit("< |"))
    turn = F.struct("conv_id", "turn", plain("role", "unknown").alias("role"), plain("text", "").alias("text"))
    of = lambda c, i: F.filter(c, lambda t: t["conv_id"].eqNullSafe(F.col(i)))
    both = turns.groupBy("pair_id").agg(
        F.min(F.when(F.col("is_chosen"), F.col("conv_id"))).alias("chosen_id"), F.min(F.when(~F.col("is_chosen"), F.col("conv_id"))).alias("rejected_id"),
        F.sort_array(F.collect_list(F.when(F.col("is_chosen"), turn))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("is_chosen"), turn))).alias("r"),
    ).where("size(c) > 0 and size(r) > 0").withColumns({"c": of("c", "chosen_id"), "r": of("r", "rejected_id")})
    least = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", F.lit(1), least), F.slice("r", F.lit(1), least), lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"]))
    differs = F.array_position(same, F.lit(False))
    both = both.withColumn("n_prompt_turns", F.when(differs == 0, least).otherwise(differs - 1).cast("int"))
    rest = lambda c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c))
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "n_prompt_turns", _rendered(F.slice("c", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"), _rendered(rest("r")).alias("rejected"), _loss(rest("c")).alias("chosen_loss"), _loss(rest("r")).alias("rejected_loss"),
    )
