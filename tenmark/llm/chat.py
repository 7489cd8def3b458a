"""Preference formatting of paired conversations. DataFrame functions only.

A pair is two conversations, one chosen and one rejected. Their longest common prefix of turns is rendered
once, as the prompt; what follows in each is its completion. A completion's mask lists the spans (code
points, end exclusive) that count for the loss: the texts of assistant turns with their end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURNS = "array<struct<role:string,text:string>>"


def _side(chosen: Column) -> Column:
    turns = F.sort_array(F.collect_list(F.when(chosen, F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text"))))
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))
    return F.array_join(F.transform(turns, one), "")


def loss_mask(turns: Column, role: str = "assistant") -> Column:
    """``start:end`` of each span of ``role`` in ``render(turns)``, comma-joined."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, t):
        start = a["at"] + len(START) + F.length(t["role"]) + 1
        stop = start + F.length(t["text"]) + len(END)
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct((stop + 1).alias("at"), F.when(t["role"] == role, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda a: F.array_join(a["out"], ","))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations begin with in common."""
    least = F.least(F.size(a), F.size(b))
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.coalesce(x["a"] == x["b"], F.lit(False)))
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first == 0, least).otherwise(first - 1)


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: ``pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask``.

    ``pair`` names a turn's pair and ``chosen`` tells its side. Turns are ordered by number, then role, then
    text, so ties and repeated rows have one result; turns without a number come last. A null role or text is empty. Turns whose pair is null
    belong to no conversation and are left out. A pair with one side has an empty prompt and an empty
    completion for the other. Equal conversations are all prompt. An empty table gives no row.
    """
    kept = turns.select(pair.alias("pair_id"), F.coalesce(chosen, F.lit(False)).alias("side"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    both = kept.filter("pair_id IS NOT NULL").groupBy("pair_id").agg(_side(F.col("side")).alias("c"), _side(~F.col("side")).alias("r"))
    both = both.withColumn("n", common_turns(F.col("c"), F.col("r")))
    after = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c), F.lit(1)))
    both = both.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), render(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"), after("c").alias("c"), after("r").alias("r"))
    return both.select("pair_id", "n_prompt_turns", "prompt", render(F.col("c")).alias("chosen"), render(F.col("r")).alias("rejected"), loss_mask(F.col("c")).alias("chosen_mask"), loss_mask(F.col("r")).alias("rejected_mask"))
