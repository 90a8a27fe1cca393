"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns that both conversations start with are rendered once, as the prompt.  What
follows in either is its completion; a mask says which characters of it are to be
learned (what the assistant says, with the mark that ends the turn).  All of it is
array functions on one row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from palimpsest.llm.shared import by_place, picked, place

END = "<|end|>\n"


TURNS = "array<struct<role:string,text:string>>"
#: Conversations of a hashed bucket, about, in which those without integer ids find a neighbour.
BUCKET = 10_000


def turns_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text) of the turns that belong to a conversation."""
    rows = picked(turns, conv=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv is not null")
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): one row for each conversation, its turns as array<struct<role, text>> in order.

    A turn that comes twice counts once; of turns with the same number the smaller role,
    then text, comes first.  Turns of no conversation (null) are in none.  Null roles and
    texts read as empty; null numbers come first.  Texts are kept whole, however long.  Other
    columns don't matter; of columns with equal names the first is meant.
    """
    ordered = F.sort_array(F.collect_set(F.struct("turn", "role", "text")))
    rows = turns_of(turns, conv_col, turn_col, role_col, text_col).groupBy("conv")
    return rows.agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), t["text"], F.lit(END))), "")


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both start with."""
    both = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x != y), True)
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(both)


def mask(turns: Column, learned: str = "assistant") -> Column:
    """(start, end) of what is to be learned, in characters of ``rendered(turns)``."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(header(turn))
        end = start + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame, learned: str = "assistant") -> DataFrame:
    """``pairs`` (chosen and rejected: array<struct<role, text>>) with prompt_turns, prompt, and for both chosen and rejected a completion and a mask.

    Equal conversations have an empty completion each; conversations that differ from their
    first turn on have an empty prompt.  A null conversation reads as an empty one, a null
    role or text as an empty one too.  Repeated rows are returned as often as they come.
    Other columns stay, whatever their names, but those named like a result are replaced.
    """
    results = ["prompt_turns", "prompt", *[f"{c}_{k}" for c in ("chosen", "rejected") for k in ("completion", "mask")]]
    kept = [(f"c{k}", name) for k, name in enumerate(pairs.columns) if name not in ("chosen", "rejected", *results)]
    whole = lambda c: F.transform(F.coalesce(F.col(place(pairs, c)), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    rows = by_place(pairs).select(*[c for c, _ in kept], *[whole(c).alias(c) for c in ("chosen", "rejected")])
    rows = rows.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("prompt_turns") + 1, F.size(c))
    rows = rows.withColumn("prompt", rendered(F.slice("chosen", F.lit(1), F.col("prompt_turns")))).withColumns({c: rest(c) for c in ("chosen", "rejected")})
    rows = rows.withColumns({f"{c}_completion": rendered(F.col(c)) for c in ("chosen", "rejected")} | {f"{c}_mask": mask(F.col(c), learned) for c in ("chosen", "rejected")})
    return rows.select(*[c for c, _ in kept], *results).toDF(*[name for _, name in kept], *results)


def paired(rows: DataFrame) -> DataFrame:
    """``rows`` (conv and more) with ``pair``, which two conversations share: neighbours.

    Integers 2k and 2k + 1 are neighbours.  Other ids are sorted within hashed buckets, and
    each odd one is the neighbour of the next.
    """
    if isinstance(rows.schema["conv"].dataType, IntegralType):
        return rows.withColumn("pair", F.struct(F.shiftright(F.col("conv").cast("long"), 1).alias("k"), F.lit(0).alias("n")))
    ids = rows.select("conv").distinct()
    buckets = max(1, ids.count() // BUCKET)
    ids = ids.withColumn("k", F.pmod(F.xxhash64("conv"), F.lit(buckets)))
    place_ = F.row_number().over(Window.partitionBy("k").orderBy("conv"))
    return rows.join(ids.select("conv", F.struct("k", F.shiftright(place_ - 1, 1).alias("n")).alias("pair")), "conv")


def answer_swaps(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """(conv, chosen, rejected): each conversation, against the same with its neighbour's last answer in place of its own.

    Every conversation has a row and keeps all its turns, those after its last answer too.
    ``rejected`` is null where the conversation or its neighbour (see ``paired``) has no
    answer, or no neighbour is there.  Turns of two neighbours are gathered together, once;
    a conversation is one value in the result, so that group has no other bound.
    """
    rows = paired(turns_of(turns, conv_col, turn_col, role_col, text_col))
    both = rows.groupBy("pair").agg(F.sort_array(F.collect_set(F.struct("conv", "turn", "role", "text"))).alias("both"))
    one = both.select("both", F.explode(F.array_distinct(F.transform("both", lambda t: t["conv"]))).alias("conv"))
    mine = lambda yes: F.transform(F.filter("both", lambda t: (t["conv"] == F.col("conv")) == yes), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    one = one.select("conv", mine(True).alias("chosen"), F.filter(mine(False), lambda t: t["role"] == learned).alias("others"))
    last = F.aggregate(F.transform("chosen", lambda t, i: F.when(t["role"] == learned, i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    one = one.withColumn("last", last)
    swapped = F.concat(F.slice("chosen", F.lit(1), F.col("last") - 1), F.slice("others", -1, 1), F.slice("chosen", F.col("last") + 1, F.size("chosen")))
    return one.select("conv", "chosen", F.when((F.col("last") > 0) & (F.size("others") > 0), swapped).alias("rejected"))
