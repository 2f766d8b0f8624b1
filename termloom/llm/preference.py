"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn; a mark inside a text is taken apart, so it cannot end or open one.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(turn: Column) -> Column:
    text = F.regexp_replace(turn["text"], r"<\|(im_start|im_end)\|>", "<| $1 |>")
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), text, F.lit(CLOSE), F.lit("\n"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order of turn, role and text; a missing role or text is
    empty, rows without conv_id belong to none. A conversation is one training example and so one row."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = F.transform(
        F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    )
    known = rows.where(F.col("conv_id").isNotNull())
    return known.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns.alias("turns"))


def last_reply(turns: Column) -> Column:
    """Number, from 1, of the last assistant turn; 0 without one."""
    backward = F.reverse(F.transform(turns, lambda t: t["role"] == "assistant"))
    at = F.array_position(backward, True)
    return F.when(at > 0, F.size(turns) - at + 1).otherwise(0).cast("int")


def _shown(turns: Column) -> Column:
    """Each turn as it is rendered, and how much of that comes before its text; a missing turn, role or text is empty."""
    whole = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.transform(
        F.transform(turns, whole),
        lambda t: F.struct(
            rendered(t).alias("shown"),
            (F.length(t["role"]) + F.lit(len(OPEN) + 1)).alias("lead"),
            (t["role"] == "assistant").alias("own"),
        ),
    )


def _mask(shown: Column) -> Column:
    """Start and length, in characters of the completion, of what is trained on: assistant texts with their end mark."""
    span = lambda s, t: F.struct((s["at"] + t["lead"]).alias("start"), (F.length(t["shown"]) - t["lead"] - 1).alias("length"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(
        shown,
        begin,
        lambda s, t: F.struct(
            (s["at"] + F.length(t["shown"])).alias("at"),
            F.when(t["own"], F.concat(s["spans"], F.array(span(s, t)))).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )


def preference_format(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs: two arrays of (role, text) a row. Replaces them by strings and masks.

    ``n_common`` turns are shared from the start; ``prompt`` holds them, rendered once, ``chosen`` and ``rejected`` the rest
    of each side, ``chosen_mask`` and ``rejected_mask`` the spans to train on. A side that ends with the shared turns is
    empty; a missing side has no turns. A missing turn, role or text counts as empty and keeps its place, so that an
    empty text and a missing one are the same turn. Other columns stay, but those named like new ones give way.
    """
    made = ("n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
    none = F.array().cast("array<struct<role:string,text:string>>")
    rest = [F.col(f"`{c}`") for c in pairs.columns if c not in (*made, chosen, rejected)]
    sides = pairs.select(*rest, _shown(F.coalesce(chosen, none)).alias("__c"), _shown(F.coalesce(rejected, none)).alias("__r"))
    differ = F.array_position(F.zip_with("__c", "__r", lambda a, b: a["shown"].eqNullSafe(b["shown"])), False)
    common = F.when(differ > 0, differ - 1).otherwise(F.size("__c")).cast("int")
    cut = sides.withColumn("n_common", common).select(
        *rest,
        "n_common",
        F.slice("__c", 1, F.col("n_common")).alias("__p"),
        F.slice("__c", F.col("n_common") + 1, F.size("__c")).alias("__c"),
        F.slice("__r", F.col("n_common") + 1, F.size("__r")).alias("__r"),
    )
    text = lambda name: F.array_join(F.transform(name, lambda t: t["shown"]), "")
    return cut.select(
        *rest,
        "n_common",
        text("__p").alias("prompt"),
        text("__c").alias("chosen"),
        text("__r").alias("rejected"),
        _mask(F.col("__c")).alias("chosen_mask"),
        _mask(F.col("__r")).alias("rejected_mask"),
    )


def reply_pairs(rows: DataFrame) -> DataFrame:
    """Preference pairs out of plain conversations: ``conv_id, chosen, rejected``.

    Chosen is a conversation as it is; rejected is the same up to its last assistant turn, with the last assistant
    turn of its neighbour instead (ids 2n and 2n + 1 are neighbours). Conversations whose neighbour is missing or that
    lack an assistant turn form no pair.
    """
    whole = conversations_of(rows).withColumn("at", last_reply(F.col("turns"))).where("at > 0")
    other = whole.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("at")).alias("reply")
    )
    swapped = F.concat(F.slice("turns", 1, F.col("at") - 1), F.array("reply"))
    return whole.join(other, "conv_id").select("conv_id", F.col("turns").alias("chosen"), swapped.alias("rejected"))
