"""Preference formatting: the turns that chosen and rejected conversation share become one prompt, the rest two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turns of a pair that are gathered into one row; longer conversations go on in further rows (chunk 1, 2, ...).
CHUNK_TURNS = 256


def _escaped(text: Column) -> Column:
    """The markers inside a text are broken by a space, so that it cannot open or close turns."""
    return F.replace(F.replace(text, F.lit(START), F.lit("<| im_start|>")), F.lit(END), F.lit("<| im_end|>"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) with pos 0, 1, ... in turn order; null turns come first, equal ones by role and text.

    Rows without conv_id belong to no conversation and are left out; null role and text are empty.
    """
    known = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return known.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "role", "text")


def exchanged_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: every conversation that has a reply. Rejected: the same with its last reply exchanged for the next conversation's.

    The next conversation is the one with the following conv_id; where it is missing or has no reply, the rejected reply is empty.
    """
    chosen = numbered(turns)
    last = chosen.where("role = 'assistant'").groupBy("conv_id").agg(F.max_by(F.struct("pos", "text"), "pos").alias("last"))
    donors = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    swap = last.join(donors, "conv_id", "left").select("conv_id", F.col("last.pos").alias("at"), F.coalesce("other", F.lit("")).alias("other"))
    both = chosen.join(swap, "conv_id")
    rejected = both.select("conv_id", "pos", "role", F.when(F.col("pos") == F.col("at"), F.col("other")).otherwise(F.col("text")).alias("text"))
    return both.select("conv_id", "pos", "role", "text"), rejected


def format_pairs(chosen: DataFrame, rejected: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(pair_id, chunk, shared_turns, prompt, chosen, rejected, chosen_loss, rejected_loss), pairs by conv_id.

    Both inputs have conv_id, pos (unique in a conversation, from 0), role, text. ``shared_turns`` is the length of the longest
    common prefix by role and text. The prompt renders it once; the completions render what follows, possibly nothing. The loss
    spans, code-point offsets into the completion, cover the replies with their end marks; nothing of the prompt is trained on.
    Conversations over ``chunk_turns`` turns take several rows, texts and offsets of chunk n following those of chunk n-1, so no task
    gathers an unbounded group. A conversation on one side only has an empty other side and no common prefix.
    """
    c = chosen.select("conv_id", "pos", F.struct("role", "text").alias("c"))
    r = rejected.select("conv_id", "pos", F.struct("role", "text").alias("r"))
    turns = c.join(r, ["conv_id", "pos"], "full")
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    cut = turns.groupBy("conv_id").agg(F.coalesce(F.min(F.when(differs, F.col("pos"))), F.max("pos") + 1).alias("shared_turns"))
    marked = turns.join(cut, "conv_id").withColumn("chunk", F.floor(F.col("pos") / chunk_turns).cast("long"))
    rows = marked.groupBy("conv_id", "chunk", "shared_turns").agg(F.array_sort(F.collect_list(F.struct("pos", "c", "r"))).alias("turns"))

    def side(name: str, prompt: bool) -> Column:
        inside = F.filter("turns", lambda t: t[name].isNotNull() & ((t["pos"] < F.col("shared_turns")) if prompt else (t["pos"] >= F.col("shared_turns"))))
        return F.transform(inside, lambda t: F.struct(
            t[name]["role"].alias("role"), F.concat(F.lit(START), t[name]["role"], F.lit("\n")).alias("head"),
            F.concat(_escaped(t[name]["text"]), F.lit(END + "\n")).alias("body")))

    def line(parts: Column) -> Column:
        return F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"])), "")

    def loss(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(state: Column, part: Column) -> Column:
            begin = state["at"] + F.length(part["head"])
            end = begin + F.length(part["body"])
            more = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
            return F.struct(end.cast("long").alias("at"), F.when(part["role"] == "assistant", F.concat(state["spans"], more)).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(parts, start, step, lambda state: state["spans"])

    sides = rows.select(F.col("conv_id").alias("pair_id"), "chunk", "shared_turns", side("c", True).alias("p"), side("c", False).alias("c"), side("r", False).alias("r"))
    return sides.select("pair_id", "chunk", "shared_turns", line(F.col("p")).alias("prompt"), line(F.col("c")).alias("chosen"), line(F.col("r")).alias("rejected"),
                        loss(F.col("c")).alias("chosen_loss"), loss(F.col("r")).alias("rejected_loss"))
