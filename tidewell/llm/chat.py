"""Cumulative-snapshot collapse and chat rendering, in DataFrame functions only.

Logged conversations often repeat: every request logs the whole history so far. :func:`collapse` keeps the maximal
conversations, those whose turns are not a proper prefix of another conversation's, and one (least conv_id) of equal
ones; :func:`render` turns each into one text.

Turns are ordered by turn, then role, then text, nulls first; a turn repeated in the log stays repeated. Roles and texts
compare exactly, null apart from empty. Rows with a null conv_id are dropped. An empty table gives no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import checkpointed

START, END = "<|im_start|>", "<|im_end|>"


def numbered(turns: DataFrame, block: int = 256) -> DataFrame:
    """Turns (conv_id, pos, blk, role, text, h1, h2) with positions from 0 and a rolling hash of everything up to each.

    The rolling hash is a sum of per-turn hashes that include the position, kept as two sums of 40 bits. Sums can be
    formed by block: a block's own numbering and sums come from a window over (conversation, block of turn numbers),
    its offsets from a window over the far fewer blocks, so one very long conversation is spread over many tasks.
    """
    t = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text")
    t = t.withColumn("blk", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).cast("long"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    counts = t.groupBy("conv_id", "blk").agg(F.count("*").alias("c")).select("conv_id", "blk", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "blk").orderBy("turn", "role", "text")
    t = t.withColumn("n", F.row_number().over(inside)).join(counts, ["conv_id", "blk"])
    t = t.withColumn("pos", F.col("start") + F.col("n") - 1)
    code = lambda seed: F.shiftrightunsigned(F.xxhash64(F.lit(seed), "pos", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), F.col("role").isNull(), F.col("text").isNull()), 24)
    return t.select("conv_id", "blk", "pos", "role", "text", code(1).alias("c1"), code(2).alias("c2"))


def _prefix_sums(t: DataFrame) -> DataFrame:
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("conv_id", "blk").agg(F.sum("c1").alias("s1"), F.sum("c2").alias("s2"))
    sums = sums.select("conv_id", "blk", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (1, 2)])
    upto = Window.partitionBy("conv_id", "blk").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = t.select("conv_id", "blk", "pos", *[F.sum(f"c{i}").over(upto).alias(f"r{i}") for i in (1, 2)])
    return run.join(sums, ["conv_id", "blk"]).select("conv_id", (F.col("pos") + 1).alias("n"), (F.col("o1") + F.col("r1")).alias("h1"), (F.col("o2") + F.col("r2")).alias("h2"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns and n_copies (conversations equal to it, itself included)."""
    prefixes = checkpointed(_prefix_sums(numbered(turns)))
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("e"))
    whole = ends.groupBy("e.n", "e.h1", "e.h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.join(ends.select("conv_id", F.col("e.n").alias("last")), "conv_id").where("n < last").select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, chunk: int = 64) -> DataFrame:
    """One row per kept conversation: conv_id, n_turns, n_copies and rendered, its turns between start and end marks.

    A null role is written as an empty one, a null text as an empty one. Turns are first joined to chunk texts, then
    chunks to the whole, so no task holds more than the text of one conversation twice.
    """
    part = F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    t = numbered(turns).join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", "pos", F.floor(F.col("pos") / chunk).alias("k"), part.alias("part"))
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["s"]), "")
    t = t.groupBy("conv_id", "k").agg(joined(F.struct("pos", F.col("part").alias("s"))).alias("s"))
    t = t.groupBy("conv_id").agg(joined(F.struct("k", "s")).alias("rendered"))
    return kept.join(t, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")


def maximal_chats(turns: DataFrame) -> DataFrame:
    return render(turns, collapse(turns))
