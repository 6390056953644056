"""Cumulative-snapshot collapse: logged conversations that are prefixes of longer ones go.

Each turn gets two 64-bit hashes of its role, text and place; the running sums of their halves
are the rolling hash of the prefix that ends there. A conversation's own hash (all turns) is
looked up by anti-join among the proper prefixes of all conversations; of equal conversations
the smallest id stays. What is left is rendered.

Only hashes move through windows and joins; texts are read again for the survivors alone. All
aggregates are counts or minima for each hash, so a first turn or conversation that a third of
the log shares is combined before any exchange.

Edge cases: turns are ordered by number, nulls first; turns of one number are ordered by hash
for prefixes and by (role, text) when rendered, so the order is fixed; null roles and texts differ from empty ones in hashes and render as empty;
rows with a null conversation id are one conversation; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanloom.llm.common import materialize

LOW = 0xFFFFFFFF


KEYS = ["k", "p0", "p1", "p2", "p3"]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, p0..p3, is_last): the rolling hash after each of a conversation's turns."""
    slim = turns.select(
        "conv_id",
        "turn",
        F.xxhash64(F.lit(11), F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias("a"),
        F.xxhash64(F.lit(97), "text", F.col("text").isNull(), "role", F.col("role").isNull()).alias("b"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "a", "b")
    placed = slim.withColumns({"k": F.row_number().over(order), "is_last": F.lead(F.lit(1)).over(order).isNull()})
    halves = {}
    for i, c in enumerate("ab"):
        mixed = F.xxhash64(c, "k", F.lit(i))
        halves[f"h{2 * i}"] = mixed.bitwiseAND(F.lit(LOW))
        halves[f"h{2 * i + 1}"] = F.shiftrightunsigned(mixed, 32)
    running = order.rowsBetween(W.unboundedPreceding, 0)
    sums = [F.sum(f"h{i}").over(running).alias(f"p{i}") for i in range(4)]
    return placed.withColumns(halves).select("conv_id", "k", "is_last", *sums)


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies) of the conversations that no other one continues."""
    pre = materialize(prefixes(turns), "chat-prefixes")
    whole = pre.where("is_last").groupBy(*KEYS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    proper = pre.where(~F.col("is_last")).select(*KEYS).distinct()
    return whole.join(proper, KEYS, "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "copies")


def render(turns: DataFrame, keep: DataFrame, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """One text for each kept conversation, its turns in order."""
    t, k = turns.select("conv_id", "turn", "role", "text").alias("t"), keep.alias("k")
    rows = t.join(k, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select("t.*", "k.n_turns", "k.copies")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = rows.groupBy("conv_id", "n_turns", "copies").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    line = lambda x: F.concat(F.lit(begin), x["role"], F.lit("\n"), x["text"], F.lit(end), F.lit("\n"))
    return one.select("conv_id", "n_turns", "copies", F.array_join(F.transform("turns", line), "").alias("rendered"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations, rendered: conv_id, n_turns, copies, rendered."""
    slim = turns.select("conv_id", "turn", "role", "text")
    return render(slim, maximal(slim))
