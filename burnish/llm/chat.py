"""Chat formatting: conversations that were logged again and again as they grew are kept once, then rendered.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import keep

#: Turns that are numbered, hashed and rendered together, so that no task needs a whole conversation at once.
PART = 1_024


def _turn_hash(seed: int) -> Column:
    """A hash of a turn and its place. It tells a missing role or text from an empty one."""
    return F.xxhash64(
        F.lit(seed), "place", "role", F.col("role").isNull(), "content", F.col("content").isNull()
    )


def placed_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with their place from 1, the turns of their conversation, and two hashes of all turns up to them.

    A prefix hash is the exclusive or of the hashes of its turns, each with its place. So parts of a conversation are
    hashed by themselves, and those before a part are added from one row per part.
    """
    turns = df.select(
        F.col(conversation).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.col(role).alias("role"),
        F.col(text).alias("content"),
        F.xxhash64(F.col(conversation), F.col(conversation).isNull()).alias("key"),
        F.coalesce(F.floor(F.col(turn) / PART), F.lit(-(2**60))).cast("long").alias("block"),
    )
    turns = keep(turns, "turns")
    by_block = Window.partitionBy("key", "block")
    row = F.row_number().over(by_block.orderBy("turn", "role", "content"))
    counted = turns.groupBy("key", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select(
        "key", "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("key")).alias("n_turns"),
    )
    turns = turns.withColumn("row", row).join(counted, ["key", "block"])
    turns = turns.withColumn("place", F.col("before") + F.col("row"))
    turns = keep(turns.withColumns({"h1": _turn_hash(1), "h2": _turn_hash(2)}), "hashed")
    sums = turns.groupBy("key", "block").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"))
    sums = sums.select(
        "key", "block",
        F.coalesce(F.bit_xor("b1").over(before), F.lit(0)).alias("b1"),
        F.coalesce(F.bit_xor("b2").over(before), F.lit(0)).alias("b2"),
    )
    upto = by_block.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = turns.withColumns({"r1": F.bit_xor("h1").over(upto), "r2": F.bit_xor("h2").over(upto)})
    return rolled.join(sums, ["key", "block"]).select(
        "key", "conv_id", "place", "n_turns", "role", "content",
        F.col("r1").bitwiseXOR(F.col("b1")).alias("p1"),
        F.col("r2").bitwiseXOR(F.col("b2")).alias("p2"),
    )


def rendered_turn() -> Column:
    """One turn as text. A missing role is ``unknown``, a missing text is empty."""
    role, content = F.coalesce("role", F.lit("unknown")), F.coalesce("content", F.lit(""))
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), content, F.lit("<|im_end|>\n"))


def maximal_conversations(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The conversations that are not the beginning of a longer one, rendered.

    A conversation whose turns (role and text) are the first turns of another, longer one is dropped; of conversations
    with the same turns the one with the smallest id stays. Result: conv_id, n_turns, n_copies (conversations with the
    same turns), ``part`` and the rendered ``text``. A part holds up to 1,024 turns, so most conversations have one,
    part 0, and a very long one is not gathered whole.

    Turns stand in order of their number, missing numbers first; equal numbers in order of role and text, and repeated
    turns are turns like any other. Turns without a conversation id form one conversation. A missing role is not the
    same as an empty one; the same for texts. An empty table gives an empty result. Other columns are not looked at.
    """
    turns = keep(placed_turns(df, conversation, turn, role, text), "turns")
    ends = turns.where("place = n_turns")
    # Copies meet here before anything else looks at them.
    groups = ends.groupBy("n_turns", "p1", "p2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")).alias("first"),
        F.count("*").alias("n_copies"),
    )
    inner = turns.where("place < n_turns").select(F.col("place").alias("n_turns"), "p1", "p2").distinct()
    maximal = groups.join(inner, ["n_turns", "p1", "p2"], "left_anti")
    maximal = keep(maximal.select(F.col("first.key").alias("key"), "n_copies"), "maximal")
    parts = (
        turns.join(maximal, "key")
        .withColumn("part", F.floor((F.col("place") - 1) / PART).cast("int"))
        .groupBy("key", "part")
        .agg(
            F.first("conv_id").alias("conv_id"),
            F.first("n_turns").alias("n_turns"),
            F.first("n_copies").alias("n_copies"),
            F.sort_array(F.collect_list(F.struct("place", rendered_turn().alias("turn")))).alias("turns"),
        )
    )
    return parts.select("conv_id", "n_turns", "n_copies", "part", F.array_join("turns.turn", "").alias("text"))
