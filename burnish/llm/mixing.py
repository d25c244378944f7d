"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import keep, unused, word_count

#: The golden ratio as a fraction of 2**32: source k starts at the point (k + 1) * GOLDEN mod 2**32 of the schedule.
GOLDEN = 2_654_435_769
POINTS = 2**32
#: Words that a slot takes at most, and slots that a table is cut into at least while they take a word or more. Large
#: tables get more slots, not longer ones.
BLOCK_WORDS = 256
SLOTS = 2**18
#: Slots of a source that are made together, parts in which slots are numbered, and parts in which the documents of a
#: source are shuffled and summed.
SLOT_CHUNK = 4_096
SLOT_PARTS = 4_096
SHUFFLE_PARTS = 256
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The target of each source, from rows (source, size): one row per source.

    Sources in code point order, missing last, get the weights in turn. Targets share the sum of all sizes by weight,
    stop at ``most`` times the source's size, and the excess goes to the others by weight until none is above. That is
    a water level: with sources in order of limit per weight, those up to some place stand at their limit and the
    rest share what is left, so two running sums give it without a loop. Columns: source, source_no, source_size,
    weight, target.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source: a description of the corpus, not the corpus.
    named = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = totals.withColumn("source_no", (F.row_number().over(named) - 1).cast("long")).withColumn("weight", turn)
    totals = totals.withColumn("limit", F.col("source_size") * most)
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "source_no")
    above = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(below), F.lit(0))) / F.sum(
        "weight"
    ).over(above)
    # The level at which this source and all after it would share the rest. The first that stays below its limit is
    # the level of all; a source before it stands at its limit.
    totals = totals.withColumn("level", level).withColumn(
        "share", F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    )
    totals = totals.withColumn("share", F.max("share").over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("share") * F.col("weight"))
    return totals.select("source", "source_no", "source_size", "weight", target.cast("double").alias("target"))


def words_due(most: int = MOST_REPEATS) -> Column:
    """The words that the mix takes of a source: its target as a whole number, at least 1 where the target is positive."""
    due = F.least(F.greatest(F.round("target"), F.lit(1.0)), (F.col("source_size") * most).cast("double"))
    return F.when(F.col("target") > 0, due).otherwise(0).cast("long")


def schedule(targets: DataFrame, block: int, most: int = MOST_REPEATS) -> DataFrame:
    """The slots in their order: rows (slot, source_no, block), one for each block of each source's words.

    A source of n blocks has them at (j + f) / n for j from 0 to n - 1, with f from the points of the golden ratio, so
    that sources are out of step and those of one block spread evenly. Up to any place each source has had its part of
    its blocks, to within one. Slots are numbered within parts of the schedule, after those of the parts before.
    """
    blocks = F.ceil(words_due(most) / block).cast("long")
    first = (F.col("source_no") + 1) * GOLDEN % POINTS / F.lit(float(POINTS))
    counts = targets.select("source_no", blocks.alias("blocks"), first.alias("first")).where("blocks > 0")
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / SLOT_CHUNK))
    chunked = counts.withColumn("chunk", F.explode(chunks)).repartition("source_no", "chunk")
    low = F.col("chunk") * SLOT_CHUNK
    each = F.sequence(low, F.least(low + SLOT_CHUNK, F.col("blocks")) - 1)
    slots = chunked.withColumn("block", F.explode(each))
    slots = slots.withColumn("place", (F.col("block") + F.col("first")) / F.col("blocks"))
    slots = slots.withColumn("part", F.floor(F.col("place") * SLOT_PARTS)).select("source_no", "block", "place", "part")
    slots = keep(slots, "slots")
    # One row for each part.
    earlier = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("place", "source_no")
    ranked = slots.withColumn("rank", F.row_number().over(within) - 1).join(starts, "part")
    return ranked.select((F.col("start") + F.col("rank")).alias("slot"), "source_no", "block")


def mix(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    slots: int = SLOTS,
    seed: int = 17,
    shuffle_by: tuple[str, ...] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows with what the mix takes of them, and the schedule itself.

    The documents of each source, shuffled by hash, form a stream of words that repeats up to ``most`` times. Its first
    words, as many as the target says, are taken: rounded, and at least one where the target is positive. They are
    cut into blocks of equally many words, the last one shorter, and the j-th slot of a source in the schedule takes
    its j-th block. A block has BLOCK_WORDS words, or fewer in a table that would give less than ``slots`` blocks.

    First result, one row per row of ``df``: doc_id, source, size, source_size, target, row_no (tells equal ids
    apart), ``start`` (words before it in the stream) and taken. Second result: slot, source_no, block, row_no, words
    and ``from_word``: the pieces of documents in the order of the mix.

    A missing or empty text has size 0 and gives nothing; a source of such texts has target 0. A missing source is a
    source. Repeated rows are rows like any other. The same table gives the same mix. An empty table gives empty
    results. Other columns are not looked at.
    """
    sized = df.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.xxhash64(*(shuffle_by or (id_column, text_column)), F.lit(seed)).alias("order"),
    )
    sized = keep(sized.withColumn("part", F.pmod("order", F.lit(SHUFFLE_PARTS))), "sizes")
    targets = keep(source_targets(sized, weights, most), "targets")
    # Places in the stream of each source: sums by part first, then within the parts.
    sums = sized.groupBy("source", "part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        "source", "part",
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    same = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size")
    inside = same.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.withColumn("row_in_part", F.row_number().over(same) - 1)
    on = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.part") == F.col("s.part"))
    placed = placed.alias("p").join(sums.alias("s"), on).select(
        "p.doc_id", "p.source", "p.size",
        (F.col("words_before") + F.col("inside")).alias("start"),
        (F.col("rows_before") + F.col("row_in_part")).alias("row_no"),
    )
    # One row for each source, which the planner broadcasts only where it is small.
    on = F.col("p.source").eqNullSafe(F.col("t.source"))
    placed = placed.alias("p").join(targets.alias("t"), on).select(
        "doc_id", "p.source", "source_no", "size", "source_size", "target", "start", "row_no"
    )
    placed = keep(placed, "placed")
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, min(BLOCK_WORDS, -(-total // slots)))
    plan = schedule(targets, block, most)
    # The blocks that each repeat of a document touches, as far as the source's words are due.
    again = placed.where("size > 0").withColumn("due", words_due(most))
    again = again.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    first = F.col("start") + F.col("repeat") * F.col("source_size")
    again = again.withColumn("first", first).where("first < due")
    again = again.withColumn("last", F.least(F.col("first") + F.col("size"), F.col("due")))
    touched = again.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("last") - 1) / block)))
    )
    from_word = F.greatest(F.col("block") * block - F.col("first"), F.lit(0))
    to_word = F.least((F.col("block") + 1) * block, F.col("last")) - F.col("first")
    pieces = touched.select(
        "source_no", "block", "row_no", "repeat", from_word.alias("from_word"), (to_word - from_word).alias("words")
    )
    pieces = keep(pieces.join(plan, ["source_no", "block"]), "pieces")
    taken = pieces.groupBy("source_no", "row_no").agg(F.sum("words").alias("taken"))
    rows = placed.join(taken, ["source_no", "row_no"], "left").withColumn(
        "taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long")
    )
    return rows, pieces


def mixed_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Whole documents in the amounts of the mix, with the columns of ``df``; a document comes up to ``most`` times.

    A repeat of a document is in when the mix takes more than half of its words in that repeat. As the mix takes a
    source's stream from its start, that leaves each source within one document of what the mix takes. The first
    document of a source's stream is in whenever the mix takes words of it, so no source is lost by rounding. Documents
    without words have nothing to repeat and stay as they are.
    """
    row, count, copy = (unused(df, n) for n in ("_row", "_copies", "_copy"))
    marked = keep(df.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows, _ = mix(marked, row, text_column, shuffle_by=(id_column, text_column), **options)
    most = options.get("most", MOST_REPEATS)
    half = F.floor((F.col("taken") + F.floor(F.col("size") / 2)) / F.greatest("size", F.lit(1)))
    least = ((F.col("start") == 0) & (F.col("taken") > 0)).cast("long")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.least(F.greatest(half, least), F.lit(most)))
    counted = rows.select(F.col("doc_id").alias(row), copies.cast("int").alias(count)).where(F.col(count) > 0)
    repeated = marked.join(counted, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
    return repeated.select(*df.columns)
