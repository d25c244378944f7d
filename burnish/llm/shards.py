"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.llm.common import keep

#: A group at least this part of a shard's fair share is packed by itself, so there are at most shards * GRAINS of
#: them; smaller groups are bundled up to that size first. The packing then sees a bounded number of items.
GRAINS = 2_048
#: Buckets in which small groups are bundled, and parts in which the rows of a shard are numbered.
BUNDLE_BUCKETS = 4_096
SLOT_PARTS = 256


def best_fit(sizes: list[int], capacity: int, at_most: int) -> list[int] | None:
    """The bin of each size: the bin it fits with the least room left over, or a new bin.

    Sizes come largest first. A size above the capacity gets a bin of its own. The bins stand in order of remaining
    capacity and are searched by bisection. None when more than ``at_most`` bins would be needed.
    """
    room: list[tuple[int, int]] = []
    bins, used = [], 0
    for size in sizes:
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        elif used == at_most:
            return None
        else:
            left, number = max(capacity, size), used
            used += 1
        insort(room, (left - size, number))
        bins.append(number)
    return bins


def even_fit(sizes: list[int], shards: int) -> list[int]:
    """Best fit into a given number of bins: the smallest capacity for which they suffice, found by bisection."""
    low = -(-sum(sizes) // shards)
    high = low + (sizes[0] if sizes else 0)
    while best_fit(sizes, high, shards) is None:
        high += max(1, high // 8)
    while low < high:
        middle = (low + high) // 2
        if best_fit(sizes, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return best_fit(sizes, high, shards) or []


def shard_rows(
    df: DataFrame,
    shards: int | None = None,
    capacity: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Put every row into a shard; rows of equal text always share one.

    Give ``shards`` for that many shards of near equal bytes, or ``capacity`` for as few shards as best fit needs with
    at most that many bytes each. A row's size is the UTF-8 bytes of its text, plus 1. Result: the id, ``size``,
    ``text_crc32``, ``shard``, and ``slot``, which numbers the rows of a shard from 0 without gaps.

    A missing text has no bytes and a checksum of 0; missing texts form a group of their own. A group larger than a
    shard's share (or the capacity) stays whole and gets a shard to itself. Repeated rows are rows like any other. An
    empty table gives an empty result. Other columns are not looked at.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark = df.sparkSession
    text = F.col(text_column)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    rows = keep(
        df.select(
            F.col(id_column).alias("doc_id"),
            size.alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            # Texts that meet in this key only by chance would share a shard, which breaks nothing.
            F.xxhash64(text, size).alias("group"),
        ),
        "sizes",
    )
    groups = keep(rows.groupBy("group").agg(F.sum("size").alias("bytes")), "groups")
    total, _ = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    share = capacity if capacity is not None else -(-total // shards)
    grain = max(1, share // GRAINS)
    # Small groups: by hash into buckets, largest first in each, and cut where the running size passes a grain.
    bucket = F.pmod(F.xxhash64("group", F.lit(7)), F.lit(BUNDLE_BUCKETS))
    small = groups.where(F.col("bytes") < grain).withColumn("bucket", bucket)
    before = Window.partitionBy("bucket").orderBy(F.desc("bytes"), "group").rowsBetween(Window.unboundedPreceding, -1)
    small = small.withColumn("part", F.floor(F.coalesce(F.sum("bytes").over(before), F.lit(0)) / grain).cast("long"))
    large = groups.where(F.col("bytes") >= grain).select(
        "group", "bytes", F.lit(-1).cast("long").alias("bucket"), F.col("group").alias("part")
    )
    items = keep(large.unionByName(small.select("group", "bytes", "bucket", "part")), "items")
    # At most shards * GRAINS large items, and BUNDLE_BUCKETS + shards * GRAINS bundles, at any size of the table.
    packed = items.groupBy("bucket", "part").agg(F.sum("bytes").alias("bytes"))
    listed = sorted(((r["bytes"], r["bucket"], r["part"]) for r in packed.collect()), key=lambda x: (-x[0], x[1], x[2]))
    sizes = [x[0] for x in listed]
    bins = even_fit(sizes, shards) if shards is not None else best_fit(sizes, capacity, len(sizes)) or []
    table = spark.createDataFrame(
        [(bucket, part, shard) for (_, bucket, part), shard in zip(listed, bins)], "bucket long, part long, shard int"
    )
    homes = keep(items.join(table, ["bucket", "part"]).select("group", "shard"), "homes")
    placed = rows.join(homes, "group").select("doc_id", "size", "text_crc32", "shard")
    return numbered(placed)


def numbered(placed: DataFrame) -> DataFrame:
    """Add ``slot``: the rows of each shard from 0 without gaps.

    A shard's rows are numbered in parts by the hash of their id, after the rows of the parts before it, so no task
    sorts a whole shard.
    """
    placed = keep(
        placed.withColumn("_part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SLOT_PARTS)).cast("int")), "placed"
    )
    # One row for each shard and part.
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    starts = starts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "size", "text_crc32")
    ranked = placed.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_rank")).cast("long").alias("slot")
    )
