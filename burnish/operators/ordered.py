"""Fills that follow the row order, without sorting the table in one task.

One range shuffle deals the rows by their order key. Each range is sorted once, and the result is written with the place
of each row: its range and how many rows of the range come before it. Rows of equal keys are neighbours in that order, so
they are counted in the same pass. What crosses a range border (the last value before it, the first one after it, the
number of rows before it) is found by one small aggregate per range. There are as many ranges as Spark makes of the
shuffle, so their size is that of any other partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.columns import c
from burnish.session import cut

FILLS = ("ffill", "bfill", "interpolate")
RANGE, PLACE, START, SAME = "__range", "__place", "__start", "__same"


def order_keys(order_by: str | Sequence[str]) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def with_ranges(df: DataFrame, order_by: str | Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add the range of each row, its place there, from 0, and how many rows share its key.

    Rows of equal keys always fall into one range, so counting them needs no other shuffle than the one by range, and
    the sort that it needs is the order itself. The numbers are written with the rows, so a repeated task sees the same.
    """
    placed = cut(_dealt(df, [c(n) for n in order_keys(order_by)], ranges).withColumn(PLACE, F.monotonically_increasing_id()))
    # monotonically_increasing_id() is the number of the part times 2^33, plus the place of the row in it.
    part, within = F.shiftright(PLACE, 33).cast("int"), F.col(PLACE).bitwiseAND(F.lit(2**33 - 1))
    return placed.withColumn(RANGE, part).withColumn(PLACE, within)


def _dealt(df: DataFrame, keys: Sequence[Column], ranges: int | None) -> DataFrame:
    """Rows in ranges, in order, with the number of rows that share their key."""
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return dealt.withColumn(SAME, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _checked(edges: DataFrame, order_by: str | Sequence[str]) -> None:
    """Refuse an order that has gaps or ties, at any number of rows or ranges."""
    facts = edges.agg(F.sum("__gaps").alias("gaps"), F.sum("__rows").alias("rows"), F.max("__most").alias("most")).first()
    if facts["gaps"]:
        raise ValueError(f"order_by must be filled in every row: {facts['gaps']} values of {order_by} are missing")
    if (facts["most"] or 0) > 1:
        raise ValueError(
            f"order_by must tell rows apart: {facts['most']} of {facts['rows']} rows share one value of {order_by};"
            " name further columns to break the tie"
        )


def ordered_fill(
    df: DataFrame, fills: Mapping[str, str], order_by: str | Sequence[str], ranges: int | None = None
) -> DataFrame:
    """Fill several columns in one pass over the order: one shuffle by range, then the ranges by themselves.

    ``order_by`` is a column of any type that can be sorted, or several, the first one first. Together they have to be
    filled and to tell rows apart.
    """
    for how in fills.values():
        if how not in FILLS:
            raise ValueError(f"unknown ordered fill: {how}")
    ranged = with_ranges(df, order_by, ranges)
    # One row per range; as it is written, Spark knows its size and how to join it.
    edges = cut(_edges(ranged, fills, [c(n) for n in order_keys(order_by)]))
    _checked(edges, order_by)
    up = Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(RANGE).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)

    # Within the ranges; what comes from other ranges is joined afterwards, so that it is not shuffled.
    inside: dict[str, Column] = {}
    for i, (name, how) in enumerate(fills.items()):
        value = c(name)
        if how == "interpolate":
            value = F.when(c(name).isNotNull(), _point(F.col(PLACE), c(name)))
        if how != "bfill":
            inside[f"__earlier{i}"] = F.last(value, True).over(up)
        if how != "ffill":
            inside[f"__later{i}"] = F.last(value, True).over(down)
    rows = ranged.withColumns(inside).join(_handed_over(edges, fills), RANGE, "left")

    filled: dict[str, Column] = {}
    for i, (name, how) in enumerate(fills.items()):
        if how == "ffill":
            filled[name] = F.coalesce(F.col(f"__earlier{i}"), F.col(f"__before{i}"))
        elif how == "bfill":
            filled[name] = F.coalesce(F.col(f"__later{i}"), F.col(f"__after{i}"))
        else:
            earlier = F.coalesce(_moved(f"__earlier{i}"), F.col(f"__before{i}"))
            later = F.coalesce(_moved(f"__later{i}"), F.col(f"__after{i}"))
            rows = rows.withColumns({f"__earlier{i}": earlier, f"__later{i}": later})
            filled[name] = _on_line(F.col(START) + F.col(PLACE), F.col(f"__earlier{i}"), F.col(f"__later{i}"))
    return rows.select(*[filled[n].alias(n) if n in filled else c(n) for n in df.columns])


def _moved(point: str) -> Column:
    """A point of its range as a point of the whole table."""
    return F.when(F.col(point).isNotNull(), _point(F.col(START) + F.col(point)["place"], F.col(point)["value"]))


def _point(place: Column, value: Column) -> Column:
    return F.struct(place.cast("long").alias("place"), value.cast("double").alias("value"))


def _on_line(place: Column, earlier: Column, later: Column) -> Column:
    """Between two points on their line; after the last point, its value; before the first one, nothing."""
    rise, steps = later["value"] - earlier["value"], later["place"] - earlier["place"]
    return F.when(
        earlier.isNotNull(),
        F.when(later.isNull() | (steps == 0), earlier["value"]).otherwise(
            earlier["value"] + F.try_divide(rise, steps.cast("double")) * (place - earlier["place"])
        ),
    )


def _edges(ranged: DataFrame, fills: Mapping[str, str], keys: Sequence[Column]) -> DataFrame:
    """Per range: its rows, those without a key, the most that share one, and the first and last value of each column."""
    gap = F.lit(False)
    for key in keys:
        gap = gap | key.isNull()
    aggs = [F.count("*").alias("__rows"), F.count_if(gap).alias("__gaps"), F.max(F.when(~gap, F.col(SAME))).alias("__most")]
    for i, (name, how) in enumerate(fills.items()):
        value = c(name).cast("double") if how == "interpolate" else c(name)
        present = F.when(c(name).isNotNull(), F.col(PLACE))
        aggs += [F.min(present).alias(f"__low{i}"), F.min_by(value, present).alias(f"__first{i}")]
        aggs += [F.max(present).alias(f"__high{i}"), F.max_by(value, present).alias(f"__last{i}")]
    return ranged.groupBy(RANGE).agg(*aggs)


def _handed_over(edges: DataFrame, fills: Mapping[str, str]) -> DataFrame:
    """Per range: rows before it, the last value before it and the first value after it. One row per range."""
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn(START, F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    for i, how in enumerate(fills.values()):
        if how == "interpolate":
            for side, place in ((f"__first{i}", f"__low{i}"), (f"__last{i}", f"__high{i}")):
                point = _point(F.col(START) + F.col(place), F.col(side))
                edges = edges.withColumn(side, F.when(F.col(place).isNotNull(), point))
    return edges.select(
        RANGE,
        START,
        *[F.last(f"__last{i}", True).over(before).alias(f"__before{i}") for i in range(len(fills))],
        *[F.last(f"__first{i}", True).over(after).alias(f"__after{i}") for i in range(len(fills))],
    )
