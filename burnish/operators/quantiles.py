"""Exact quantiles with linear interpolation, for any number of rows.

``percentile`` keeps a map of all distinct values in one buffer. A column of few distinct values is first counted per
value, by a shuffle, and only the counts reach that buffer. A column with many is narrowed instead: a sketch proposes
two pivots around each wanted rank, one aggregate counts exactly how many rows lie below them, and this repeats inside
the interval until so few rows are left that one buffer may hold them. The sketch decides only how fast the interval
shrinks; the counts make the answer exact. The rows left are counted per interval and value by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burnish.functions.columns import c

DIRECT_DISTINCT = 50_000  # distinct values that one ``percentile`` buffer may hold
GATHER_ROWS = 50_000  # rows that may be left in an interval when its ranks are read off
SKETCH_SIZE = 4_000  # its rank error is about 0.001
REACH = 0.002  # how far around a rank, as a share of the rows, the pivots lie
MERGE_GROUPS = 256  # tasks that merge sketches before the last one does
PARALLEL_JOBS = 4


@dataclass(frozen=True)
class Interval:
    """Open interval of values; ``below`` rows are at or under ``low``, ``inside`` rows are within."""

    column: str
    low: float | None
    high: float | None
    below: int
    inside: int

    def holds(self, value: Column) -> Column:
        test = value.isNotNull()
        if self.low is not None:
            test = test & (value > F.lit(self.low))
        if self.high is not None:
            test = test & (value < F.lit(self.high))
        return test


def exact_quantiles(
    df: DataFrame,
    wanted: Mapping[str, Sequence[float]],
    direct_distinct: int = DIRECT_DISTINCT,
    gather_rows: int = GATHER_ROWS,
) -> dict[tuple[str, float], float | None]:
    """{(column, probability): value}, NULLs left out; None for a column without values."""
    wanted = {name: tuple(dict.fromkeys(ps)) for name, ps in wanted.items() if ps}
    if not wanted:
        return {}
    measured = _measure(df, wanted)
    direct = [n for n, m in measured.items() if m.rows and m.distinct <= direct_distinct]
    searched = [n for n, m in measured.items() if m.rows and n not in direct]

    ranks: dict[tuple[str, int], Interval | float] = {}
    pivots: dict[tuple[str, int], Sequence[float]] = {}
    for name in searched:
        rows = measured[name].rows
        for p in wanted[name]:
            for rank in _ranks(rows, p):
                ranks[name, rank] = Interval(name, None, None, 0, rows)
                pivots[name, rank] = measured[name].around[p]
    out = {(n, p): None for n, ps in wanted.items() for p in ps}
    # Two kinds of aggregate over different columns: apart, each scans its own columns and keeps its own fast path.
    jobs = [
        lambda: _direct(df, {n: wanted[n] for n in direct}),
        lambda: _search(df, ranks, pivots, gather_rows),
    ]
    quick, found = parallel(df.sparkSession, jobs) if direct and searched else [job() for job in jobs]
    out.update(quick)
    for name in searched:
        for p in wanted[name]:
            out[name, p] = _interpolate(measured[name].rows, p, found, name)
    return out


@dataclass(frozen=True)
class Measured:
    """Rows with a value, about how many distinct values, and two values around each wanted quantile."""

    rows: int
    distinct: float
    around: Mapping[float, Sequence[float]]


def _measure(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, Measured]:
    """The first pass, which decides the way for each column and gives the first pivots."""
    value = {n: c(n).cast("double") for n in wanted}
    some = {n: F.when(value[n].isNotNull(), F.xxhash64(value[n])) for n in wanted}
    parts = df.groupBy(_merge_group()).agg(
        *[F.count(value[n]).alias(f"rows{i}") for i, n in enumerate(wanted)],
        *[F.hll_sketch_agg(some[n]).alias(f"hll{i}") for i, n in enumerate(wanted)],
        *[F.kll_sketch_agg_double(value[n], F.lit(SKETCH_SIZE)).alias(f"kll{i}") for i, n in enumerate(wanted)],
    )
    aggs = {}
    for i, (n, ps) in enumerate(wanted.items()):
        aggs[n, "rows"] = F.coalesce(F.sum(f"rows{i}"), F.lit(0))
        aggs[n, "distinct"] = F.hll_sketch_estimate(F.hll_union_agg(f"hll{i}"))
        aggs[n, "around"] = _merged_quantiles(f"kll{i}", f"rows{i}", [side for p in ps for side in _sides(p)])
    found = one_row(parts, aggs)
    out = {}
    for n, ps in wanted.items():
        around = found[n, "around"] or [None] * (2 * len(ps))
        pairs = {p: around[2 * i : 2 * i + 2] for i, p in enumerate(ps)}
        out[n] = Measured(found[n, "rows"], found[n, "distinct"] or 0, pairs)
    return out


def _sides(share: float) -> tuple[float, float]:
    return max(0.0, share - REACH), min(1.0, share + REACH)


def _merge_group() -> Column:
    """Sketches of all tasks would be too much for one task to merge, so they are merged in groups of tasks first."""
    return (F.spark_partition_id() % MERGE_GROUPS).alias("group")


def _merged_quantiles(sketch: str, rows: str, shares: Sequence[float]) -> Column:
    """Quantiles of the groups' sketches together; NULL where no group has a row."""
    merged = F.kll_merge_agg_double(F.when(F.col(rows) > 0, F.col(sketch)))
    return F.when(F.sum(rows) > 0, F.kll_sketch_get_quantile_double(merged, F.lit(list(shares))))


def one_row(df: DataFrame, aggs: Mapping[str, Column]) -> dict[str, object]:
    """One aggregate job; the result by name."""
    if not aggs:
        return {}
    row = df.agg(*[value.alias(f"a{i}") for i, value in enumerate(aggs.values())]).first()
    return dict(zip(aggs, row))


def parallel(spark: SparkSession, jobs: Sequence[Callable[[], object]]) -> list:
    """Run independent small-result jobs side by side, so that a cluster is not idle between them."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(PARALLEL_JOBS) as pool:
        return list(pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs))


def _ranks(rows: int, p: float) -> tuple[int, ...]:
    position = (rows - 1) * p
    return tuple(dict.fromkeys((math.floor(position), math.ceil(position))))


def _interpolate(rows: int, p: float, found: Mapping, name: str) -> float:
    position = (rows - 1) * p
    low, high = found[name, math.floor(position)], found[name, math.ceil(position)]
    if low == high:
        return low
    return (math.ceil(position) - position) * low + (position - math.floor(position)) * high


def _direct(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[tuple[str, float], float]:
    """Quantiles of columns with few distinct values, from the rows per value."""
    if not wanted:
        return {}
    shares = list(dict.fromkeys(p for ps in wanted.values() for p in ps))
    cells = df.select(*[c(n).cast("double").alias(n) for n in wanted]).unpivot([], [c(n) for n in wanted], "column", "value")
    counted = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    cuts = F.percentile("value", F.array(*[F.lit(p) for p in shares]), F.col("n")).alias("cuts")
    found = {r["column"]: dict(zip(shares, r["cuts"])) for r in counted.groupBy("column").agg(cuts).collect()}
    return {(n, p): found[n][p] for n, ps in wanted.items() for p in ps}


def _search(df: DataFrame, ranks: Mapping, pivots: Mapping, gather_rows: int) -> dict:
    """Narrow every rank to a value, starting with the given pivots."""
    ranks = dict(ranks)
    while True:
        open_ranks = {k: v for k, v in ranks.items() if isinstance(v, Interval) and v.inside > gather_rows}
        if not open_ranks:
            return _gather(df, ranks)
        pivots = pivots or _pivots(df, open_ranks)
        counts: dict[tuple[str, float, str], Column] = {}
        for key in open_ranks:
            value = c(key[0]).cast("double")
            for pivot in pivots[key]:
                counts[key[0], pivot, "under"] = F.count_if(value < F.lit(pivot))
                counts[key[0], pivot, "upto"] = F.count_if(value <= F.lit(pivot))
        counted = one_row(df, counts)
        for key, interval in open_ranks.items():
            ranks[key] = _narrow(interval, key[1], pivots[key], counted)
        pivots = {}


def _pivots(df: DataFrame, open_ranks: Mapping[tuple[str, int], Interval]) -> dict:
    """Two values around each rank, out of its interval; ranks that share an interval share its sketch."""
    values, shares = {}, {}
    for interval in dict.fromkeys(open_ranks.values()):
        value = c(interval.column).cast("double")
        values[interval] = F.when(interval.holds(value), value)
        held = [key for key, other in open_ranks.items() if other == interval]
        middles = [(rank - interval.below + 0.5) / interval.inside for _, rank in held]
        shares[interval] = [side for m in middles for side in _sides(m)]
    found = sketched_quantiles(df, values, shares)
    out = {}
    for interval in values:
        held = [key for key, other in open_ranks.items() if other == interval]
        out.update({key: found[interval][2 * i : 2 * i + 2] for i, key in enumerate(held)})
    return out


def sketched_quantiles(
    df: DataFrame, values: Mapping[object, Column], shares: Mapping[object, Sequence[float]], size: int = SKETCH_SIZE
) -> dict[object, list[float]]:
    """Approximate quantiles of expressions."""
    parts = df.groupBy(_merge_group()).agg(
        *[F.kll_sketch_agg_double(v, F.lit(size)).alias(f"kll{i}") for i, v in enumerate(values.values())],
        *[F.count(v).alias(f"rows{i}") for i, v in enumerate(values.values())],
    )
    return one_row(parts, {k: _merged_quantiles(f"kll{i}", f"rows{i}", shares[k]) for i, k in enumerate(values)})


def _narrow(interval: Interval, rank: int, pivots: Sequence[float], counted: Mapping) -> Interval | float:
    """The part of the interval that holds the rank; a pivot that is the answer ends the search.

    Pivots are values of the column, so every part is strictly smaller than the interval.
    """
    name = interval.column
    low, below = interval.low, interval.below
    for pivot in sorted(set(pivots)):
        under, upto = counted[name, pivot, "under"], counted[name, pivot, "upto"]
        if rank < under:
            return Interval(name, low, pivot, below, under - below)
        if rank < upto:
            return pivot
        low, below = pivot, upto
    return Interval(name, low, interval.high, below, interval.below + interval.inside - below)


def _gather(df: DataFrame, ranks: Mapping) -> dict:
    """Read off the ranks among the few rows left in each interval, whose size has been counted.

    Intervals of one column do not overlap, so a row is in one of them at most. Rows are counted per interval and
    value, and each interval is summed by itself: no task holds more than one interval at a time.
    """
    held = {key: interval for key, interval in ranks.items() if isinstance(interval, Interval)}
    if not held:
        return dict(ranks)
    number = {interval: i for i, interval in enumerate(dict.fromkeys(held.values()))}
    cells = []
    for name in dict.fromkeys(interval.column for interval in number):
        value, which = c(name).cast("double"), F.lit(None).cast("int")
        for interval, i in number.items():
            if interval.column == name:
                which = F.when(interval.holds(value), F.lit(i)).otherwise(which)
        cells.append(F.when(which.isNotNull(), F.struct(which.alias("interval"), value.alias("value"))))
    rows = df.select(F.inline(F.array_compact(F.array(*cells))))
    counted = rows.groupBy("interval", "value").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("interval").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = counted.withColumn("upto", F.sum("n").over(upto))
    places = [(number[interval], key[1] - interval.below + 1) for key, interval in held.items()]
    wanted = local_rows(df.sparkSession, places)
    hit = counted.join(F.broadcast(wanted), "interval").where("upto >= place and upto - n < place")
    found = {(r["interval"], r["place"]): r["value"] for r in hit.select("interval", "place", "value").collect()}
    values = {key: found[number[interval], key[1] - interval.below + 1] for key, interval in held.items()}
    return {key: values.get(key, kept) for key, kept in ranks.items()}


def local_rows(spark: SparkSession, places: Sequence[tuple[int, int]]) -> DataFrame:
    arrays = [pa.array([p[k] for p in places], kind) for k, kind in enumerate((pa.int32(), pa.int64()))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=["interval", "place"]))
