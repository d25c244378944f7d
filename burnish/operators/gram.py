"""Sums of products of all pairs of columns, in blocks of columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from burnish.operators.tree import merged_by_tree

BLOCK = 64  # columns in a block
WAVE = 512  # pairs of blocks whose sums a task holds at once, about 200 KB each
SUMS = 6  # rows with both values, x, y, xx, yy, xy

PARTS = pa.schema([("grp", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("sums", pa.binary())])
PARTS_DDL = "grp long, a int, b int, sums binary"


class Sum:
    """A sum of arrays that carries what rounding has lost along."""

    def __init__(self) -> None:
        self.total: np.ndarray | float = 0.0
        self.lost: np.ndarray | float = 0.0

    def add(self, values: np.ndarray) -> None:
        with np.errstate(invalid="ignore"):
            now = self.total + values
            larger = np.abs(self.total) >= np.abs(values)
            lost = np.where(larger, (self.total - now) + values, (values - now) + self.total)
            self.lost = self.lost + np.where(np.isfinite(lost), lost, 0.0)
        self.total = now

    def value(self) -> np.ndarray:
        return self.total + self.lost


def pair_sums(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The six sums over rows that have both values, for each column of ``left`` with each of ``right``."""
    has_left, has_right = (~np.isnan(left)).astype(float), (~np.isnan(right)).astype(float)
    x, y = np.where(has_left > 0, left, 0.0), np.where(has_right > 0, right, 0.0)
    with np.errstate(invalid="ignore"):
        return np.stack([has_left.T @ has_right, x.T @ has_right, has_left.T @ y, (x * x).T @ has_right, has_left.T @ (y * y), x.T @ y])


def task_sums(pairs: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each pair of blocks: its sums over the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = {pair: Sum() for pair in pairs}
        seen = False
        for batch in batches:
            seen = seen or len(batch) > 0
            rows = np.column_stack([x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns])
            for a, b in pairs:
                held[a, b].add(pair_sums(*(rows[:, k * BLOCK : (k + 1) * BLOCK] for k in (a, b))))
        grp = TaskContext.get().partitionId()
        for (a, b), total in held.items() if seen else ():
            yield pa.RecordBatch.from_pylist([{"grp": grp, "a": a, "b": b, "sums": total.value().tobytes()}], PARTS)

    return run


def added(key: tuple, rows: pa.Table) -> pa.Table:
    total = Sum()
    for sums in rows.column("sums").to_pylist():
        total.add(np.frombuffer(sums))
    grp, a, b = (x.as_py() for x in key)
    return pa.Table.from_pylist([{"grp": grp, "a": a, "b": b, "sums": total.value().tobytes()}], PARTS)


CORRELATIONS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("correlation", pa.float64())])


def block_correlations(columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(i, j, correlation) of each pair of columns i < j, missing where one of them does not vary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, sums in zip(*(x.to_pylist() for x in batch.columns)):
                size = [min(BLOCK, columns - k * BLOCK) for k in (a, b)]
                n, x, y, xx, yy, xy = np.frombuffer(sums).reshape(SUMS, *size)
                with np.errstate(all="ignore"):
                    spread = (xx - x * x / n) * (yy - y * y / n)
                    share = np.abs(xy - x * y / n) / np.sqrt(spread)
                known = (n >= 2) & (spread > 0) & np.isfinite(spread) & ~np.isnan(share)
                i, j = np.indices(size) + np.array([a, b])[:, None, None] * BLOCK
                at = i < j
                value = pa.array(np.minimum(share, 1.0)[at], mask=~known[at])
                yield pa.RecordBatch.from_arrays([pa.array(i[at], pa.int32()), pa.array(j[at], pa.int32()), value], schema=CORRELATIONS)

    return run


def pair_correlations(df: DataFrame) -> DataFrame:
    """(i, j, correlation): absolute Pearson of all pairs of the columns of ``df``, which are centered doubles.

    A task sends six matrices for each pair of blocks, and they are added up in a tree. A very wide table is read once for
    each ``WAVE`` pairs of blocks, so that what a task holds does not grow with the square of the columns.
    """
    columns = len(df.columns)
    blocks = range(-(-columns // BLOCK))
    pairs = [(a, b) for a in blocks for b in blocks if a <= b]
    out = None
    for low in range(0, len(pairs), WAVE):
        sums = merged_by_tree(df.mapInArrow(task_sums(pairs[low : low + WAVE]), PARTS_DDL), ["a", "b"], added, PARTS_DDL)
        found = sums.mapInArrow(block_correlations(columns), "i int, j int, correlation double")
        out = found if out is None else out.unionByName(found)
    return out
