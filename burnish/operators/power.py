"""Exponents of the Yeo-Johnson transform by maximum likelihood, for all columns at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c

ROUNDS = 7
HALF_WIDTH = 10  # grid points on each side of the middle
FIRST_STEP = 0.5
MERGE_GROUPS = 64  # tasks that merge sums before the driver does
CHUNK = 20_000  # rows that are transformed together, which stay in a processor's cache


def transformed(values: np.ndarray, power: float) -> np.ndarray:
    """Yeo-Johnson of numbers of one sign, as ``functions.columns.yeo_johnson`` has it."""
    if not len(values) or values[0] >= 0:
        return np.log1p(values) if abs(power) < 1e-12 else (np.power(values + 1, power) - 1) / power
    return -transformed(-values, 2 - power)


@dataclass
class Moments:
    """Rows, their sum of logarithms, and the mean and sum of squared deviations under each exponent."""

    rows: int
    logs: float
    mean: np.ndarray
    squares: np.ndarray

    def join(self, other: Moments) -> Moments:
        """Both together; means differ by what lies between the groups, which is added to the squares."""
        if not self.rows or not other.rows:
            return other if other.rows else self
        rows = self.rows + other.rows
        with np.errstate(all="ignore"):
            apart = other.mean - self.mean
            mean = self.mean + apart * (other.rows / rows)
            squares = self.squares + other.squares + apart * apart * (self.rows * other.rows / rows)
        return Moments(rows, self.logs + other.logs, mean, squares)


def moments(values: np.ndarray, powers: Sequence[float]) -> Moments:
    out = Moments(0, 0.0, np.zeros(len(powers)), np.zeros(len(powers)))
    for low in range(0, len(values), CHUNK):
        some = values[low : low + CHUNK]
        logs = float((np.sign(some) * np.log1p(np.abs(some))).sum())
        for part in (some[some >= 0], some[some < 0]):
            if len(part):
                with np.errstate(all="ignore"):
                    fitted = np.stack([transformed(part, p) for p in powers])
                    mean = fitted.mean(axis=1)
                    out = out.join(Moments(len(part), 0.0, mean, ((fitted - mean[:, None]) ** 2).sum(axis=1)))
        out.logs += logs
    return out


PARTS_DDL = "at int, rows long, logs double, mean array<double>, squares array<double>"
PARTS = pa.schema([("at", pa.int32()), ("rows", pa.int64()), ("logs", pa.float64()), ("mean", pa.list_(pa.float64())), ("squares", pa.list_(pa.float64()))])


def _row(at: int, found: Moments) -> dict:
    return {"at": at, "rows": found.rows, "logs": found.logs, "mean": found.mean.tolist(), "squares": found.squares.tolist()}


def _moments(row: Mapping) -> Moments:
    return Moments(row["rows"], row["logs"], np.array(row["mean"]), np.array(row["squares"]))


def task_moments(grids: Mapping[int, Sequence[float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each column: what a task's rows have under each exponent of the column's grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for (at, grid), column in zip(grids.items(), batch.columns):
                values = column.to_numpy(zero_copy_only=False).astype(float)
                found = moments(values[~np.isnan(values)], grid)
                held[at] = held[at].join(found) if at in held else found
        if held:
            yield pa.RecordBatch.from_pylist([_row(at, found) for at, found in held.items()], PARTS)

    return run


def joined(key: tuple, rows: pa.Table) -> pa.Table:
    parts = [_moments(row) for row in rows.to_pylist()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part)
    return pa.Table.from_pylist([_row(key[0].as_py(), out)], PARTS)


def column_moments(df: DataFrame, names: Sequence[str], grids: Mapping[int, Sequence[float]]) -> dict[int, Moments]:
    """One job for all columns. Every task sends one row for each column; tasks' rows are joined in groups first."""
    values = df.select(*[c(names[at]).cast("double").alias(f"x{at}") for at in grids])
    parts = values.mapInArrow(task_moments(grids), PARTS_DDL)
    parts = parts.groupBy("at", (F.spark_partition_id() % MERGE_GROUPS).alias("grp"))
    out: dict[int, Moments] = {}
    for row in parts.applyInArrow(joined, PARTS_DDL).collect():
        found = _moments(row)
        out[row["at"]] = out[row["at"]].join(found) if row["at"] in out else found
    return out


@dataclass
class Search:
    """Where the best exponent of a column is looked for."""

    middle: float = 0.0
    step: float = FIRST_STEP
    enclosed: bool = False
    found: Mapping[str, float | None] | None = None

    def grid(self) -> list[float]:
        return [self.middle + i * self.step for i in range(-HALF_WIDTH, HALF_WIDTH + 1)]

    def look(self, seen: Moments, finest: float) -> None:
        grid = self.grid()
        scores = [_likelihood(seen.rows, seen.logs, p, v) for p, v in zip(grid, seen.squares / max(1, seen.rows))]
        best = max(range(len(grid)), key=scores.__getitem__)
        if scores[best] == -math.inf:
            # No exponent spreads the values: they stay as they are, moved to mean 0.
            self.middle, self.step = 1.0, 0.0
            if 1.0 not in grid:
                return
            best = grid.index(1.0)
        else:
            self.middle = grid[best]
            self.enclosed = self.enclosed or 0 < best < len(grid) - 1
            self.step = self.step / 10 if self.enclosed else self.step * 2
        if self.step <= finest:
            self.found = {"power": self.middle, "mean": float(seen.mean[best]), "std": math.sqrt(seen.squares[best] / seen.rows)}


def fit_powers(df: DataFrame, names: Sequence[str], rounds: int = ROUNDS) -> dict[str, dict[str, float | None]]:
    """{column: {power, mean, std}}. Every round is one job that reads the columns once, however many they are.

    The likelihood has one peak, so the best of 21 grid points encloses it between its neighbours, and the next
    round looks there with a tenth of the step. Until a peak is enclosed, a best point on the rim moves the grid there
    and doubles its step, however far that goes: far out the variance is not finite or zero, and no exponent wins there.
    The last round's sums hold the mean and the deviation too.
    """
    finest = 0.9 * FIRST_STEP / 10 ** (rounds - 1)
    searches = {at: Search() for at in range(len(names))}
    while waiting := {at: search.grid() for at, search in searches.items() if search.found is None}:
        seen = column_moments(df, names, waiting)
        for at in waiting:
            if at in seen and seen[at].rows:
                searches[at].look(seen[at], finest)
            else:
                searches[at].found = {"power": 0.0, "mean": None, "std": None}
    return {names[at]: dict(search.found) for at, search in searches.items()}


def _likelihood(rows: int, logs: float, power: float, variance: float) -> float:
    if not math.isfinite(variance) or variance <= 0:
        return -math.inf
    return -rows / 2 * math.log(variance) + (power - 1) * logs
