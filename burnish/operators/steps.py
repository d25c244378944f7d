"""Fit-and-apply steps, and how a chain of them shares its fits.

A step says which columns its fit reads and which columns it changes. Consecutive steps whose fits do not depend on
each other are fitted together, in one aggregate over the table; a step that reads what an earlier one changed, or
that follows a change of the row set, starts a new round. So the meaning is that of running the steps one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.columns import c
from burnish.operators.heavy import modes as most_frequent
from burnish.operators.power import fit_powers
from burnish.operators.quantiles import exact_quantiles, one_row, parallel
from burnish.operators.values import Categories, CategoryNeed, fetch_categories, local_frame


@dataclass(frozen=True)
class Needs:
    """Parameters to be found in the data."""

    aggs: Mapping[str, Column] = field(default_factory=dict)
    quantiles: Mapping[str, Sequence[float]] = field(default_factory=dict)
    categories: Sequence[CategoryNeed] = ()
    modes: Sequence[str] = ()
    powers: Sequence[str] = ()


@dataclass(frozen=True)
class Found:
    aggs: Mapping[str, object]
    quantiles: Mapping[tuple[str, float], float | None]
    categories: Mapping[tuple, Categories]
    modes: Mapping[str, object]
    powers: Mapping[str, Mapping[str, float]]


@dataclass(frozen=True)
class Note:
    """What became of one configured column."""

    step: str
    column: str
    status: str
    detail: str = ""


@dataclass
class Step:
    fit_reads: frozenset[str] = frozenset()
    reads: frozenset[str] = frozenset()
    writes: frozenset[str] = frozenset()
    drops: tuple[str, ...] = ()
    needs: Callable[[DataFrame], Needs] | None = None
    project: Callable[[DataFrame, Found], Mapping[str, Column]] | None = None
    keep: Callable[[DataFrame, Found], Column | None] | None = None
    transform: Callable[[DataFrame, Found], DataFrame] | None = None
    changes_rows: bool = False
    opens_columns: bool = False  # writes columns whose names only the fit knows


@dataclass(frozen=True)
class Outcome:
    """The prepared table and what was done to it."""

    df: DataFrame
    notes: tuple[Note, ...] = ()
    mappings: Mapping[str, DataFrame] = field(default_factory=dict)  # by encoded column: (value, code)

    def notes_frame(self) -> DataFrame:
        return notes_frame(self.df.sparkSession, self.notes)


def notes_frame(spark: SparkSession, notes: Sequence[Note]) -> DataFrame:
    rows = [(n.step, n.column, n.status, n.detail) for n in notes]
    return local_frame(spark, rows, "step string, column string, status string, detail string")


def run(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply the steps in order, fitting as many as possible in one pass."""
    pending: list[Step] = []
    written: set[str] = set()
    sealed = False
    for step in steps:
        if pending and (sealed and step.needs or step.fit_reads & written or any(s.opens_columns for s in pending)):
            df = _flush(df, pending)
            pending, written, sealed = [], set(), False
        pending.append(step)
        written |= step.writes | set(step.drops)
        sealed = sealed or step.changes_rows
    return _flush(df, pending)


def fit(df: DataFrame, needs: Sequence[Needs]) -> Found:
    """All parameters of a round: one aggregate, one search each for quantiles, modes and exponents, and one job per category column."""
    aggs: dict[str, Column] = {}
    quantiles: dict[str, list[float]] = {}
    categories: dict[tuple, CategoryNeed] = {}
    modes: dict[str, None] = {}
    powers: dict[str, None] = {}
    for need in needs:
        aggs.update(need.aggs)
        for name, ps in need.quantiles.items():
            quantiles.setdefault(name, []).extend(p for p in ps if p not in quantiles.get(name, []))
        categories.update({n.key: n for n in need.categories})
        modes.update(dict.fromkeys(need.modes))
        powers.update(dict.fromkeys(need.powers))

    jobs: list[Callable[[], object]] = [
        lambda: one_row(df, aggs),
        lambda: exact_quantiles(df, quantiles),
        lambda: most_frequent(df, list(modes)) if modes else {},
        lambda: fit_powers(df, list(powers)) if powers else {},
        *[lambda need=need: fetch_categories(df, need) for need in categories.values()],
    ]
    plain, cuts, common, powered, *results = parallel(df.sparkSession, jobs)
    return Found(
        aggs=plain,
        quantiles=cuts,
        categories=dict(zip(categories, results)),
        modes=common,
        powers=powered,
    )


def _flush(df: DataFrame, pending: Sequence[Step]) -> DataFrame:
    needs = [step.needs(df) for step in pending if step.needs]
    found = fit(df, needs) if needs else Found({}, {}, {}, {}, {})
    columns: dict[str, Column] = {}
    dropped: list[str] = []

    def settle(frame: DataFrame) -> DataFrame:
        if columns:
            frame = frame.withColumns(dict(columns))
        if dropped:
            frame = frame.drop(*[n for n in dropped if n not in columns])
        columns.clear()
        dropped.clear()
        return frame

    for step in pending:
        if step.project:
            if (step.reads | step.writes) & (columns.keys() | set(dropped)):
                df = settle(df)
            columns.update(step.project(df, found))
        if step.drops:
            if columns.keys() & set(step.drops):
                df = settle(df)
            dropped.extend(step.drops)
        if step.keep:
            df = settle(df)
            condition = step.keep(df, found)
            df = df if condition is None else df.where(condition)
        if step.transform:
            df = settle(df)
            df = step.transform(df, found)
    return settle(df)
