"""Missing values: fills, row and column drops, and a report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import FLOATING, TEMPORAL, c, is_numeric, type_of
from burnish.operators.ordered import order_keys, ordered_fill
from burnish.operators.profile import null_counts
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run

ORDERED = {"fill_ffill": "ffill", "fill_bfill": "bfill", "fill_interpolate": "interpolate"}
STRATEGIES = ("fill_mean", "fill_median", "fill_mode", "fill_zero", "fill_custom", *ORDERED, "drop_rows", "drop_column")
NOTHING = ("keep", "none")


def fill_missing(
    df: DataFrame, strategies: Mapping[str, str], order_by: str | Sequence[str] | None = None, ranges: int | None = None
) -> Outcome:
    """Treat missing values column by column, in the given order.

    Strategies: fill_mean, fill_median, fill_mode, fill_zero, fill_custom:<value>, fill_ffill, fill_bfill,
    fill_interpolate (these three need ``order_by``), drop_rows, drop_column, keep.
    """
    steps, notes = missing_steps(df, df.columns, strategies, order_by, ranges)
    return Outcome(run(df, steps), tuple(notes))


def missing_steps(
    df: DataFrame,
    names: Sequence[str],
    strategies: Mapping[str, str],
    order_by: str | Sequence[str] | None = None,
    ranges: int | None = None,
) -> tuple[list[Step], list[Note]]:
    steps: list[Step] = []
    notes: list[Note] = []
    ordered: dict[str, str] = {}

    def settle_ordered() -> None:
        if ordered:
            steps.append(_ordered_step(dict(ordered), order_by, ranges))
            ordered.clear()

    for name, strategy in strategies.items():
        word, _, arg = strategy.partition(":")
        if word in NOTHING:
            continue
        if word not in STRATEGIES:
            raise ValueError(f"unknown missing-value strategy for {name}: {strategy}")
        if name not in names:
            notes.append(Note("missing", name, "skipped", "column not found"))
            continue
        if word in ORDERED:
            if not order_by:
                raise ValueError(f"{word} of {name} needs order_by: a table has no row order of its own")
            ordered[name] = ORDERED[word]
        else:
            if word == "drop_rows":
                settle_ordered()
            steps.append(_step(name, word, arg))
        notes.append(Note("missing", name, "done", strategy))
    settle_ordered()
    # NaN is a missing value whatever brought the table here.
    done = [n for n in notes if n.status == "done" and n.column in df.columns]
    floats = [n.column for n in done if isinstance(type_of(df, n.column), FLOATING)]
    if floats:
        steps.insert(0, _spelled_missing(floats))
    return steps, notes


def _spelled_missing(names: Sequence[str]) -> Step:
    every = frozenset(names)
    return Step(
        reads=every,
        writes=every,
        project=lambda df, found: {n: F.when(~F.isnan(c(n)), c(n)) for n in names if n in df.columns},
    )


def _ordered_step(fills: dict[str, str], order_by: str | Sequence[str], ranges: int | None) -> Step:
    return Step(
        fit_reads=frozenset({*fills, *order_keys(order_by)}),
        writes=frozenset(fills),
        needs=lambda df: Needs(),
        transform=lambda df, found: ordered_fill(df, fills, order_by, ranges),
    )


def _step(name: str, word: str, arg: str) -> Step:
    one = frozenset({name})
    if word == "drop_column":
        return Step(drops=(name,))
    if word == "drop_rows":
        return Step(reads=one, keep=lambda df, found: c(name).isNotNull(), changes_rows=True)
    if word in ("fill_zero", "fill_custom"):
        value = "0" if word == "fill_zero" else arg
        return Step(reads=one, writes=one, project=lambda df, found: {name: _with_literal(df, name, value)})
    return Step(
        fit_reads=one,
        reads=one,
        writes=one,
        needs=lambda df: _needs(df, name, word),
        project=lambda df, found: {name: _with_fitted(df, found, name, word)},
    )


def _with_literal(df: DataFrame, name: str, value: str) -> Column:
    """A fixed value in the column's own type; a fraction turns a whole-number column into double."""
    kind = type_of(df, name)
    if isinstance(kind, TEMPORAL) and value == "0":
        raise ValueError(f"fill_zero has no meaning for a date: {name}; use fill_custom with a date")
    if isinstance(kind, T.IntegralType) and not value.lstrip("+-").isdigit():
        kind = T.DoubleType()
    return F.coalesce(c(name).cast(kind), F.lit(value).cast(kind))


def _needs(df: DataFrame, name: str, word: str) -> Needs:
    if word == "fill_mode":
        return Needs(modes=(name,))
    if not is_numeric(type_of(df, name)):
        raise ValueError(f"{word} needs a numeric column: {name}")
    if word == "fill_mean":
        return Needs(aggs={f"mean|{name}": F.mean(c(name))})
    return Needs(quantiles={name: (0.5,)})


def _with_fitted(df: DataFrame, found: Found, name: str, word: str) -> Column:
    if word == "fill_mode":
        value = found.modes[name]
        return c(name) if value is None else F.coalesce(c(name), F.lit(value).cast(type_of(df, name)))
    value = found.aggs[f"mean|{name}"] if word == "fill_mean" else found.quantiles[name, 0.5]
    return c(name) if value is None else F.coalesce(c(name).cast("double"), F.lit(float(value)))


def missing_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, before, after): missing values of the columns that have or had some, and row counts as ``(rows)``."""
    left = null_counts(before, rows_as="(rows)").withColumnRenamed("nulls", "before")
    right = null_counts(after, rows_as="(rows)").withColumnRenamed("nulls", "after")
    joined = left.join(right, "column", "full_outer")
    return joined.where((F.coalesce("before", F.lit(0)) > 0) | (F.coalesce("after", F.lit(0)) > 0))
