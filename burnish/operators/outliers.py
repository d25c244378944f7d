"""Outliers of numeric columns: clip, remove or compress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, clip, is_numeric, log1p_floor, type_of
from burnish.operators.profile import outlier_bounds, outside
from burnish.operators.quantiles import one_row
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run
from burnish.operators.values import local_frame

METHODS = ("clip_iqr", "remove_iqr", "clip_zscore", "remove_zscore", "winsorize", "log_transform")


def treat_outliers(df: DataFrame, strategies: Mapping[str, str]) -> Outcome:
    """Treat outliers column by column, in the given order.

    Strategies: clip_iqr[:k], remove_iqr[:k] (k = 1.5), clip_zscore[:t], remove_zscore[:t] (t = 3),
    winsorize[:low,high] (percentiles 5,95), log_transform, keep. A removal also removes missing values.
    """
    steps, notes = outlier_steps(df, df.columns, strategies)
    return Outcome(run(df, steps), tuple(notes))


def outlier_steps(df: DataFrame, names: Sequence[str], strategies: Mapping[str, str]) -> tuple[list[Step], list[Note]]:
    steps, notes = [], []
    for name, strategy in strategies.items():
        word, _, arg = strategy.partition(":")
        if word in ("keep", "none"):
            continue
        if word not in METHODS:
            raise ValueError(f"unknown outlier strategy for {name}: {strategy}")
        if name not in names:
            notes.append(Note("outliers", name, "skipped", "column not found"))
            continue
        steps.append(_step(name, word, arg))
        notes.append(Note("outliers", name, "done", strategy))
    return steps, notes


def _step(name: str, word: str, arg: str) -> Step:
    one = frozenset({name})
    removes = word.startswith("remove")
    step = Step(fit_reads=one, reads=one, writes=frozenset() if removes else one, changes_rows=removes)
    step.needs = lambda df: _needs(df, name, word, arg)
    if removes:
        step.keep = lambda df, found: _inside(found, name, word, arg)
    else:
        step.project = lambda df, found: {name: _treated(found, name, word, arg)}
    return step


def _needs(df: DataFrame, name: str, word: str, arg: str) -> Needs:
    if not is_numeric(type_of(df, name)):
        raise ValueError(f"{word} needs a numeric column: {name}")
    if word == "log_transform":
        return Needs()
    if word.endswith("iqr"):
        return Needs(quantiles={name: (0.25, 0.75)})
    if word == "winsorize":
        return Needs(quantiles={name: _percentiles(arg)})
    value = c(name).cast("double")
    return Needs(aggs={f"mean|{name}": F.mean(value), f"std|{name}": F.stddev_samp(value)})


def _percentiles(arg: str) -> tuple[float, float]:
    low, high = (arg or "5,95").split(",")
    return float(low) / 100, float(high) / 100


def _limits(found: Found, name: str, word: str, arg: str) -> tuple[float, float] | None:
    """The values allowed; None where the column gives none."""
    if word == "winsorize":
        low, high = (found.quantiles[name, p] for p in _percentiles(arg))
        return None if low is None else (low, high)
    if word.endswith("iqr"):
        q1, q3 = found.quantiles[name, 0.25], found.quantiles[name, 0.75]
        reach = float(arg or 1.5)
        return None if q1 is None else (q1 - reach * (q3 - q1), q3 + reach * (q3 - q1))
    mean, std = found.aggs[f"mean|{name}"], found.aggs[f"std|{name}"]
    reach = float(arg or 3)
    return (mean - reach * std, mean + reach * std) if std and std > 0 else None


def _treated(found: Found, name: str, word: str, arg: str) -> Column:
    if word == "log_transform":
        return log1p_floor(c(name))
    limits = _limits(found, name, word, arg)
    return c(name) if limits is None else clip(c(name), *limits)


def _inside(found: Found, name: str, word: str, arg: str) -> Column | None:
    limits = _limits(found, name, word, arg)
    if limits is None:
        # No spread: a z-score removes nothing. No quartiles: every value is missing, and a missing value fails.
        return None if word == "remove_zscore" else c(name).isNotNull()
    if word == "remove_iqr":
        return c(name).between(F.lit(limits[0]), F.lit(limits[1]))
    mean, std = found.aggs[f"mean|{name}"], found.aggs[f"std|{name}"]
    return F.abs((c(name) - F.lit(mean)) / F.lit(std)) <= F.lit(float(arg or 3))


def outlier_report(df: DataFrame, strategies: Mapping[str, str]) -> DataFrame:
    """(column, strategy, outliers_before, outliers_after, rows_before, rows_after) of each strategy in turn.

    Quartiles are refitted after each strategy, so this costs jobs of its own.
    """
    lines = []
    for name, strategy in strategies.items():
        if name not in df.columns or strategy in ("keep", "none"):
            continue
        after = treat_outliers(df, {name: strategy}).df
        spread = bool(outlier_bounds(df, [name]))
        old, old_rows = _count(df, name)
        new, new_rows = _count(after, name)
        lines.append((name, strategy, old, new if spread else 0, old_rows, new_rows))
        df = after
    schema = "column string, strategy string, outliers_before long, outliers_after long, rows_before long, rows_after long"
    return local_frame(df.sparkSession, lines, schema)


def _count(df: DataFrame, name: str) -> tuple[int, int]:
    bounds = outlier_bounds(df, [name]).get(name)
    found = F.count_if(outside(name, bounds)) if bounds else F.lit(0)
    row = one_row(df, {"outliers": found, "rows": F.count("*")})
    return row["outliers"], row["rows"]
