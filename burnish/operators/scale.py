"""Scaling of numeric columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, is_numeric, log1p_floor, numeric_columns, type_of, yeo_johnson
from burnish.operators.columns import split_names
from burnish.operators.profile import long_form
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run

METHODS = ("standard", "minmax", "robust", "log", "maxabs", "power_yeo")
ALL = "__all_numeric__"


def scale(df: DataFrame, scalings: Mapping[str, str], exclude: str | Sequence[str] = ()) -> Outcome:
    """Scale columns by standard, minmax, robust, log, maxabs or power_yeo; ``__all_numeric__`` names every number."""
    steps, notes = scale_steps(df, scalings, exclude)
    return Outcome(run(df, steps), tuple(notes))


def scale_steps(
    df: DataFrame, scalings: Mapping[str, str], exclude: str | Sequence[str] = ()
) -> tuple[list[Step], list[Note]]:
    barred = set(split_names(exclude))
    if ALL in scalings:
        chosen = {n: scalings[ALL] for n in numeric_columns(df)}
    else:
        chosen = dict(scalings)
    steps, notes = [], []
    for name, method in chosen.items():
        if method in ("none", "keep"):
            continue
        if method not in METHODS:
            raise ValueError(f"unknown scaling for {name}: {method}")
        if name not in df.columns:
            notes.append(Note("scale", name, "skipped", "column not found"))
        elif name in barred:
            notes.append(Note("scale", name, "skipped", "excluded"))
        elif not is_numeric(type_of(df, name)):
            notes.append(Note("scale", name, "skipped", "not numeric"))
        else:
            steps.append(_step(name, method))
            notes.append(Note("scale", name, "done", method))
    return steps, notes


def _step(name: str, method: str) -> Step:
    one = frozenset({name})
    return Step(
        fit_reads=one,
        reads=one,
        writes=one,
        needs=lambda df: _needs(name, method),
        project=lambda df, found: {name: _scaled(found, name, method)},
    )


def _needs(name: str, method: str) -> Needs:
    value = c(name).cast("double")
    if method == "standard":
        return Needs(aggs={f"mean|{name}": F.mean(value), f"std_pop|{name}": F.stddev_pop(value)})
    if method == "minmax":
        return Needs(aggs={f"min|{name}": F.min(value), f"max|{name}": F.max(value)})
    if method == "robust":
        return Needs(quantiles={name: (0.25, 0.5, 0.75)})
    if method == "maxabs":
        return Needs(aggs={f"maxabs|{name}": F.max(F.abs(value))})
    if method == "power_yeo":
        return Needs(powers=(name,))
    return Needs()


def _scaled(found: Found, name: str, method: str) -> Column:
    value = c(name).cast("double")
    if method == "log":
        return log1p_floor(value)
    if method == "power_yeo":
        fitted = found.powers[name]
        return _shifted(yeo_johnson(value, F.lit(fitted["power"])), fitted["mean"], fitted["std"])
    if method == "standard":
        return _shifted(value, found.aggs[f"mean|{name}"], found.aggs[f"std_pop|{name}"])
    if method == "minmax":
        low, high = found.aggs[f"min|{name}"], found.aggs[f"max|{name}"]
        return _shifted(value, low, None if low is None else high - low)
    if method == "maxabs":
        return _shifted(value, 0.0, found.aggs[f"maxabs|{name}"])
    q1, median, q3 = (found.quantiles[name, p] for p in (0.25, 0.5, 0.75))
    return _shifted(value, median, None if q1 is None else q3 - q1)


def _shifted(value: Column, center: float | None, width: float | None) -> Column:
    """(value - center) / width; a width of zero counts as one, and a column without values stays as it is."""
    if center is None:
        return value
    return (value - F.lit(float(center))) / F.lit(float(width) if width else 1.0)


def scaling_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mean_before, std_before, mean_after, std_after), to four places."""

    def stats(df: DataFrame, suffix: str) -> DataFrame:
        metrics = {
            f"mean_{suffix}": (lambda n: F.round(F.mean(c(n).cast("double")), 4), "double"),
            f"std_{suffix}": (lambda n: F.round(F.stddev_samp(c(n).cast("double")), 4), "double"),
        }
        return long_form(df, columns, metrics)

    return stats(before, "before").join(F.broadcast(stats(after, "after")), "column")
