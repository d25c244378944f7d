"""Engineered features: new columns from existing ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, flag, is_numeric, log1p_floor, type_of
from burnish.functions.formula import column_of, names_in
from burnish.functions.text import word_count
from burnish.operators.profile import long_form
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run
from burnish.operators.values import local_frame

ONE_COLUMN = ("str_len", "word_count", "log")
TWO_COLUMNS = ("ratio", "multiply", "add", "subtract")
WITH_VALUE = ("threshold_above", "threshold_below", "bin")
OPERATIONS = ("formula", *ONE_COLUMN, *TWO_COLUMNS, *WITH_VALUE)


def add_features(df: DataFrame, features: Mapping[str, str]) -> Outcome:
    """Add ``{new column: "operation:arguments"}`` in order; later features may use earlier ones.

    Operations: formula:<expression>, str_len:<c>, word_count:<c>, log:<c>, ratio:<a>,<b>, multiply, add, subtract,
    threshold_above:<c>,<v>, threshold_below:<c>,<v>, bin:<c>,<n>. A feature of a column that does not exist is
    noted as an error and the rest go on.
    """
    steps, notes = feature_steps(df, df.columns, features)
    return Outcome(run(df, steps), tuple(notes))


def feature_steps(df: DataFrame, names: Sequence[str], features: Mapping[str, str]) -> tuple[list[Step], list[Note]]:
    steps, notes = [], []
    known = set(names)
    for new, definition in features.items():
        word, _, arg = definition.partition(":")
        if word not in OPERATIONS:
            raise ValueError(f"unknown feature operation for {new}: {definition}")
        sources = _sources(word, arg)
        lost = sorted(sources - known)
        if lost:
            notes.append(Note("features", new, "error", f"column not found: {', '.join(lost)}"))
            continue
        known.add(new)
        steps.append(_step(new, word, arg, sources))
        notes.append(Note("features", new, "created", definition))
    return steps, notes


def _sources(word: str, arg: str) -> frozenset[str]:
    if word == "formula":
        return names_in(arg)
    parts = [p.strip() for p in arg.split(",")]
    return frozenset(parts[:2] if word in TWO_COLUMNS else [arg.strip()] if word in ONE_COLUMN else parts[:1])


def _step(new: str, word: str, arg: str, sources: frozenset[str]) -> Step:
    writes = frozenset({new})
    if word != "bin":
        return Step(reads=sources, writes=writes, project=lambda df, found: {new: _plain(word, arg)})
    (name,) = sources
    shares = _shares(int(arg.split(",")[1]))
    return Step(
        fit_reads=sources,
        reads=sources,
        writes=writes,
        needs=lambda df: Needs(quantiles={name: shares}),
        project=lambda df, found: {new: _binned(found, name, shares)},
    )


def _shares(bins: int) -> tuple[float, ...]:
    return tuple(i / bins for i in range(bins + 1))


def _plain(word: str, arg: str) -> Column:
    if word == "formula":
        return column_of(arg)
    first, _, second = (part.strip() for part in arg.partition(","))
    if word == "str_len":
        return F.length(c(arg.strip()).cast("string"))
    if word == "word_count":
        return word_count(c(arg.strip()).cast("string"))
    if word == "log":
        return log1p_floor(c(arg.strip()))
    if word == "threshold_above":
        return flag(c(first) > F.lit(float(second)))
    if word == "threshold_below":
        return flag(c(first) < F.lit(float(second)))
    if word == "ratio":
        return F.try_divide(c(first).cast("double"), c(second).cast("double"))
    if word == "multiply":
        return c(first) * c(second)
    return c(first) + c(second) if word == "add" else c(first) - c(second)


def _binned(found: Found, name: str, shares: Sequence[float]) -> Column:
    """Equal-frequency bins, closed on the right. Equal edges collapse, so ties always share a bin."""
    edges = sorted({e for e in (found.quantiles[name, p] for p in shares) if e is not None})
    if len(edges) < 2:
        return F.lit(None).cast("long")
    above = [F.when(c(name).cast("double") > F.lit(edge), 1).otherwise(0) for edge in edges[1:-1]]
    return F.when(c(name).isNotNull(), sum(above, F.lit(0)).cast("long"))


def feature_report(df: DataFrame, outcome: Outcome) -> DataFrame:
    """(column, status, type, nulls, mean, min, max, reason) of the new columns."""
    made = [n for n in outcome.notes if n.step == "features"]
    created = [n.column for n in made if n.status == "created"]
    out = outcome.df

    def number(fn):
        def make(n: str) -> Column:
            return F.round(fn(c(n).cast("double")), 4) if is_numeric(type_of(out, n)) else F.lit(None)

        return make

    metrics = {
        "nulls": (lambda n: F.count_if(c(n).isNull()), "long"),
        "mean": (number(F.mean), "double"),
        "min": (number(F.min), "double"),
        "max": (number(F.max), "double"),
    }
    rows = [
        (n.column, n.status, type_of(out, n.column).simpleString() if n.status == "created" else None,
         n.detail if n.status == "error" else None)
        for n in made
    ]
    listed = local_frame(df.sparkSession, rows, "column string, status string, type string, reason string")
    return listed.join(F.broadcast(long_form(out, created, metrics)), "column", "left")
