"""Features of date and time columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import ANY_DATE, ONLY_MONTH_FIRST, as_timestamp, day_comes_first, shapes_of, wall_micros
from burnish.functions.dates import CALENDAR, whole_days_since
from burnish.operators.columns import split_names
from burnish.operators.profile import long_form
from burnish.operators.quantiles import one_row
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run

SINCE_FIRST = "days_since_earliest"
# Shapes under which a date of two numbers and a year is read either way.
READINGS = {"month": ANY_DATE, "day": ANY_DATE & ~ONLY_MONTH_FIRST}


def date_features(df: DataFrame, configs: Mapping[str, str | Sequence[str]]) -> Outcome:
    """Parse each column, add ``<column>_<feature>`` per feature, and drop the column.

    How dates are written is found in the pass that fits the steps, also whether the day or the month comes first.
    Features: year, month, day, dayofweek (Monday = 0), hour, minute, is_weekend, quarter, week_of_year,
    days_since_earliest, time_of_day.
    """
    steps, notes = date_steps(df, df.columns, configs)
    return Outcome(run(df, steps), tuple(notes))


def date_steps(
    df: DataFrame, names: Sequence[str], configs: Mapping[str, str | Sequence[str]]
) -> tuple[list[Step], list[Note]]:
    steps, notes = [], []
    for name, listed in configs.items():
        features = split_names(listed)
        unknown = [f for f in features if f not in CALENDAR and f != SINCE_FIRST]
        if unknown:
            raise ValueError(f"unknown date features for {name}: {unknown}")
        if name not in names:
            notes.append(Note("dates", name, "skipped", "column not found"))
            continue
        steps.append(_step(name, features))
        notes.append(Note("dates", name, "done", ", ".join(f"{name}_{f}" for f in features)))
    return steps, notes


def _step(name: str, features: Sequence[str]) -> Step:
    one = frozenset({name})

    def needs(df: DataFrame) -> Needs:
        aggs: dict[str, Column] = {f"shapes|{n}": shapes for n, shapes in shapes_of(df, [name]).items()}
        if SINCE_FIRST in features:
            # Which of the two readings holds is known only with the shapes.
            for reading, shapes in READINGS.items():
                aggs[f"earliest|{reading}|{name}"] = F.min(wall_micros(as_timestamp(df, name, shapes)))
        return Needs(aggs=aggs)

    def project(df: DataFrame, found: Found) -> dict[str, Column]:
        shapes = found.aggs.get(f"shapes|{name}", ANY_DATE)
        stamp = as_timestamp(df, name, shapes)
        out = {}
        for feature in features:
            if feature == SINCE_FIRST:
                start = found.aggs[f"earliest|{'day' if day_comes_first(shapes) else 'month'}|{name}"]
                out[f"{name}_{feature}"] = F.lit(None).cast("long") if start is None else whole_days_since(stamp, start)
            else:
                out[f"{name}_{feature}"] = CALENDAR[feature](stamp)
        return out

    return Step(
        fit_reads=one,
        reads=one,
        writes=frozenset(f"{name}_{f}" for f in features),
        needs=needs,
        project=project,
        drops=(name,),
    )


def known_shapes(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """{column: the shapes of its dates}, from one pass over the text columns; others need none."""
    return dict.fromkeys(columns, ANY_DATE) | one_row(df, shapes_of(df, columns))


def unparsed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_dates): values that are missing or do not read as a date."""
    shapes = known_shapes(df, columns)
    metrics = {"null_dates": (lambda n: F.count_if(as_timestamp(df, n, shapes[n]).isNull()), "long")}
    return long_form(df, columns, metrics)


def parse_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as timestamps, NULL where they do not read as a date."""
    shapes = known_shapes(df, columns)
    return df.withColumns({n: as_timestamp(df, n, shapes[n]) for n in columns})
