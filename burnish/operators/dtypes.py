"""Type repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import ANY_DATE, as_number, as_timestamp, c, is_numeric, parse_flag, shapes_of, type_of
from burnish.operators.profile import null_counts
from burnish.operators.steps import Found, Needs, Note, Outcome, Step, run
from burnish.operators.values import local_frame

TARGETS = ("int", "float", "str", "category", "bool", "datetime", "auto")
LONG_LIMIT = 9.2233720368547748e18


def repair_types(df: DataFrame, fixes: Mapping[str, str]) -> Outcome:
    """Cast columns to int, float, str, category, bool, datetime or auto; what does not parse becomes NULL.

    A column with a fraction in it cannot become int: it is left as it is and noted as an error.
    """
    notes: list[Note] = []
    steps, listed = type_steps(df, df.columns, fixes, notes)
    out = run(df, steps)
    return Outcome(out, tuple([*listed, *notes]))


def type_steps(
    df: DataFrame, names: Sequence[str], fixes: Mapping[str, str], late_notes: list[Note] | None = None
) -> tuple[list[Step], list[Note]]:
    late = late_notes if late_notes is not None else []
    steps, notes = [], []
    for name, target in fixes.items():
        if target not in TARGETS:
            raise ValueError(f"unknown target type for {name}: {target}")
        if name not in names:
            notes.append(Note("types", name, "skipped", "column not found"))
        else:
            steps.append(_step(name, target, late))
    return steps, notes


def _step(name: str, target: str, late: list[Note]) -> Step:
    one = frozenset({name})
    if target in ("int", "auto"):
        return Step(
            fit_reads=one,
            reads=one,
            writes=one,
            needs=lambda df: Needs(aggs=_tests(df, name)),
            project=lambda df, found: _after_test(df, found, name, target, late),
        )

    def project(df: DataFrame, found: Found) -> dict[str, Column]:
        before = type_of(df, name).simpleString()
        late.append(Note("types", name, "converted", f"{before} to {target}"))
        return {name: _cast(df, name, target, found.aggs.get(f"shapes|{name}", ANY_DATE))}

    if target == "datetime":
        needs = lambda df: Needs(aggs={f"shapes|{n}": shapes for n, shapes in shapes_of(df, [name]).items()})
        return Step(fit_reads=one, reads=one, writes=one, needs=needs, project=project)
    return Step(reads=one, writes=one, project=project)


def _cast(df: DataFrame, name: str, target: str, shapes: int) -> Column:
    if target == "float":
        return as_number(df, name)
    if target == "bool":
        return parse_flag(c(name))
    if target == "datetime":
        return as_timestamp(df, name, shapes)
    return c(name).cast("string")


def _tests(df: DataFrame, name: str) -> dict[str, Column]:
    number = as_number(df, name)
    return {
        f"unfit|{name}": F.count_if((number != F.floor(F.when(F.abs(number) < LONG_LIMIT, number))) | (F.abs(number) >= LONG_LIMIT)),
        f"unparsed|{name}": F.count_if(number.isNull() & c(name).isNotNull()),
        f"filled|{name}": F.count(c(name)),
    }


def _after_test(df: DataFrame, found: Found, name: str, target: str, late: list[Note]) -> dict[str, Column]:
    before = type_of(df, name).simpleString()
    if target == "int":
        if found.aggs[f"unfit|{name}"]:
            late.append(Note("types", name, "error", "cannot cast to int: a value has a fraction or is out of range"))
            return {}
        late.append(Note("types", name, "converted", f"{before} to int"))
        if isinstance(type_of(df, name), T.StringType):
            whole = F.when(c(name).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c(name)).try_cast("bigint"))
            return {name: F.coalesce(whole, as_number(df, name).cast("long"))}
        return {name: c(name).cast("long") if is_numeric(type_of(df, name)) else as_number(df, name).cast("long")}
    parses = not found.aggs[f"unparsed|{name}"] and found.aggs[f"filled|{name}"]
    if is_numeric(type_of(df, name)) or not parses:
        late.append(Note("types", name, "converted", f"{before} to {before}"))
        return {}
    whole = not found.aggs[f"unfit|{name}"]
    late.append(Note("types", name, "converted", f"{before} to {'int' if whole else 'float'}"))
    number = as_number(df, name)
    return {name: number.cast("long") if whole else number}


def type_report(before: DataFrame, outcome: Outcome, columns: Sequence[str]) -> DataFrame:
    """(column, from_type, to_type, nulls_after, error) of the repaired columns."""
    errors = {n.column: n.detail for n in outcome.notes if n.status == "error"}
    present = [n for n in columns if n in before.columns]
    rows = [
        (n, type_of(before, n).simpleString(), type_of(outcome.df, n).simpleString(), errors.get(n)) for n in present
    ]
    listed = local_frame(before.sparkSession, rows, "column string, from_type string, to_type string, error string")
    return listed.join(null_counts(outcome.df.select(*[c(n) for n in present])), "column").withColumnRenamed("nulls", "nulls_after")
