"""Running a plan from end to end."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from burnish.operators.columns import drop_steps
from burnish.operators.dates import date_steps
from burnish.operators.dedupe import remove_duplicates
from burnish.operators.dtypes import type_steps
from burnish.operators.encode import encode_steps
from burnish.operators.features import feature_steps
from burnish.operators.missing import missing_steps
from burnish.operators.outliers import outlier_steps
from burnish.operators.scale import scale_steps
from burnish.operators.steps import Note, Step, run
from burnish.operators.text import text_steps
from burnish.operators.validate import Check, run_checks
from burnish.operators.values import local_frame
from burnish.plans.plan import Plan
from burnish.session import cut

METRICS = "step string, rows_before long, columns_before int, rows_after long, columns_after int, detail string"


@dataclass(frozen=True)
class Prepared:
    """The prepared table, what was done, the checks, and a line of metrics per step if asked for."""

    df: DataFrame
    notes: tuple[Note, ...]
    checks: tuple[Check, ...]
    metrics: DataFrame | None = None


def prepare(df: DataFrame, plan: Plan, metrics: bool = False, materialize: bool = False) -> Prepared:
    """Run the plan's steps in its order.

    Steps are collected as long as their fits do not depend on each other and are then fitted together, so the table
    is read once per such round, not once per step. The result stays lazy. ``materialize`` writes the table to the
    shared checkpoint folder after deduplication, for when reading the source again costs more than writing it, and
    after steps that join or shuffle if a later fit and the checks, or the result, would each do that work again.
    ``metrics`` counts rows after every step that may change them, within jobs that run anyway, and writes the result.
    """
    plan.check()
    if metrics:
        return _prepare_counted(df, plan, materialize)
    notes: list[Note] = []
    pending: list[Step] = []
    names = list(df.columns)
    checks: list[Check] = []

    def settle(readings: int = 0) -> None:
        nonlocal df, names
        df = run(df, pending)
        names = list(df.columns)
        if materialize and readings > 1 and any(s.transform for s in pending):
            df = cut(df)
        pending.clear()

    for at, kind in enumerate(plan.order):
        if kind in ("duplicates", "scale", "validate") or any(s.opens_columns for s in pending):
            settle(_readings(plan, plan.order[at:]))
        if kind == "duplicates":
            df = _deduplicated(df, plan, notes, materialize)
            names = list(df.columns)
        elif kind == "validate":
            checks = run_checks(df, plan.checks)
        else:
            steps, made = _steps(df, names, plan, kind, notes)
            notes.extend(made)
            pending.extend(steps)
            names = _names_after(names, steps)
    settle()
    return Prepared(df, tuple(notes), tuple(checks))


def _readings(plan: Plan, kinds: Sequence[str]) -> int:
    """How often the table is read from here on, at least: by fits of scaling, by checks, and for the result."""
    fitted = [how for how in plan.scale.values() if how not in ("log", "none")]
    return 1 + ("scale" in kinds and bool(fitted)) + ("validate" in kinds and bool(plan.checks))


def _deduplicated(df: DataFrame, plan: Plan, notes: list[Note], materialize: bool) -> DataFrame:
    if plan.duplicates in (None, "keep"):
        return df
    outcome = remove_duplicates(df, plan.duplicates, plan.duplicate_key, plan.order_by)
    notes.extend(outcome.notes)
    return cut(outcome.df) if materialize else outcome.df


def _steps(df: DataFrame, names: list[str], plan: Plan, kind: str, late: list[Note]) -> tuple[list[Step], list[Note]]:
    if kind == "drop":
        return drop_steps(names, plan.drop, plan.reasons)
    if kind == "types":
        return type_steps(df, names, plan.types, late)
    if kind == "missing":
        return missing_steps(df, names, plan.missing, plan.order_by)
    if kind == "dates":
        return date_steps(df, names, plan.dates)
    if kind == "text":
        return text_steps(df, names, plan.text, plan.stop_words, late)
    if kind == "outliers":
        return outlier_steps(df, names, plan.outliers)
    if kind == "encode":
        return encode_steps(df, names, plan.encode, plan.order_by, late)
    if kind == "features":
        return feature_steps(df, names, plan.features)
    exclude = [*plan.scale_exclude, *([plan.target] if plan.target else [])]
    return scale_steps(df, plan.scale, exclude)


def _names_after(names: list[str], steps: list[Step]) -> list[str]:
    """The columns after steps that have not run yet."""
    out = list(names)
    for step in steps:
        out += [n for n in sorted(step.writes) if n not in out]
        out = [n for n in out if n not in step.drops]
    return out


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The table, and the number of its rows once a job has run over it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def _prepare_counted(df: DataFrame, plan: Plan, materialize: bool) -> Prepared:
    """As ``prepare``, step by step. Rows are counted on the way, by the jobs that fit a later step or write the result."""
    notes: list[Note] = []
    lines: list[tuple] = []
    checks: list[Check] = []
    df, rows = _counted(df)
    for kind in plan.order:
        before, width, seen = rows, len(df.columns), len(notes)
        may_lose = kind in ("duplicates", "missing", "outliers")
        if kind == "duplicates":
            df = _deduplicated(df, plan, notes, materialize)
        elif kind == "validate":
            checks = run_checks(df, plan.checks)
        else:
            steps, made = _steps(df, list(df.columns), plan, kind, notes)
            notes.extend(made)
            df = run(df, steps)
            may_lose = may_lose and any(s.changes_rows for s in steps)
        if may_lose:
            df, rows = _counted(df)
        detail = "; ".join(f"{n.column}: {n.detail or n.status}" for n in notes[seen:])
        if kind == "validate":
            detail = "; ".join(f"{k.name}: {'passed' if k.passed else 'failed'}" for k in checks)
        lines.append((kind, before, width, rows, len(df.columns), detail))
    # The last barrier: whatever no fit has counted yet is counted by this write.
    df = cut(df)
    told = [(kind, before.get["rows"], width, after.get["rows"], now, detail) for kind, before, width, after, now, detail in lines]
    return Prepared(df, tuple(notes), tuple(checks), local_frame(df.sparkSession, told, METRICS))


def custom_step(df: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step of the user's own, as a function from DataFrame to DataFrame."""
    return df.transform(transform)


def custom_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A row-wise step of the user's own in pandas. It sees one bounded batch at a time, never the whole table."""

    def over_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(over_batches, schema)
