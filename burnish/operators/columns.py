"""Dropping columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from burnish.operators.steps import Note, Outcome, Step


def split_names(names: str | Sequence[str]) -> list[str]:
    if isinstance(names, str):
        names = names.split(",")
    return [n.strip() for n in names if n.strip()]


def drop_columns(df: DataFrame, columns: str | Sequence[str]) -> Outcome:
    """Drop the named columns; names that do not exist are noted."""
    wanted = split_names(columns)
    notes = drop_notes(df.columns, wanted)
    return Outcome(df.drop(*[n for n in wanted if n in df.columns]), tuple(notes))


def drop_steps(
    names: Sequence[str], columns: str | Sequence[str], reasons: Mapping[str, str] | None = None
) -> tuple[list[Step], list[Note]]:
    wanted = split_names(columns)
    return [Step(drops=(n,)) for n in wanted if n in names], drop_notes(names, wanted, reasons or {})


def drop_notes(names: Sequence[str], wanted: Sequence[str], reasons: Mapping[str, str] | None = None) -> list[Note]:
    """What became of each column, with the reason for dropping it if one is known."""
    why = reasons or {}
    return [Note("drop", n, "done", why.get(n, "")) if n in names else Note("drop", n, "skipped", "column not found") for n in wanted]
