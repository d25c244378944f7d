"""Duplicate rows by key. A key that holds a large part of the rows is cut down in each task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burnish.functions.columns import c
from burnish.operators.columns import split_names
from burnish.operators.profile import duplicate_groups
from burnish.operators.steps import Note, Outcome

STRATEGIES = ("keep_first", "keep_last", "drop_all", "keep")


def key_columns(df: DataFrame, subset: str | Sequence[str]) -> list[str]:
    names = df.columns if subset == "all" else split_names(subset)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"no such key columns: {unknown}")
    return list(names)


def remove_duplicates(
    df: DataFrame, strategy: str, subset: str | Sequence[str] = "all", order_by: str | None = None
) -> Outcome:
    """Keep the first or last row per key in the order of ``order_by``, or only keys that occur once."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown duplicate strategy: {strategy}")
    keys = key_columns(df, subset)
    note = Note("duplicates", ",".join(keys), "done", strategy)
    whole_row = set(keys) == set(df.columns)
    if strategy == "keep":
        return Outcome(df)
    if strategy == "drop_all":
        return Outcome(_only_single(df, keys, whole_row), (note,))
    if whole_row:
        return Outcome(df.dropDuplicates(), (note,))
    if not order_by:
        raise ValueError(f"{strategy} needs order_by: a table has no row order of its own")
    order = c(order_by).asc() if strategy == "keep_first" else c(order_by).desc()
    # row_number() = 1 plans as a group limit: every task keeps one row per key before anything is shuffled.
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*[c(k) for k in keys]).orderBy(order)))
    return Outcome(ranked.where(F.col("__rank") == 1).drop("__rank"), (note,))


def _only_single(df: DataFrame, keys: Sequence[str], whole_row: bool) -> DataFrame:
    if whole_row:
        return duplicate_groups(df, df.columns).where(F.col("__rows") == 1).drop("__rows")
    # Two rows of a key already rule it out, so no task has to keep or send more than two.
    window = Window.partitionBy(*[c(k) for k in keys])
    two = df.withColumn("__rank", F.row_number().over(window.orderBy(*[c(k) for k in keys]))).where(F.col("__rank") <= 2)
    return two.withColumn("__rows", F.count("*").over(window)).where(F.col("__rows") == 1).drop("__rank", "__rows")


def duplicate_report(df: DataFrame, strategy: str, subset: str | Sequence[str] = "all") -> DataFrame:
    """(found, removed, rows_after, rows_removed) of a strategy, from one count per key."""
    n = F.col("__rows")
    after = F.count_if(n == 1) if strategy == "drop_all" else F.count("*") if strategy != "keep" else F.sum(n)
    found = F.coalesce(F.sum(n - 1), F.lit(0))
    report = duplicate_groups(df, key_columns(df, subset)).agg(
        found.alias("found"),
        (F.lit(0) if strategy == "keep" else found).alias("removed"),
        F.coalesce(after, F.lit(0)).alias("rows_after"),
        (F.coalesce(F.sum(n), F.lit(0)) - F.coalesce(after, F.lit(0))).alias("rows_removed"),
    )
    return report.select(*[F.col(x).cast("long").alias(x) for x in report.columns])
