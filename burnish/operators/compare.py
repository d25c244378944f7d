"""Comparison of a table before and after preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, numeric_columns
from burnish.operators.profile import duplicate_count, long_form, null_counts, schema_table
from burnish.operators.validate import type_histogram
from burnish.operators.values import local_frame


def shape_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(rows_before, columns_before, rows_after, columns_after)"""
    return (
        before.agg(F.count("*").alias("rows_before"))
        .crossJoin(F.broadcast(after.agg(F.count("*").alias("rows_after"))))
        .withColumns({"columns_before": F.lit(len(before.columns)), "columns_after": F.lit(len(after.columns))})
    )


def schema_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, status, type_before, type_after, nulls_before, nulls_after): added, removed, kept or retyped."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        typed = schema_table(df).select("column", F.col("type").alias(f"type_{suffix}"))
        return typed.join(F.broadcast(null_counts(df).withColumnRenamed("nulls", f"nulls_{suffix}")), "column")

    old, new = F.col("type_before"), F.col("type_after")
    status = F.when(old.isNull(), "added").when(new.isNull(), "removed").when(old == new, "kept").otherwise("retyped")
    return side(before, "before").join(side(after, "after"), "column", "full_outer").withColumn("status", status)


def output_types(after: DataFrame) -> DataFrame:
    """(type, columns): columns per type of the output."""
    return local_frame(after.sparkSession, list(type_histogram(after).items()), "type string, columns int")


def null_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(nulls_before, nulls_after)"""
    old = null_counts(before).agg(F.sum("nulls").alias("nulls_before"))
    return old.crossJoin(F.broadcast(null_counts(after).agg(F.sum("nulls").alias("nulls_after"))))


def duplicate_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """(duplicates_before, duplicates_after)"""
    old = duplicate_count(before).withColumnRenamed("duplicates", "duplicates_before")
    return old.crossJoin(F.broadcast(duplicate_count(after).withColumnRenamed("duplicates", "duplicates_after")))


def stat_shifts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, mean_shift, std_shift) of the numeric columns that both tables have, to four places."""
    common = [n for n in numeric_columns(before) if n in numeric_columns(after)]

    def side(df: DataFrame, suffix: str) -> DataFrame:
        metrics = {
            f"mean_{suffix}": (lambda n: F.mean(c(n).cast("double")), "double"),
            f"std_{suffix}": (lambda n: F.stddev_samp(c(n).cast("double")), "double"),
        }
        return long_form(df, common, metrics)

    joined = side(before, "before").join(F.broadcast(side(after, "after")), "column")
    return joined.select(
        "column",
        F.round(F.col("mean_after") - F.col("mean_before"), 4).alias("mean_shift"),
        F.round(F.col("std_after") - F.col("std_before"), 4).alias("std_shift"),
    )


def compare(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """The whole comparison as named small tables."""
    return {
        "shape": shape_delta(before, after),
        "schema": schema_diff(before, after),
        "types": output_types(after),
        "missing": null_totals(before, after),
        "duplicates": duplicate_totals(before, after),
        "shifts": stat_shifts(before, after),
    }
