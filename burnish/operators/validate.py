"""Validation checks and the quality gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.functions.columns import c, is_numeric, numeric_columns
from burnish.operators.columns import split_names
from burnish.operators.profile import constant_columns, duplicate_count
from burnish.operators.quantiles import one_row, parallel
from burnish.operators.values import local_frame

CHECKS = (
    "no_nulls", "max_null_pct", "no_duplicates", "min_rows", "expected_columns", "no_infinite", "target_column",
    "numeric_only",
)
CRITICAL = (
    "no_nulls", "no_duplicates", "expected_columns", "no_infinite", "target_column", "row_loss", "degenerate_features",
)
MAX_ROW_LOSS = 0.2
RESULT = "check_name string, passed boolean, detail string"


@dataclass(frozen=True)
class Check:
    name: str
    passed: bool
    detail: str


def validate(df: DataFrame, checks: Mapping[str, object]) -> DataFrame:
    """(check_name, passed, detail). All checks share one aggregate, except ``no_duplicates``.

    Checks: no_nulls, max_null_pct: N, no_duplicates, min_rows: N, expected_columns: names, no_infinite,
    target_column: name, numeric_only.
    """
    return results_frame(df, run_checks(df, checks))


def results_frame(df: DataFrame, results: Sequence[Check]) -> DataFrame:
    return local_frame(df.sparkSession, [(r.name, r.passed, r.detail) for r in results], RESULT)


def run_checks(df: DataFrame, checks: Mapping[str, object]) -> list[Check]:
    unknown = [name for name in checks if name not in CHECKS]
    if unknown:
        raise ValueError(f"unknown checks: {unknown}")
    wanted = {name: value for name, value in checks.items() if value is not False}
    target = wanted.get("target_column")
    aggs: dict[str, Column] = {}
    if {"no_nulls", "max_null_pct"} & wanted.keys():
        aggs.update({f"nulls|{n}": F.count_if(c(n).isNull()) for n in df.columns})
    elif target in df.columns:
        aggs[f"nulls|{target}"] = F.count_if(c(target).isNull())
    if {"max_null_pct", "min_rows"} & wanted.keys():
        aggs["rows"] = F.count("*")
    if "no_infinite" in wanted:
        aggs.update({f"infinite|{n}": _infinite(n) for n in numeric_columns(df)})
    jobs = [lambda: one_row(df, aggs), lambda: duplicate_count(df).first()[0] if "no_duplicates" in wanted else None]
    values, duplicates = parallel(df.sparkSession, jobs)
    values = {**values, "duplicates": duplicates}
    return [_check(df, name, value, values, target) for name, value in wanted.items()]


def _infinite(name: str) -> Column:
    return F.count_if(F.abs(c(name).cast("double")) == F.lit(float("inf")))


def _listed(counts: Mapping[str, object]) -> str:
    return ", ".join(f"{n}={v}" for n, v in sorted(counts.items()))


def _check(df: DataFrame, name: str, wanted: object, values: Mapping, target: object) -> Check:
    if name == "no_nulls":
        bad = {n: values[f"nulls|{n}"] for n in df.columns if values[f"nulls|{n}"]}
        return Check(name, not bad, _listed(bad))
    if name == "max_null_pct":
        rows = values["rows"]
        percents = {n: round(values[f"nulls|{n}"] / rows * 100, 2) if rows else 0.0 for n in df.columns}
        bad = {n: p for n, p in percents.items() if p > float(wanted)}
        return Check(name, not bad, _listed(bad))
    if name == "no_duplicates":
        return Check(name, values["duplicates"] == 0, f"duplicates={values['duplicates']}")
    if name == "min_rows":
        return Check(name, values["rows"] >= int(wanted), f"expected={wanted}, actual={values['rows']}")
    if name == "expected_columns":
        lost = sorted(n for n in split_names(wanted) if n not in df.columns)
        return Check(name, not lost, ", ".join(lost))
    if name == "no_infinite":
        bad = {n: values[f"infinite|{n}"] for n in numeric_columns(df) if values[f"infinite|{n}"]}
        return Check(name, not bad, _listed(bad))
    if name == "target_column":
        if target not in df.columns:
            return Check(name, False, "column not found")
        nulls = values[f"nulls|{target}"]
        return Check(name, nulls == 0, f"nulls={nulls}")
    others = sorted(f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name != target)
    return Check(name, not others, ", ".join(others))


def type_histogram(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        out[kind] = out.get(kind, 0) + 1
    return out


def validation_summary(df: DataFrame, checks: Mapping[str, object]) -> DataFrame:
    """(all_passed, rows, columns, types): one line over all checks."""
    passed = all(r.passed for r in run_checks(df, checks))
    kinds = _listed(type_histogram(df))
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select(
        F.lit(passed).alias("all_passed"), "rows", F.lit(len(df.columns)).alias("columns"), F.lit(kinds).alias("types")
    )


def row_loss(before: DataFrame, after: DataFrame, limit: float = MAX_ROW_LOSS) -> DataFrame:
    """(rows_before, rows_after, lost_pct, passed): at most a fifth of the rows may be lost."""
    counts = before.agg(F.count("*").alias("rows_before")).crossJoin(F.broadcast(after.agg(F.count("*").alias("rows_after"))))
    lost = F.coalesce(F.try_divide((F.col("rows_before") - F.col("rows_after")).cast("double"), F.col("rows_before").cast("double")), F.lit(0.0))
    return counts.withColumns({"lost_pct": F.round(lost * 100, 2), "passed": lost <= limit})


def degenerate_features(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, distinct): new columns with one value at most."""
    added = [n for n in after.columns if n not in before.columns]
    if not added:
        return local_frame(after.sparkSession, [], "column string, distinct long")
    return constant_columns(after.select(*[c(n) for n in added]))


def quality_gate(before: DataFrame, after: DataFrame, checks: Mapping[str, object]) -> DataFrame:
    """(verdict, failed, issues): PASS only if every critical check passes."""
    jobs = [
        lambda: run_checks(after, checks),
        lambda: row_loss(before, after).first(),
        lambda: sorted(r["column"] for r in degenerate_features(before, after).collect()),
    ]
    results, loss, flat = parallel(after.sparkSession, jobs)
    results.append(Check("row_loss", loss["passed"], f"lost_pct={loss['lost_pct']}"))
    results.append(Check("degenerate_features", not flat, ", ".join(flat)))
    failed = [r for r in results if not r.passed]
    verdict = "FAIL" if any(r.name in CRITICAL for r in failed) else "PASS"
    issues = "; ".join(sorted(f"{r.name}: {r.detail}" for r in failed))
    return local_frame(after.sparkSession, [(verdict, len(failed), issues)], "verdict string, failed int, issues string")
