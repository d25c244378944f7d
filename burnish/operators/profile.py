"""Profiles: what a table holds, column by column. Every result is a small long-form table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import c, date_mask, date_shapes, numeric_columns, parse_timestamp, percent, text_columns
from burnish.operators.gram import pair_correlations
from burnish.operators.heavy import modes, top_texts
from burnish.operators.quantiles import exact_quantiles, one_row, parallel
from burnish.operators.values import cell_counts, local_frame

QUARTILES = (0.25, 0.5, 0.75)
OUTLIER_REACH = 1.5
HIGH_CORRELATION = 0.9
DROP_CORRELATION = 0.95
TOP_VALUES = 10
VALUE_BITS = 64
SALTS = 16  # tasks over which the rows of one repeated key are spread


def long_form(df: DataFrame, columns: Sequence[str], metrics: Mapping[str, tuple]) -> DataFrame:
    """One aggregate over the table, then one row per column: (column, metric...).

    ``metrics`` maps a metric name to a function of the column name that returns an aggregate, and its type.
    """
    schema = ", ".join(["column string", *[f"{metric} {kind}" for metric, (_, kind) in metrics.items()]])
    if not columns:
        return local_frame(df.sparkSession, [], schema)
    entries = []
    for name in columns:
        values = [make(name).cast(kind).alias(metric) for metric, (make, kind) in metrics.items()]
        entries.append(F.struct(F.lit(name).alias("column"), *values))
    return df.agg(F.array(*entries).alias("entries")).select(F.inline("entries"))


def null_count(name: str) -> Column:
    return F.count_if(c(name).isNull())


def schema_table(df: DataFrame) -> DataFrame:
    """(position, column, type), from the schema alone."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return local_frame(df.sparkSession, rows, "position int, column string, type string")


def shape(df: DataFrame) -> DataFrame:
    """One row per column with the table's row and column count."""
    counted = df.agg(F.count("*").alias("rows"))
    return schema_table(df).crossJoin(F.broadcast(counted)).withColumn("columns", F.lit(len(df.columns)))


def null_counts(df: DataFrame, rows_as: str | None = None) -> DataFrame:
    """(column, nulls) of every column; with ``rows_as``, one more line of that name with the row count."""
    if rows_as is None:
        return long_form(df, df.columns, {"nulls": (null_count, "long")})
    count = {name: null_count(name) for name in df.columns}
    entries = [F.struct(F.lit(n).alias("column"), v.alias("nulls")) for n, v in count.items()]
    entries.append(F.struct(F.lit(rows_as).alias("column"), F.count("*").alias("nulls")))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def null_percents(df: DataFrame) -> DataFrame:
    return long_form(
        df, df.columns, {"nulls": (null_count, "long"), "null_pct": (lambda n: percent(null_count(n), F.count("*")), "double")}
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """(column, distinct): distinct values, NULL not counted.

    Whole numbers and dates that lie closely enough are bits of bitmaps, which every task sends instead of values. All
    texts are counted by 128-bit digests; other values as they are.
    """
    names = list(df.columns if columns is None else columns)
    if approximate:
        return long_form(df, names, {"distinct": (lambda n: F.approx_count_distinct(c(n)), "long")})
    close = close_columns(df, names)
    others = df.select(*[_digest(df, n).alias(n) for n in names if n not in close])
    counted = cell_counts(others, others.columns).groupBy("column").agg(F.count("*").alias("distinct"))
    if close:
        counted = counted.unionByName(bitmap_counts(df, close))
    listed = local_frame(df.sparkSession, [(n,) for n in names], "column string")
    joined = listed.join(counted, "column", "left")
    return joined.select("column", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def _digest(df: DataFrame, name: str) -> Column:
    """Texts as their digest, so that counting them does not move them."""
    return F.unhex(F.md5(c(name).cast("binary"))) if isinstance(df.schema[name].dataType, T.StringType) else c(name)


def _whole(df: DataFrame, name: str) -> Column:
    day = isinstance(df.schema[name].dataType, T.DateType)
    return F.unix_date(c(name)).cast("long") if day else c(name).cast("long")


def close_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns of whole numbers or dates whose values take fewer bits as a bitmap than as values of 64 bits."""
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)
    whole = [n for n in names if isinstance(df.schema[n].dataType, kinds)]
    found = one_row(df, {(n, f.__name__): f(_whole(df, n)) for n in whole for f in (F.count, F.min, F.max)})
    return [n for n in whole if found[n, "count"] and found[n, "max"] - found[n, "min"] < VALUE_BITS * found[n, "count"]]


def bitmap_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(column, distinct) by bitmaps of 4 KB, each for 32,768 neighbouring values; those of all tasks are joined by OR."""
    cells = df.select(*[_whole(df, n).alias(n) for n in names]).unpivot([], [c(n) for n in names], "column", "value")
    buckets = cells.where(F.col("value").isNotNull()).groupBy("column", F.bitmap_bucket_number("value").alias("bucket"))
    bits = buckets.agg(F.bitmap_construct_agg(F.bitmap_bit_position("value")).alias("bits"))
    return bits.groupBy("column").agg(F.sum(F.bitmap_count("bits")).alias("distinct"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one value."""
    return distinct_counts(df).where(F.col("distinct") <= 1)


def sample_rows(df: DataFrame, order_by: str, n: int = 3) -> DataFrame:
    """The first rows in the order of a key."""
    return df.orderBy(c(order_by)).limit(n)


def describe_numeric(
    df: DataFrame, columns: Sequence[str] | None = None, quartile: Mapping[tuple[str, float], float] | None = None
) -> DataFrame:
    """(column, count, mean, std, min, q1, median, q3, max) of the numeric columns, to four places.

    Quartiles already known may be handed in.
    """
    names = list(numeric_columns(df) if columns is None else columns)
    quartile = quartile if quartile is not None else exact_quantiles(df, {n: QUARTILES for n in names})
    metrics: dict[str, tuple] = {
        "count": (lambda n: F.count(c(n)), "long"),
        "mean": (lambda n: F.round(F.mean(c(n)), 4), "double"),
        "std": (lambda n: F.round(F.stddev_samp(c(n)), 4), "double"),
        "min": (lambda n: F.round(F.min(c(n).cast("double")), 4), "double"),
        "max": (lambda n: F.round(F.max(c(n).cast("double")), 4), "double"),
    }
    for label, p in zip(("q1", "median", "q3"), QUARTILES):
        metrics[label] = (lambda n, p=p: F.round(F.lit(quartile[n, p]).cast("double"), 4), "double")
    return long_form(df, names, metrics)


def outlier_bounds(
    df: DataFrame, columns: Sequence[str], quartile: Mapping[tuple[str, float], float] | None = None
) -> dict[str, tuple[float, float]]:
    """{column: (low, high)} of 1.5 interquartile ranges; columns without spread are left out."""
    quartile = quartile if quartile is not None else exact_quantiles(df, {n: (0.25, 0.75) for n in columns})
    out = {}
    for n in columns:
        q1, q3 = quartile[n, 0.25], quartile[n, 0.75]
        if q1 is not None and q3 > q1:
            out[n] = q1 - OUTLIER_REACH * (q3 - q1), q3 + OUTLIER_REACH * (q3 - q1)
    return out


def outside(name: str, bounds: tuple[float, float]) -> Column:
    value = c(name).cast("double")
    return (value < F.lit(bounds[0])) | (value > F.lit(bounds[1]))


def outlier_counts(
    df: DataFrame, columns: Sequence[str] | None = None, quartile: Mapping[tuple[str, float], float] | None = None
) -> DataFrame:
    """(column, outliers, outlier_pct) of the numeric columns that have any."""
    names = list(numeric_columns(df) if columns is None else columns)
    bounds = outlier_bounds(df, names, quartile)
    metrics = {
        "outliers": (lambda n: F.count_if(outside(n, bounds[n])), "long"),
        "outlier_pct": (lambda n: percent(F.count_if(outside(n, bounds[n])), F.count("*")), "double"),
    }
    return long_form(df, list(bounds), metrics).where(F.col("outliers") > 0)


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(col1, col2, correlation): absolute Pearson of every pair, over the rows where both have a value.

    A first pass finds the means; a second one multiplies each batch of centered rows with itself, block of columns by
    block, and tasks send the blocks' sums. The correlations stay distributed. A column without spread gives NULL.
    """
    names = list(numeric_columns(df) if columns is None else columns)
    schema = "col1 string, col2 string, correlation double"
    if len(names) < 2:
        return local_frame(df.sparkSession, [], schema)
    means = one_row(df, {n: F.mean(c(n).cast("double")) for n in names})
    centered = df.select(*[(c(n).cast("double") - F.lit(means[n]).cast("double")).alias(f"x{i}") for i, n in enumerate(names)])
    found = pair_correlations(centered)
    listed = local_frame(df.sparkSession, list(enumerate(names)), "i int, name string")
    first, second = listed.withColumnRenamed("name", "col1"), listed.toDF("j", "col2")
    named = found.join(F.broadcast(first), "i").join(F.broadcast(second), "j")
    return named.select("col1", "col2", "correlation")


def high_correlations(df: DataFrame, columns: Sequence[str] | None = None, above: float = HIGH_CORRELATION) -> DataFrame:
    found = correlations(df, columns).where(F.col("correlation") > above)
    return found.withColumn("correlation", F.round("correlation", 4))


def cardinality(df: DataFrame) -> DataFrame:
    """Distinct values per text column."""
    return distinct_counts(df, text_columns(df))


def top_categories(df: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """(column, value, n, rank): the most frequent values per text column."""
    return top_texts(df, text_columns(df), k)


def average_lengths(df: DataFrame) -> DataFrame:
    return long_form(df, text_columns(df), {"avg_length": (lambda n: F.round(F.avg(F.length(c(n))), 1), "double")})


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per key; NULLs are equal. Copies are summed per task before the shuffle."""
    return df.groupBy(*[c(n) for n in columns]).agg(F.count("*").alias("__rows"))


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(duplicates): rows after the first one of each key.

    First only 64-bit hashes of the keys are grouped, which is a small part of the data. Rows whose hash occurs once
    have no copy; the others are compared by their real values. Rows meet the repeated hashes in SALTS parts each, so
    that a key that very many rows share is spread over tasks, and is summed per task before it meets itself.
    """
    names = list(df.columns if columns is None else columns)
    hashed = df.withColumn("__hash", F.xxhash64(*[c(n) for n in names]))
    repeated = hashed.groupBy("__hash").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    repeated = repeated.select("__hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = hashed.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    suspects = salted.join(repeated, ["__hash", "__salt"], "left_semi")
    groups = duplicate_groups(suspects, names)
    return groups.agg(F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("duplicates"))


def date_candidates(df: DataFrame) -> DataFrame:
    """(column, filled, parsed): text columns whose values all read as dates.

    A first pass looks at the shapes; only columns whose values all have that of a date are parsed, as their shapes say.
    """
    names = text_columns(df)
    seen: dict[tuple[str, str], Column] = {}
    for n in names:
        seen[n, "filled"], seen[n, "shapes"] = F.count(c(n)), date_shapes(n)
        seen[n, "dated"] = F.count_if(date_mask(n) > 0)
    found = one_row(df, seen)
    names = [n for n in names if found[n, "filled"] and found[n, "filled"] == found[n, "dated"]]
    metrics = {
        "filled": (lambda n: F.count(c(n)), "long"),
        "parsed": (lambda n: F.count(parse_timestamp(c(n), found[n, "shapes"])), "long"),
    }
    return long_form(df, names, metrics).where("filled > 0 and filled = parsed")


def inventory(df: DataFrame) -> DataFrame:
    """(column, type, distinct, nulls, null_pct, filled, min, max, mean, mode): numbers have a mean, the rest a mode."""
    numeric = set(numeric_columns(df))

    def number(fn):
        return lambda n: F.round(fn(c(n).cast("double")), 4) if n in numeric else F.lit(None)

    metrics = {
        "nulls": (null_count, "long"),
        "null_pct": (lambda n: percent(null_count(n), F.count("*")), "double"),
        "filled": (lambda n: F.count(c(n)), "long"),
        "min": (number(F.min), "double"),
        "max": (number(F.max), "double"),
        "mean": (number(F.mean), "double"),
    }
    others = [n for n in df.columns if n not in numeric]
    common = local_frame(df.sparkSession, list(modes(df, others, as_text=True).items()), "column string, mode string")
    return (
        schema_table(df)
        .drop("position")
        .join(F.broadcast(long_form(df, df.columns, metrics)), "column")
        .join(distinct_counts(df), "column", "left")
        .join(common, "column", "left")
    )


def summary(df: DataFrame) -> DataFrame:
    """(rows, columns, nulls, duplicates): one line per table."""
    total = reduce(lambda a, b: a + b, [null_count(n) for n in df.columns])
    one = df.agg(F.count("*").alias("rows"), total.alias("nulls")).withColumn("columns", F.lit(len(df.columns)))
    return one.crossJoin(F.broadcast(duplicate_count(df)))


def summaries(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One summary line per named table, such as the original and the output."""
    return reduce(DataFrame.unionByName, [summary(df).withColumn("dataset", F.lit(n)) for n, df in tables.items()])


def rank_datasets(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(dataset, rows, columns, missing_pct): fewest missing cells first, then most rows, then CSV and Parquet first.

    Each table comes with its format.
    """
    lines = []
    for name, (df, fmt) in tables.items():
        nulls = reduce(lambda a, b: a + b, [null_count(n) for n in df.columns])
        cells = F.count("*") * len(df.columns)
        lines.append(
            df.agg(F.count("*").alias("rows"), percent(nulls, cells).alias("missing_pct")).select(
                F.lit(name).alias("dataset"),
                "rows",
                F.lit(len(df.columns)).alias("columns"),
                "missing_pct",
                F.lit(0 if fmt in ("csv", "parquet") else 1).alias("format_rank"),
            )
        )
    return reduce(DataFrame.unionByName, lines).orderBy("missing_pct", F.desc("rows"), "format_rank", "dataset")


def drop_suggestions(df: DataFrame) -> DataFrame:
    """(column, reason): constant columns, and the later one of each closely correlated pair."""
    constant = constant_columns(df).select("column", F.lit("constant").alias("reason"))
    twins = correlations(df).where(F.col("correlation") >= DROP_CORRELATION)
    return constant.unionByName(twins.select(F.col("col2").alias("column"), F.lit("correlated").alias("reason")).distinct())


def profile(df: DataFrame, order_by: str | None = None) -> dict[str, DataFrame]:
    """The whole profile as named small tables.

    What several parts need (quartiles, distinct counts) is found once. The jobs do not depend on each other and run
    side by side; only results of one row per column, or a few per column, reach the driver.
    """
    numbers = numeric_columns(df)
    texts = text_columns(df)

    def numeric() -> dict[str, DataFrame]:
        quartile = exact_quantiles(df, {n: QUARTILES for n in numbers})
        return {
            "numeric": _held(describe_numeric(df, numbers, quartile)),
            "outliers": _held(outlier_counts(df, numbers, quartile)),
        }

    def distinct() -> dict[str, DataFrame]:
        held = _held(distinct_counts(df))
        return {"distinct": held, "constant": held.where(F.col("distinct") <= 1)}

    jobs = [
        numeric if numbers else dict,
        distinct,
        lambda: {"duplicates": _held(duplicate_count(df))},
        lambda: {"correlations": high_correlations(df)},
        lambda: {"shape": _held(shape(df)), "missing": _held(null_percents(df))},
        lambda: {"categories": _held(top_categories(df)), "lengths": _held(average_lengths(df))} if texts else {},
        lambda: {"dates": _held(date_candidates(df))},
        lambda: {"sample": sample_rows(df, order_by)} if order_by else {},
    ]
    return {name: part for parts in parallel(df.sparkSession, jobs) for name, part in parts.items()}


def _held(part: DataFrame) -> DataFrame:
    """A small table as the values it has now."""
    return local_frame(part.sparkSession, part.collect(), part.schema)
