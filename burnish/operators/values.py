"""Counts of distinct values, small parameter tables, and skew-safe lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.functions.columns import c
from burnish.session import cut

SALTS = 8  # tasks over which the rows of one value, or of none, are spread when they are joined
VALUE, ROWS = "__value", "__rows"


ARROW = {
    "string": pa.string(), "boolean": pa.bool_(), "tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(),
    "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "date": pa.date32(),
    "timestamp_ntz": pa.timestamp("us"), "timestamp": pa.timestamp("us", "UTC"),
}


def local_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType | str) -> DataFrame:
    """A small table of driver-side parameters. It plans as a local relation, so Spark knows its size."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)

    def kind(data_type: T.DataType) -> pa.DataType:
        if isinstance(data_type, T.DecimalType):
            return pa.decimal128(data_type.precision, data_type.scale)
        return ARROW[data_type.simpleString()]

    arrays = [pa.array([row[i] for row in rows], type=kind(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema=schema)


def cell_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): rows per distinct value of each column, NULL left out, value as text.

    Columns of one type are turned into rows together, so each branch scans only its own columns and the shuffle
    carries typed values, already summed per task. Turning a value into text happens after the grouping.
    """
    by_type: dict[str, list[str]] = {}
    for name in columns:
        by_type.setdefault(df.schema[name].dataType.simpleString(), []).append(name)
    if not by_type:
        return local_frame(df.sparkSession, [], "column string, value string, n long")
    parts = []
    for names in by_type.values():
        cells = df.select(*[c(n) for n in names]).unpivot([], [c(n) for n in names], "column", "value")
        counted = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
        parts.append(counted.select("column", F.col("value").cast("string").alias("value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent values per column; ties by value. Spark cuts to k per task before the shuffle."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Categories:
    """Distinct values of one column with their row counts and extra aggregates, or ``too_many`` of them."""

    rows: tuple[Mapping[str, object], ...] = ()
    too_many: bool = False


@dataclass(frozen=True)
class CategoryNeed:
    """Values that come to the driver because the result has a column, or a literal, for each of them."""

    column: str
    extras: Mapping[str, Column] = field(default_factory=dict, hash=False)
    limit: int | None = None

    @property
    def key(self) -> tuple:
        return self.column, tuple(self.extras), self.limit


def grouped_values(df: DataFrame, name: str, extras: Mapping[str, Column], as_text: bool = False) -> DataFrame:
    """One row per non-missing value of the column."""
    value = c(name).cast("string") if as_text else c(name)
    return (
        df.where(c(name).isNotNull())
        .groupBy(value.alias(VALUE))
        .agg(F.count("*").alias(ROWS), *[value.alias(alias) for alias, value in extras.items()])
    )


def fetch_categories(df: DataFrame, need: CategoryNeed) -> Categories:
    """Bring the values to the driver; with a limit, only if there are at most that many."""
    found = grouped_values(df, need.column, need.extras)
    if need.limit is None:
        return Categories(tuple(r.asDict() for r in found.collect()))
    rows = found.limit(need.limit + 1).collect()
    return Categories(too_many=True) if len(rows) > need.limit else Categories(tuple(r.asDict() for r in rows))


def looked_up(df: DataFrame, name: str, table: DataFrame, mapped: str) -> DataFrame:
    """Replace the column by ``table.<mapped>``, for a table of any size with one row per value.

    One left join that reads ``df`` once. Rows are dealt by value and salt, and each value of the table stands in all
    salts, so rows that share one value, or have none, are spread. A small table is broadcast by Spark itself.
    """
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    table = table.select(VALUE, F.col(mapped).alias("__mapped"), salts)
    salted = df.withColumn("__salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    joined = salted.join(table, (c(name) == F.col(VALUE)) & (salted["__salt"] == table["__salt"]), "left")
    return joined.select(*[F.col("__mapped").alias(n) if n == name else c(n) for n in df.columns])


def number_sorted(table: DataFrame, key: str, code: str) -> DataFrame:
    """Give each distinct text of the table its place in sorted order, from 0, without sorting it in one task.

    One range shuffle sorts the table, in as many parts as Spark makes of it. The written result holds each row's part and its place there, and a part
    starts after the rows of the parts before it: one number per part.
    """
    spark = table.sparkSession
    ordered = table.repartitionByRange(key).sortWithinPartitions(key)
    placed = cut(ordered.withColumn("__place", F.monotonically_increasing_id()))
    # monotonically_increasing_id() is the number of the part times 2^33, plus the place of the row in it.
    part, within = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit(2**33 - 1))
    placed = placed.withColumn("__part", part)
    sizes = placed.groupBy("__part").count().orderBy("__part").collect()
    starts, seen = [], 0
    for r in sizes:
        starts.append((r["__part"], seen))
        seen += r["count"]
    first = local_frame(spark, starts, "__part long, __start long")
    numbered = placed.join(F.broadcast(first), "__part")
    return numbered.withColumn(code, F.col("__start") + within).drop("__part", "__start", "__place")
