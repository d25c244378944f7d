"""Which files a folder holds, and a first look at a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.columns import c
from burnish.operators.profile import null_counts, schema_table

# The file types that are data.
DATA_EXTENSIONS = (".csv", ".tsv", ".json", ".jsonl", ".txt", ".parquet", ".xlsx", ".xls")
PREVIEW_ROWS = 5


def file_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(folder, file, extension, size_kb, supported) of all files below a folder. No file content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"),
        extension.alias("extension"),
        F.round(F.col("length") / 1024, 2).alias("size_kb"),
        extension.isin(*DATA_EXTENSIONS).alias("supported"),
    )


def preview(df: DataFrame, order_by: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows in the order of a key: each task offers only its first n."""
    return df.orderBy(c(order_by)).limit(n)


def preview_summary(df: DataFrame, order_by: str, n: int = PREVIEW_ROWS) -> DataFrame:
    """(column, type, nulls, rows): missing values within the preview, and the table's true row count."""
    counted = df.agg(F.count("*").alias("rows"))
    nulls = null_counts(preview(df, order_by, n))
    return schema_table(df).drop("position").join(F.broadcast(nulls), "column").crossJoin(F.broadcast(counted))
