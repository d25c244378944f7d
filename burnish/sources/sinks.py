"""Writers. Every task writes its own part; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; inner quotes are doubled, blanks around a text are kept."""
    options = {"header": True, "sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)


def write_output(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Write the prepared table and return the rows written. They are counted by the job that writes them."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if fmt == "csv":
        write_csv(counted, path)
    else:
        counted.write.mode("overwrite").parquet(path)
    return seen.get["rows"]
