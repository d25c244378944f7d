"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it in ``spark.checkpoint.dir``.

    Only where all executors live in the driver's own process does a temporary folder do; elsewhere each executor
    would write to a disk of its own, and rows would be lost, so a session without a named folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return _local_folder()


@lru_cache(maxsize=1)
def _local_folder() -> str:
    """One temporary folder for the life of a local process; it goes with the process."""
    made = tempfile.TemporaryDirectory(prefix="burnish-")
    atexit.register(made.cleanup)
    return made.name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table that later work reads more than once, and read it back.

    Losing an executor then costs reading a file again, not computing the table again, and as the file is columnar
    each later pass reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
