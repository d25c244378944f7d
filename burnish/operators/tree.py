"""Merging what tasks have found in several levels, so that no task reads a row of every other one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64  # parts of one key that one task merges
LEVELS = 3  # the last one merges what is left: 250 parts for each key, of a million tasks


def merged_by_tree(
    parts: DataFrame, keys: Sequence[str], merge: Callable[[tuple, pa.Table], pa.Table], ddl: str, fan_in: int = FAN_IN
) -> DataFrame:
    """Merge rows (grp, keys..., values...), where ``grp`` is the number of the task that made them.

    ``merge`` gets the rows of ``fan_in`` groups for one key, with (grp, *keys) as its own key, and returns rows of the
    same schema. All levels are one job, and only parts are shuffled.
    """
    for level in range(LEVELS):
        above = F.floor(F.col("grp") / fan_in) if level < LEVELS - 1 else F.lit(0).cast("long")
        parts = parts.withColumn("grp", above).groupBy("grp", *keys).applyInArrow(merge, ddl)
    return parts.drop("grp")
