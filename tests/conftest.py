from __future__ import annotations

import pandas as pd
import pytest

from check import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = session(cores=8, partitions=4)
    if not made.sparkContext.getCheckpointDir():
        made.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return made


@pytest.fixture
def rows(spark):
    """Collect a DataFrame in the order of a key."""

    def collect(df, key="id") -> pd.DataFrame:
        return df.toPandas().sort_values(key, ignore_index=True)

    return collect


@pytest.fixture
def plan_of():
    """The executed plan as text, after running it."""

    def text(df) -> str:
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    return text
