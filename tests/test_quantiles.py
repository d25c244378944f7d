import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from burnish.operators.quantiles import exact_quantiles

SHARES = (0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0)


def check(spark, values, direct, gather):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)
    got = exact_quantiles(df, {"x": SHARES}, direct_distinct=direct, gather_rows=gather)
    filled = pd.Series([v for v in values if v is not None], dtype="float64")
    for p in SHARES:
        if filled.empty:
            assert got["x", p] is None
        else:
            assert got["x", p] == pytest.approx(filled.quantile(p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize(("direct", "gather"), [(10**6, 10**6), (0, 10**6), (0, 50), (0, 1)])
def test_many_values(spark, direct, gather):
    values = np.random.default_rng(1).lognormal(3, 2, 20_000).tolist()
    check(spark, values, direct, gather)


def test_a_third_of_the_rows_in_one_value(spark):
    rng = np.random.default_rng(2)
    values = [7.5] * 5_000 + rng.normal(0, 100, 10_000).tolist()
    check(spark, values, 0, 10)


def test_nulls_infinities_and_negatives(spark):
    values = [None] * 50 + [-np.inf, np.inf] + list(range(-100, 100))
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
    got = exact_quantiles(df, {"x": (0.25, 0.5)}, direct_distinct=0, gather_rows=5)
    filled = pd.Series([v for v in values if v is not None])
    assert got["x", 0.5] == filled.quantile(0.5)
    assert got["x", 0.25] == filled.quantile(0.25)


def test_no_values_and_several_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3), (2.0, None, 4), (5.0, None, 9)], "a double, b double, c int")
    got = exact_quantiles(df, {"a": (0.5,), "b": (0.5,), "c": (0.25, 0.5)}, direct_distinct=0, gather_rows=1)
    assert got == {("a", 0.5): 2.0, ("b", 0.5): None, ("c", 0.25): 3.5, ("c", 0.5): 4.0}


def test_empty_table(spark):
    assert exact_quantiles(spark.createDataFrame([], "a double"), {"a": (0.5,)}) == {("a", 0.5): None}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.none(), st.integers(-5, 5), st.floats(-1e6, 1e6)), max_size=60))
def test_any_values(spark, values):
    check(spark, values, 0, 2)
