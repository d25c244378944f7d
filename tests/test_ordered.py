import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from burnish.operators import ordered
from burnish.operators.ordered import ordered_fill

HOW = {"ffill": lambda s: s.ffill(), "bfill": lambda s: s.bfill(), "interpolate": lambda s: s.interpolate("linear")}


def check(spark, values, ranges):
    data = [(i * 3, v, v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data[::-1], "id long, ffill double, bfill double, interpolate double").repartition(3)
    got = ordered_fill(df, {h: h for h in HOW}, "id", ranges).toPandas().sort_values("id", ignore_index=True)
    series = pd.Series(values, dtype="float64")
    for how, fill in HOW.items():
        np.testing.assert_allclose(got[how].astype("float64"), fill(series), rtol=1e-12, err_msg=how)


@pytest.mark.parametrize("ranges", [1, 2, 5, 40])
def test_gaps_across_ranges(spark, ranges):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.7 else float(v) for v in rng.integers(0, 100, 200)]
    values[:30] = [None] * 30
    values[60:140] = [None] * 80
    values[-10:] = [None] * 10
    check(spark, values, ranges)


def test_all_missing_and_one_row(spark):
    check(spark, [None, None, None], 2)
    check(spark, [4.0], 3)


def test_both_ends(spark):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, None), (3, 3.0), (4, None)], "id int, v double")
    got = ordered_fill(df, {"v": "interpolate"}, "id", 3).orderBy("id").toPandas()["v"]
    assert got[1:].tolist() == [1.0, 2.0, 3.0, 3.0]
    assert np.isnan(got[0])


def test_text_in_time_order(spark):
    data = [("2024-01-01 00:00:05", None), ("2024-01-01 00:00:01", "a"), ("2024-01-02 00:00:00", None)]
    df = spark.createDataFrame(data, "t string, v string").selectExpr("cast(t as timestamp_ntz) t", "v")
    got = ordered_fill(df, {"v": "ffill"}, "t", 2).orderBy("t").toPandas()["v"]
    assert got.tolist() == ["a", "a", "a"]


def test_order_of_text_and_of_several_columns(spark):
    data = [("a", 2, None), ("b", 1, None), ("a", 1, 5.0), ("b", 2, 7.0), ("A", 9, None)]
    df = spark.createDataFrame(data, "k string, n int, v double").repartition(3)
    got = ordered_fill(df, {"v": "ffill"}, ["k", "n"], 3).orderBy("k", "n").toPandas()["v"]
    assert got.fillna(-1).tolist() == [-1, 5, 5, 5, 7]
    line = ordered_fill(df, {"v": "interpolate"}, ["k", "n"], 2).orderBy("k", "n").toPandas()["v"]
    assert line[1:].tolist() == [5, 17 / 3, 19 / 3, 7]


@pytest.mark.parametrize("rows", [30, 9_000])
@pytest.mark.parametrize("ranges", [None, 1, 10])
def test_ties_are_refused_at_any_size(spark, rows, ranges):
    df = spark.range(rows).selectExpr("case when id = 3 then 4 else id end as id", "id as n", "cast(null as double) as v")
    with pytest.raises(ValueError, match="tell rows apart: 2 of"):
        ordered_fill(df, {"v": "ffill"}, "id", ranges)
    assert ordered_fill(df, {"v": "ffill"}, ["id", "n"], ranges).count() == rows


def test_a_missing_key_is_refused(spark):
    df = spark.createDataFrame([(1, 1.0), (None, None)], "id int, v double")
    with pytest.raises(ValueError, match="filled"):
        ordered_fill(df, {"v": "ffill"}, "id")


def test_ties_are_counted_in_the_pass_that_sorts(spark, plan_of):
    df = spark.range(5_000).selectExpr("id", "id % 7 as k", "case when id % 3 = 0 then cast(id as double) end as v")
    text = plan_of(ordered._dealt(df, [F.col("id"), F.col("k")], 8))
    assert text[: text.index("Initial Plan")].count("Exchange") == 1 and "rangepartitioning" in text
    assert text[: text.index("Initial Plan")].count("Sort [") == 1
    ranged = ordered.with_ranges(df, "id", 8)
    edges = plan_of(ordered._edges(ranged, {"v": "interpolate"}, [F.col("id")]))
    assert "SortAggregate" not in edges and "hashpartitioning(__range" in edges
    places = ranged.groupBy("__range").agg(F.count("*").alias("n"), F.max("__place").alias("last"), F.max("__same").alias("same")).collect()
    assert len(places) == 8 and all(r["last"] == r["n"] - 1 and r["same"] == 1 for r in places)


def test_no_task_sorts_the_whole_table(spark, plan_of):
    df = spark.range(5_000).selectExpr("id", "case when id % 3 = 0 then id end as v")
    text = plan_of(ordered_fill(df, {"v": "ffill"}, "id", 8))
    assert "hashpartitioning(__range" in text
    assert "BroadcastHashJoin" in text
    # The only windows without a partition run over the table of ranges, which is one row per range.
    assert "SinglePartition" in text
    assert "PythonUDF" not in text and "MapInPandas" not in text


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-9, 9).map(float)), min_size=1, max_size=40),
    ranges=st.integers(1, 6),
)
def test_any_values(spark, values, ranges):
    check(spark, values, ranges)
