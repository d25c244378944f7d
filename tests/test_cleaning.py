import pandas as pd
import pytest

from burnish import drop_columns, duplicate_report, remove_duplicates, repair_types
from burnish.operators.dtypes import type_report
from burnish.operators.profile import duplicate_count


def test_drop_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, `c.d` int")
    outcome = drop_columns(df, "b, nothing, c.d")
    assert outcome.df.columns == ["a"]
    assert [(n.column, n.status) for n in outcome.notes] == [("b", "done"), ("nothing", "skipped"), ("c.d", "done")]


def keyed(spark):
    data = [(1, "a", None), (2, "a", None), (3, "b", 1), (4, "a", 1), (5, "a", None), (6, None, 1), (7, None, 1)]
    return spark.createDataFrame(data, "id int, k string, v int").repartition(3)


@pytest.mark.parametrize(("strategy", "keep"), [("keep_first", "first"), ("keep_last", "last"), ("drop_all", False)])
def test_subset_like_pandas(spark, rows, strategy, keep):
    out = rows(remove_duplicates(keyed(spark), strategy, "k, v", "id").df)
    expected = keyed(spark).toPandas().sort_values("id").drop_duplicates(["k", "v"], keep=keep).reset_index(drop=True)
    pd.testing.assert_frame_equal(out, expected, check_dtype=False)


@pytest.mark.parametrize(("strategy", "kept"), [("keep_first", 4), ("drop_all", 2)])
def test_whole_rows(spark, strategy, kept):
    df = keyed(spark).drop("id")
    assert remove_duplicates(df, strategy).df.count() == kept


@pytest.mark.parametrize("strategy", ["keep_first", "drop_all"])
def test_report_like_pandas(spark, strategy):
    pandas = keyed(spark).toPandas()
    before = int(pandas.duplicated(["k", "v"]).sum())
    left = pandas.drop_duplicates(["k", "v"], keep="first" if strategy == "keep_first" else False)
    report = duplicate_report(keyed(spark), strategy, "k,v").first()
    assert tuple(report) == (before, before, len(left), len(pandas) - len(left))


def test_hot_key_is_cut_down_before_the_shuffle(spark, plan_of):
    df = spark.range(9_000).selectExpr("id", "case when id % 3 = 0 then -1 else id end as k")
    out = remove_duplicates(df, "keep_first", "k", "id").df
    text = plan_of(out)
    assert "row_number(), 1, Partial" in text
    assert out.count() == 6_001
    single = remove_duplicates(df, "drop_all", "k").df
    assert "row_number(), 2, Partial" in plan_of(single)
    assert single.count() == 6_000


def test_duplicates_need_a_key_and_an_order(spark):
    with pytest.raises(ValueError, match="order_by"):
        remove_duplicates(keyed(spark), "keep_first", "k")
    with pytest.raises(ValueError, match="no such key"):
        remove_duplicates(keyed(spark), "keep_first", "x", "id")
    with pytest.raises(ValueError, match="unknown"):
        remove_duplicates(keyed(spark), "keep_some")


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_duplicate_count_with_and_without_a_broadcast(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        assert duplicate_count(keyed(spark), ["k", "v"]).first()[0] == 3
        assert duplicate_count(keyed(spark)).first()[0] == 0
        zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
        assert duplicate_count(zeros).first()[0] == 2
        hot = spark.range(3_000).selectExpr("if(id % 3 = 0, 'hot', concat('v', id)) as v")
        assert duplicate_count(hot).first()[0] == 999
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def dirty(spark):
    data = [(1, "1.5", "7", " 12 ", "Yes", "2024-01-31"), (2, "x", "8", None, "no", "31.01.2024"),
            (3, "1d", "9", "13", "?", "2024-02-30"), (4, "-2e3", "10", "abc", None, "2024-01-31T10:20:30.5"),
            (5, None, "11", "14", "0", "01/31/2024"), (6, "inf", "12", "15", "TRUE", "")]
    return spark.createDataFrame(data, "id int, f string, g string, i string, b string, d string")


def test_casts(spark, rows):
    fixes = {"f": "float", "i": "int", "b": "bool", "d": "datetime"}
    out = rows(repair_types(dirty(spark), fixes).df)
    assert [None if pd.isna(v) else v for v in out["f"]] == [1.5, None, None, -2000.0, None, float("inf")]
    assert [None if pd.isna(v) else v for v in out["i"]] == [12, None, 13, None, 14, 15]
    assert list(out["b"]) == [True, False, None, None, False, True]
    assert [None if pd.isna(v) else str(v) for v in out["d"]] == [
        "2024-01-31 00:00:00", None, None, "2024-01-31 10:20:30.500000", "2024-01-31 00:00:00", None,
    ]


def test_a_fraction_keeps_an_int_column_as_it_is(spark):
    df = spark.createDataFrame([("1.5",), ("2",)], "v string")
    outcome = repair_types(df, {"v": "int"})
    assert outcome.df.schema["v"].dataType.simpleString() == "string"
    assert [n.status for n in outcome.notes] == ["error"]
    report = type_report(df, outcome, ["v"]).first()
    assert report["error"] and report["to_type"] == "string"


def test_auto(spark):
    outcome = repair_types(dirty(spark), {"g": "auto", "f": "auto"})
    kinds = {f.name: f.dataType.simpleString() for f in outcome.df.schema.fields}
    assert (kinds["g"], kinds["f"]) == ("bigint", "string")


def test_large_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993",)], "v string")
    assert repair_types(df, {"v": "int"}).df.first()[0] == 9007199254740993


def test_unknown_type(spark):
    with pytest.raises(ValueError, match="unknown"):
        repair_types(dirty(spark), {"f": "complex"})
