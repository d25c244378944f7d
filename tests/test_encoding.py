import numpy as np
import pandas as pd
import pytest

from burnish import encode
from burnish.operators.encode import encoding_report, onehot_long
from burnish.operators.values import cell_counts, number_sorted, top_values


def shirts(spark):
    data = [(1, "M", 10.0), (2, "S", 20.0), (3, None, 30.0), (4, "M", 40.0), (5, "XL", None), (6, "S", 60.0)]
    return spark.createDataFrame(data, "id int, size string, price double").repartition(3)


def coded(rows, spark, method, **options):
    return rows(encode(shirts(spark), {"size": method}, **options).df)["size"].astype("float64").tolist()


def test_label_and_ordinal(spark, rows):
    np.testing.assert_equal(coded(rows, spark, "label"), [0, 1, np.nan, 0, 2, 1])
    np.testing.assert_equal(coded(rows, spark, "ordinal:S, M"), [1, 0, np.nan, 1, np.nan, 0])


def test_onehot_like_pandas(spark, rows):
    out = rows(encode(shirts(spark), {"size": "onehot"}).df)
    pandas = shirts(spark).toPandas().sort_values("id", ignore_index=True)
    dummies = pd.get_dummies(pandas["size"], prefix="size", drop_first=True).astype(int)
    pd.testing.assert_frame_equal(out[list(dummies.columns)], dummies, check_dtype=False)
    assert "size" not in out.columns


def test_sparse_is_onehot_in_one_column(spark, rows):
    wide = rows(encode(shirts(spark), {"size": "onehot"}).df)
    outcome = encode(shirts(spark), {"size": "sparse"})
    out = rows(outcome.df)
    assert list(out.columns) == ["id", "price", "size_onehot"]
    assert [v.toArray().tolist() for v in out["size_onehot"]] == wide[["size_S", "size_XL"]].to_numpy().tolist()
    assert all(v.numNonzeros() <= 1 and type(v).__name__ == "SparseVector" for v in out["size_onehot"])
    assert {r["value"]: r["code"] for r in outcome.mappings["size"].collect()} == {"S": 0.0, "XL": 1.0}
    one = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    assert encode(one, {"t": "sparse"}).df.columns == ["id"] and encode(one.limit(0), {"t": "sparse"}).df.columns == ["id"]
    numbers = encode(spark.range(30).selectExpr("id", "id % 12 as n"), {"n": "sparse"}).df
    assert {r["id"] % 12: list(r["n_onehot"].indices) for r in numbers.collect()} == {k: [k - 1] if k else [] for k in range(12)}


def test_a_hundred_thousand_values(spark):
    """Nothing but the number of values reaches the driver; a column each is refused."""
    df = spark.range(120_000).selectExpr("id", "concat('v', lpad(string(id % 100000), 6, '0')) as t")
    with pytest.raises(ValueError, match="too many for a column each"):
        encode(df, {"t": "onehot"})
    out = encode(df, {"t": "sparse"}).df
    picked = {r["id"]: r["t_onehot"] for r in out.where("id in (0, 1, 99999, 100001)").collect()}
    assert all(v.size == 99_999 for v in picked.values())
    assert {k: v.indices.tolist() for k, v in picked.items()} == {0: [], 1: [0], 99_999: [99_998], 100_001: [0]}


def test_frequency_and_target_like_pandas(spark, rows):
    pandas = shirts(spark).toPandas().sort_values("id", ignore_index=True)
    shares = pandas["size"].map(pandas["size"].value_counts(normalize=True)).tolist()
    np.testing.assert_allclose(coded(rows, spark, "frequency"), shares)
    means = pandas["size"].map(pandas.groupby("size")["price"].mean()).tolist()
    np.testing.assert_allclose(coded(rows, spark, "target:price"), means)


@pytest.mark.parametrize("method", ["label", "frequency", "target:v"])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_many_values_and_a_third_of_the_rows_in_one(spark, rows, method, broadcast):
    values = 1_500
    key = f"case when id % 3 = 0 then 'k7' when id % 11 = 0 then null else concat('k', id % {values}) end"
    df = spark.range(4 * values).selectExpr("id", f"{key} as k", "cast(id % 13 as double) as v")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = rows(encode(df, {"k": method}).df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    pandas = df.toPandas()
    expected = {
        "label": lambda: pandas["k"].map({v: i for i, v in enumerate(sorted(pandas["k"].dropna().unique()))}),
        "frequency": lambda: pandas["k"].map(pandas["k"].value_counts(normalize=True)),
        "target:v": lambda: pandas["k"].map(pandas.groupby("k")["v"].mean()),
    }[method]()
    np.testing.assert_allclose(out["k"].astype("float64"), expected.astype("float64"))


def test_source_scans_grow_by_a_constant_per_column(spark, tmp_path):
    spark.range(100).selectExpr(*[f"id % {k + 3} as k{k}" for k in range(4)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scans = [
        encode(df, {f"k{k}": "target:k3" for k in range(n)}).df._jdf.queryExecution().optimizedPlan().toString().count("parquet")
        for n in (1, 2, 3)
    ]
    assert scans[1] - scans[0] <= 2 and scans[2] - scans[1] <= 2 * (scans[1] - scans[0])


def test_report_has_every_value(spark):
    df = spark.range(2_500).selectExpr("id", "concat('v', id) as v", "id % 2 as b")
    found = encoding_report(spark, encode(df, {"v": "label", "b": "binary"}, order_by="id")).toPandas()
    assert found.groupby("column").size().to_dict() == {"b": 2, "v": 2_500}
    assert sorted(found[found["column"] == "v"].code) == list(range(2_500))


def test_labels_of_numbers_follow_their_text(spark, rows):
    df = spark.createDataFrame([(1, 1e20), (2, 2.0), (3, 10.0), (4, None), (5, 2.0)], "id int, v double")
    out = rows(encode(df, {"v": "label"}).df)["v"]
    np.testing.assert_equal(out.astype("float64").tolist(), [0, 2, 1, np.nan, 2])


def test_numbering_uses_one_range_shuffle(spark):
    df = spark.range(3_000).selectExpr("concat('v', id * 7919 % 3001) as v").distinct()
    numbered = number_sorted(df, "v", "code").toPandas().sort_values("v")
    assert numbered["code"].tolist() == list(range(3_000))


def test_onehot_of_many_values_wide_and_long(spark, rows):
    df = spark.range(1_200).selectExpr("id", "concat('v', lpad(id, 4, '0')) as v")
    wide = encode(df, {"v": "onehot"}).df
    assert len(wide.columns) == 1_200
    long = rows(onehot_long(df, "v", ["id"]))
    assert long["column"].tolist() == [f"v_v{k:04}" for k in range(1, 1_200)]


def test_binary_by_order(spark, rows):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, None), (4, "a")], "id int, v string")
    assert rows(encode(df, {"v": "binary"}, order_by="id").df)["v"].tolist() == [0, 0, 1, 1]
    outcome = encode(shirts(spark), {"size": "binary"}, order_by="id")
    assert [(n.status, n.detail) for n in outcome.notes] == [("skipped", "not binary: more than 2 values")]
    with pytest.raises(ValueError, match="order_by"):
        encode(df, {"v": "binary"})


def test_skipped_and_unknown(spark):
    outcome = encode(shirts(spark), {"colour": "label", "size": "target:weight"})
    assert [n.status for n in outcome.notes] == ["skipped", "skipped"]
    with pytest.raises(ValueError, match="unknown"):
        encode(shirts(spark), {"size": "hash"})


def test_small_lookup_does_not_shuffle_the_rows(spark, plan_of):
    text = plan_of(encode(spark.range(100).selectExpr("id", "id % 5 as v"), {"v": "frequency"}).df)
    assert "BroadcastHashJoin" in text
    assert "PythonUDF" not in text


@pytest.mark.parametrize("data", [[], [(1, None), (2, None)]])
@pytest.mark.parametrize("method", ["label", "onehot", "frequency", "target:id"])
def test_nothing_to_encode(spark, data, method):
    df = spark.createDataFrame(data, "id int, v string")
    out = encode(df, {"v": method}).df
    assert out.count() == len(data)


def test_counts_of_mixed_types(spark):
    df = spark.createDataFrame([(1, "x", 0.0), (1, "y", -0.0), (2, None, None)], "a int, b string, c double")
    found = {(r["column"], r["value"], r["n"]) for r in cell_counts(df, df.columns).collect()}
    assert found == {("a", "1", 2), ("a", "2", 1), ("b", "x", 1), ("b", "y", 1), ("c", "0.0", 2)}


def test_top_values_are_cut_per_task(spark, plan_of):
    df = spark.range(1_000).selectExpr("cast(id as string) as v")
    text = plan_of(top_values(cell_counts(df, ["v"]), 10))
    assert "WindowGroupLimit" in text and "Partial" in text
