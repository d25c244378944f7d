import pandas as pd
import pytest

from burnish import fill_missing, missing_report


def parcels(spark):
    data = [(1, 20.0, "quay", 5), (2, None, "mill", None), (3, 40.0, None, 7), (4, 90.0, "mill", 8), (5, None, "quay", 9)]
    return spark.createDataFrame(data, "id long, load double, depot string, n long")


def test_statistics(spark, rows):
    out = rows(fill_missing(parcels(spark), {"load": "fill_median", "depot": "fill_mode", "n": "fill_mean"}).df)
    pandas = parcels(spark).toPandas()
    assert out["load"].tolist() == pandas["load"].fillna(pandas["load"].median()).tolist()
    assert out["depot"].tolist() == ["quay", "mill", "mill", "mill", "quay"]
    assert out["n"].tolist() == pandas["n"].fillna(pandas["n"].mean()).tolist()


def test_mode_takes_the_smallest_on_ties(spark, rows):
    df = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 2), (5, None)], "id int, v int")
    assert rows(fill_missing(df, {"v": "fill_mode"}).df)["v"].tolist() == [2, 1, 1, 2, 1]


def test_rows_dropped_first_change_later_fits(spark, rows):
    out = rows(fill_missing(parcels(spark), {"depot": "drop_rows", "load": "fill_mean"}).df)
    assert out["id"].tolist() == [1, 2, 4, 5]
    assert out["load"].tolist() == [20.0, 55.0, 90.0, 55.0]
    out = rows(fill_missing(parcels(spark), {"load": "fill_mean", "depot": "drop_rows"}).df)
    assert out["load"].tolist() == [20.0, 50.0, 90.0, 50.0]


def test_literals_keep_the_type(spark):
    out = fill_missing(parcels(spark), {"load": "fill_zero", "depot": "fill_zero", "n": "fill_custom:3"}).df
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "double", "string", "bigint"]
    assert out.where("load = 0").count() == 2
    assert out.where("depot = '0'").count() == 1
    assert out.where("n = 3").count() == 1
    assert fill_missing(parcels(spark), {"n": "fill_custom:2.5"}).df.where("n = 2.5").count() == 1


@pytest.mark.parametrize("strategy", ["fill_mean", "fill_median", "fill_mode"])
def test_nothing_to_learn_from(spark, strategy):
    empty = spark.createDataFrame([], "id long, v double")
    assert fill_missing(empty, {"v": strategy}).df.count() == 0
    hollow = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert fill_missing(hollow, {"v": strategy}).df.where("v is null").count() == 2


def test_unknown_names(spark):
    outcome = fill_missing(parcels(spark), {"height": "fill_mean", "load": "keep"})
    assert [(n.column, n.status) for n in outcome.notes] == [("height", "skipped")]
    assert outcome.notes_frame().count() == 1
    with pytest.raises(ValueError, match="unknown"):
        fill_missing(parcels(spark), {"load": "fill_guess"})
    with pytest.raises(ValueError, match="order_by"):
        fill_missing(parcels(spark), {"load": "fill_ffill"})


def test_ordered_fills_between_other_strategies(spark, rows):
    strategies = {"load": "fill_ffill", "depot": "drop_rows", "n": "fill_interpolate"}
    out = rows(fill_missing(parcels(spark), strategies, order_by="id", ranges=2).df)
    pandas = parcels(spark).toPandas()
    pandas["load"] = pandas["load"].ffill()
    pandas = pandas.dropna(subset=["depot"])
    pandas["n"] = pandas["n"].interpolate()
    pd.testing.assert_frame_equal(out, pandas.reset_index(drop=True), check_dtype=False)


def test_report(spark):
    after = fill_missing(parcels(spark), {"load": "fill_mean", "depot": "drop_rows"}).df
    report = {r["column"]: (r["before"], r["after"]) for r in missing_report(parcels(spark), after).collect()}
    assert report == {"load": (2, 0), "depot": (1, 0), "n": (1, 1), "(rows)": (5, 4)}


def test_fits_share_one_pass(spark, monkeypatch):
    from burnish.operators import steps

    calls = []
    plain = steps.one_row
    monkeypatch.setattr(steps, "one_row", lambda df, aggs: calls.append(len(aggs)) or plain(df, aggs))
    fill_missing(parcels(spark), {"load": "fill_mean", "n": "fill_mean"})
    assert calls == [2]
