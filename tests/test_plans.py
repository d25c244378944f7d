import pytest

from burnish import Plan, prepare
from burnish.operators import steps
from burnish.plans.prepare import custom_batches, custom_step


def parcels(spark):
    data = [(1, 20.0, "quay", "x 1", 1), (2, None, "mill", "y", 0), (3, 40.0, None, "z z", 1), (4, 900.0, "mill", None, 0), (4, 900.0, "mill", None, 0)]
    return spark.createDataFrame(data, "id int, load double, depot string, note string, target int").repartition(3)


CONFIG = {
    "target": "target",
    "duplicates": "drop_keep_first",
    "duplicate_key": "id",
    "missing": {"load": "fill_median", "depot": "fill_mode", "note": "fill_custom:none"},
    "text": {"note": "length_feature"},
    "outliers": {"load": "winsorize:0,90"},
    "encode": {"depot": "onehot_encode"},
    "features": {"load_twice": "formula:load * 2"},
    "scale": {"load": "minmax", "load_twice": "standard"},
    "checks": {"no_nulls": True, "target_column": "target"},
    "order_by": "id",
}


def test_words_are_translated():
    plan = Plan.from_dict(
        {**CONFIG, "encode": {"a": "ordinal_encode:x,y", "b": "drop"}, "dates": {"d": "year, time_since"}, "scale": {"c": "log_transform"}}
    )
    assert plan.encode == {"a": "ordinal:x,y"} and plan.drop == ["b"]
    assert plan.dates == {"d": "year,days_since_earliest"}
    assert plan.scale == {"c": "log"} and plan.duplicates == "keep_first"
    assert plan.features["note_length"] == "str_len:note"


@pytest.mark.parametrize(
    "config", [{"scale": {"target": "minmax"}}, {"encode": {"target": "onehot_encode"}}, {"order": ["bake"]}, {"colour": 1}]
)
def test_bad_plans_raise_before_any_job(config):
    with pytest.raises(ValueError):
        Plan.from_dict({**CONFIG, **config})


@pytest.mark.parametrize("metrics", [False, True])
@pytest.mark.parametrize("materialize", [False, True])
def test_end_to_end(spark, rows, metrics, materialize):
    done = prepare(parcels(spark), Plan.from_dict(CONFIG), metrics, materialize)
    out = rows(done.df)
    assert sorted(out.columns) == ["depot_quay", "id", "load", "load_twice", "note", "note_length", "target"]
    assert out["depot_quay"].tolist() == [1, 0, 0, 0]
    assert out["load"].tolist() == pytest.approx([0, 20 / 622, 20 / 622, 1])
    assert out["note_length"].tolist() == [3, 1, 3, 4]
    assert all(c.passed for c in done.checks)
    if metrics:
        lines = {r["step"]: r for r in done.metrics.collect()}
        assert (lines["duplicates"]["rows_before"], lines["duplicates"]["rows_after"]) == (5, 4)
        assert lines["encode"]["columns_after"] == 5


def test_independent_fits_share_a_round(spark, monkeypatch):
    rounds = []
    plain = steps.fit
    monkeypatch.setattr(steps, "fit", lambda df, needs: rounds.append(len(needs)) or plain(df, needs))
    plan = Plan.from_dict(
        {"missing": {"load": "fill_mean", "depot": "fill_mode"}, "encode": {"note": "label_encode"}, "outliers": {"target": "clip_iqr"}}
    )
    prepare(parcels(spark), plan)
    assert rounds == [4]
    rounds.clear()
    prepare(parcels(spark), Plan.from_dict({"missing": {"load": "fill_mean"}, "outliers": {"load": "clip_zscore"}}))
    assert rounds == [1, 1]


def test_same_result_for_any_partitioning_and_input_order(spark, rows):
    first = rows(prepare(parcels(spark).coalesce(1), Plan.from_dict(CONFIG)).df)
    second = rows(prepare(parcels(spark).orderBy("load").repartition(7), Plan.from_dict(CONFIG)).df)
    assert first.equals(second[first.columns])


def test_custom_steps(spark, rows):
    assert custom_step(parcels(spark), lambda df: df.where("id > 2")).count() == 3

    def double(batch):
        return batch.assign(load=batch["load"] * 2)[["id", "load"]]

    out = rows(custom_batches(parcels(spark).select("id", "load"), double, "id int, load double"))
    assert out["load"].tolist()[:1] == [40.0]


def test_plans_of_texts():
    texts = {
        "plan_summary": "a, b: c", "target_column": "none", "columns_to_drop": "id:a key, no feature,note:free text",
        "missing_value_strategy": "load:fill_median,depot:fill_custom:x, y,lane:drop", "encoding_strategy": "size:ordinal_encode:S,M,L,depot:onehot_encode",
        "scaling_strategy": "all:minmax", "outlier_strategy": "load:winsorize:5,95,toll:keep", "feature_engineering": "rate:ratio:load,toll,sum:formula:load + toll",
        "text_processing": "memo:tfidf,label:word_count", "datetime_processing": "day:year,time_since", "duplicate_strategy": "drop_keep_last",
        "final_validation_checks": "no_nulls,min_rows:10,max_null_pct:2.5,target_column:load", "step_by_step_order": "drop_columns,handle_missing,encode,validate",
    }
    plan = Plan.from_dict(texts)
    assert plan.target is None and plan.drop == ["id", "note", "lane"]
    assert plan.reasons == {"id": "a key, no feature", "note": "free text"}
    assert plan.missing == {"load": "fill_median", "depot": "fill_custom:x, y"}
    assert plan.encode == {"size": "ordinal:S,M,L", "depot": "onehot"} and plan.scale == {"__all_numeric__": "minmax"}
    assert plan.outliers == {"load": "winsorize:5,95"} and plan.duplicates == "keep_last"
    assert plan.features == {"label_word_count": "word_count:label", "rate": "ratio:load,toll", "sum": "formula:load + toll"}
    assert plan.text == {"memo": "tfidf:50"} and plan.dates == {"day": "year,days_since_earliest"}
    assert plan.checks == {"no_nulls": True, "min_rows": 10, "max_null_pct": 2.5, "target_column": "load"}
    assert plan.order == ["drop", "missing", "encode", "validate"]
    empty = Plan.from_dict({"columns_to_drop": "none", "scaling_strategy": "", "duplicate_strategy": "keep", "step_by_step_order": ""})
    assert empty.drop == [] and empty.scale == {} and empty.order == Plan().order
    assert Plan.from_dict({"columns_to_drop": "a, b"}).drop == ["a", "b"]
    for wrong in ({"step_by_step_order": "drop,bake"}, {"drop": ["a"], "columns_to_drop": "b"}, {"colour": "x:y"}):
        with pytest.raises(ValueError):
            Plan.from_dict(wrong)


def test_reasons_are_noted(spark):
    done = prepare(parcels(spark), Plan.from_dict({"drop": "note:free text,gone", "order": "drop"}))
    assert [(n.column, n.status, n.detail) for n in done.notes] == [("note", "done", "free text,gone")]
    done = prepare(parcels(spark), Plan.from_dict({"drop": "gone,note:free text", "order": "drop"}))
    assert [(n.column, n.status, n.detail) for n in done.notes] == [("gone", "skipped", "column not found"), ("note", "done", "free text")]


def test_metrics_count_within_other_jobs(spark, monkeypatch):
    """No job is run for a count: rows are observed where fits and the last write pass over them."""
    counts = []
    monkeypatch.setattr(type(spark.range(1)), "count", lambda self: counts.append(self) or 0)
    config = {"missing": "load:drop_rows,depot:drop_rows", "outliers": {"load": "remove_iqr"}, "duplicates": "drop_keep_first", "order_by": "id"}
    done = prepare(parcels(spark), Plan.from_dict({**config, "duplicate_key": "id"}), metrics=True)
    lines = {r["step"]: (r["rows_before"], r["rows_after"]) for r in done.metrics.collect()}
    assert not counts and lines["duplicates"] == (5, 4) and lines["missing"] == (4, 2) and lines["outliers"][0] == 2
    assert len(done.df.collect()) == lines["validate"][1]
