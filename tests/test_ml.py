"""Model operators: deterministic split, learnability, save/load, scenarios."""

import pytest
from pyspark.sql import functions as F

from panelwise.operators import ml
from panelwise.operators.prepare import prepare_panel
from panelwise.sources import panel_view

from conftest import SF001

SMALL = ml.ForestParams(num_trees=10, max_depth=5, max_bins=32)


@pytest.fixture(scope="module")
def panel(spark):
    return prepare_panel(panel_view(spark, SF001)).cache()


def test_split_is_deterministic_and_about_20_percent(panel):
    a = ml.training_frame(panel, "deaths").select("row_id", "is_test")
    b = ml.training_frame(panel.repartition(7), "deaths").select("row_id", "is_test")
    assert sorted(a.collect()) == sorted(b.collect())
    share = a.agg(F.avg(F.col("is_test").cast("double"))).first()[0]
    assert 0.12 < share < 0.28


def test_training_frame_filters(spark):
    df = spark.createDataFrame(
        [(1, -1.0, 1.0), (2, 0.0, None), (3, 4.0, 2.0)], "row_id bigint, New_deaths double, total_vaccinations double")
    for c in ml.FEATURES["deaths"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1.0))
    tf = ml.training_frame(df, "deaths").collect()
    assert [r["row_id"] for r in tf] == [3]  # negative target and NULL feature dropped
    assert ml.dropped_rows(df, "deaths").first()["dropped_rows"] == 1


def test_forest_learns_a_learnable_target(spark):
    rows = [(i, float(i % 50), float((i * 7) % 13)) for i in range(1, 2001)]
    df = spark.createDataFrame(rows, "row_id bigint, people_vaccinated double, ratio double")
    df = df.withColumn("New_deaths", F.expm1(F.col("people_vaccinated") / 10.0))
    for c in ml.FEATURES["deaths"]:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(1.0))
    model, metrics = ml.train_and_evaluate(df, "deaths", ml.ForestParams(num_trees=20, max_depth=8, max_bins=64))
    m = metrics.first()
    assert m["r2"] > 0.9 and m["n_test"] > 0 and m["n_train"] > m["n_test"]


def test_save_load_gives_same_predictions(spark, panel, tmp_path):
    model = ml.fit_model(panel, "deaths", SMALL)
    ml.save_models({"deaths": model}, str(tmp_path))
    models, feats = ml.load_models(str(tmp_path))
    assert models["vaccinations"] is None and feats["deaths"] == ml.FEATURES["deaths"]
    frame = ml.training_frame(panel, "deaths")
    a = ml.predict(model, frame).select("row_id", "prediction").collect()
    b = ml.predict(models["deaths"], frame).select("row_id", "prediction").collect()
    assert sorted(a) == sorted(b)
    with pytest.raises(FileNotFoundError):
        ml.load_models(str(tmp_path / "nothing"))


def test_predictions_are_non_negative_integers(panel):
    model = ml.fit_model(panel, "vaccinations", SMALL)
    p = ml.predict(model, ml.training_frame(panel, "vaccinations"))
    assert p.where((F.col("prediction") < 0) | (F.col("predicted_count") < 0)).count() == 0


def test_reevaluation_equals_training_metrics(panel):
    model, metrics = ml.train_and_evaluate(panel, "deaths", SMALL)
    again = ml.evaluate(model, panel, "deaths").first()
    assert again["rmse"] == pytest.approx(metrics.first()["rmse"])


def test_feature_importances(spark, panel):
    model = ml.fit_model(panel, "deaths", SMALL)
    imp = ml.feature_importances(spark, {"deaths": model}).orderBy("position").collect()
    assert [r["position"] for r in imp] == list(range(1, 8)) and {r["model"] for r in imp} == {"deaths"}
    assert [r["feature"] for r in imp] != [] and sum(r["importance"] for r in imp) == pytest.approx(1.0)
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)


def test_scenarios_validate_and_score(spark, panel):
    sc = spark.createDataFrame(
        [("ok", 5.0e7, 1.0e6), ("tiny", 10.0, 1.0), ("over", 5.0e7, 9.0e7)],
        "scenario_id string, population double, people_fully_vaccinated double")
    frame = ml.validate_scenarios(ml.scenario_frame(sc, panel, panel, "deaths"), "deaths")
    got = {r["scenario_id"]: r for r in frame.collect()}
    assert got["ok"]["valid"] and got["ok"]["vaccination_coverage"] == pytest.approx(0.02)
    assert got["tiny"]["reason"].startswith("population")
    assert got["over"]["reason"].startswith("people_fully_vaccinated")
    model = ml.fit_model(panel, "deaths", SMALL)
    scored = {r["scenario_id"]: r for r in ml.score_scenarios(model, frame, "deaths").collect()}
    assert scored["ok"]["predicted_count"] >= 0 and scored["tiny"]["prediction"] is None


def test_prediction_defaults(panel):
    d = ml.prediction_defaults(panel, panel).first()
    bounds = panel.agg(F.min("date"), F.max("date")).first()
    assert d["days_since_start"] == (bounds[1] - bounds[0]).days + 7
