"""The kept prepared table and the models kept beside it."""

import shutil

import pytest
from pyspark.sql import functions as F

from panelwise.operators import ml
from panelwise.operators.prepare import prepare_panel
from panelwise.plans.catalog import REGISTRY
from panelwise.plans.registry import prepared_table
from panelwise.sources import drop_prepared, keep_prepared, panel_view

from conftest import SF001


@pytest.fixture()
def folder(spark, tmp_path):
    """The driver's tables as folders, so that files can be added."""
    for name in ("orders", "customer", "nation"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_found_again_until_a_file_is_added(spark, folder):
    first = prepared_table(spark, folder)
    again = prepared_table(spark, folder)
    assert again.path == first.path and _rows(again.read()) == _rows(prepare_panel(panel_view(spark, folder)))
    before = _rows(REGISTRY["entity_comparison"].build(spark, folder))
    spark.read.parquet(f"{folder}/orders.parquet").limit(200).withColumn("o_orderkey", F.col("o_orderkey") + 10 ** 9).write.mode("append").parquet(f"{folder}/orders.parquet")
    after = prepared_table(spark, folder)
    assert after.path != first.path
    assert _rows(after.read()) == _rows(prepare_panel(panel_view(spark, folder)))
    assert _rows(REGISTRY["entity_comparison"].build(spark, folder)) != before
    drop_prepared(first)
    assert _rows(after.read())


def test_dates_prune_years(spark, folder):
    table = prepared_table(spark, folder)
    kept = table.read(["NATION_0", "NATION_10"], "1996-03-01", "1997-10-31")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan
    whole = table.read().where("country IN ('NATION_0', 'NATION_10') AND date BETWEEN DATE'1996-03-01' AND DATE'1997-10-31'")
    assert _rows(kept) == _rows(whole) and kept.count() > 0
    assert "year" not in kept.columns


def test_a_table_that_was_not_finished_is_not_read(spark, folder):
    calls = []

    def derive():
        calls.append(1)
        return prepare_panel(panel_view(spark, folder))

    inputs = [f"{folder}/{n}.parquet" for n in ("orders", "customer", "nation")]
    table = keep_prepared(spark, inputs, derive)
    shutil.rmtree(table.path.removeprefix("file:"))
    with pytest.raises(RuntimeError):
        keep_prepared(spark, inputs, lambda: (_ for _ in ()).throw(RuntimeError("dies while deriving")))
    assert keep_prepared(spark, inputs, derive).path == table.path and len(calls) == 2
    keep_prepared(spark, inputs, derive)
    assert len(calls) == 2


def test_models_are_fitted_once(spark, folder, monkeypatch):
    table, params, fits = prepared_table(spark, folder), ml.ForestParams(num_trees=2, max_depth=3), []
    fit = ml.fit_model
    monkeypatch.setattr(ml, "fit_model", lambda *a, **k: fits.append(a[1]) or fit(*a, **k))
    one = ml.kept_models(table, params)
    two = ml.kept_models(table, params)
    assert sorted(fits) == ["deaths", "vaccinations"]
    for name in one:
        assert one[name].stages[-1].featureImportances == two[name].stages[-1].featureImportances
    form = ml.score_form(two, ml.prediction_defaults(table.read(), table.read())).collect()
    assert {r["model"] for r in form} == set(two) and all(r["predicted_count"] >= 0 and r["shown"].replace(",", "") == str(r["predicted_count"]) for r in form)
