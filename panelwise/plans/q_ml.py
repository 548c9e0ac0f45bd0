"""Queries for the model operators.

The split (M2), the training frame (C11/C14), the scenario validation (M7/M8)
and the form defaults (M9) are SQL-checkable; anything that depends on a
fitted forest is checked by rows only (and by property tests).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelwise.operators import aggregate as agg
from panelwise.operators import ml
from panelwise.plans.oracle_base import with_prepared
from panelwise.plans.registry import prepared, prepared_table, register

_FEATS = ml.FEATURES["deaths"]
_IS_TEST = "(('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':42'), 1, 8))::UBIGINT % 100 < 20)"


@register("train_split", with_prepared(f"""
SELECT row_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _FEATS)},
  CAST(New_deaths AS DOUBLE) AS target, ln(1 + New_deaths) AS label, {_IS_TEST} AS is_test
FROM prepared
WHERE New_deaths >= 0 AND {' AND '.join(f'{c} IS NOT NULL' for c in _FEATS)}"""),
          tuple(_FEATS) + ("target", "label"), ("M1", "M2", "C11", "C14"))
def q_train_split(spark, sf_dir):
    """M2: the deaths model's training frame with the hash-based test flag."""
    return ml.training_frame(prepared(spark, sf_dir), "deaths")


# Some features and targets are made missing or infinite, so that C14's rules have rows to act on.
_GAPS = {"ratio": "CASE WHEN row_id % 13 = 0 THEN NULL ELSE ratio END", "New_deaths": "CASE WHEN row_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN row_id % 19 = 0 THEN -1.0 ELSE New_deaths END",
         "vaccination_coverage": "CASE WHEN row_id % 23 = 0 THEN CAST('NaN' AS DOUBLE) ELSE vaccination_coverage END"}
_GAPS_SQL = f"""
, gaps AS (SELECT * REPLACE ({', '.join(f'CAST({v} AS DOUBLE) AS {c}' for c, v in _GAPS.items())}) FROM prepared)
, cand AS (SELECT * FROM gaps WHERE New_deaths >= 0 AND New_deaths < CAST('Infinity' AS DOUBLE))
, ok AS (SELECT *, {' AND '.join(f'({c} IS NOT NULL AND NOT isnan({c}::DOUBLE))' for c in _FEATS)} AS complete FROM cand)
, log AS (SELECT row_id, CAST(New_deaths AS DOUBLE) AS target, ln(1 + New_deaths) * 0.9::DOUBLE + (row_id % 7) * 0.05::DOUBLE - 0.2::DOUBLE AS p
          FROM ok WHERE complete AND {_IS_TEST})
, pred AS (SELECT row_id, target, greatest(CAST(0 AS DOUBLE), exp(p) - 1) AS prediction FROM log)"""


def _with_gaps(spark, sf_dir):
    return prepared(spark, sf_dir).withColumns({c: F.expr(v).cast("double") for c, v in _GAPS.items()})


def _deterministic_predictions(spark, sf_dir):
    """The held-out rows with a stand-in for a forest's output on the log scale."""
    test = ml.training_frame(_with_gaps(spark, sf_dir), "deaths").where("is_test")
    return ml.restored(test.withColumn("prediction_log", F.col("label") * 0.9 + F.col("row_id") % 7 * 0.05 - 0.2))


@register("dropped_rows", with_prepared(_GAPS_SQL + """
SELECT 'deaths' AS model, count(*) FILTER (WHERE NOT complete) AS dropped_rows, count(*) AS candidate_rows FROM ok"""), (), ("C14", "C11"))
def q_dropped_rows(spark, sf_dir):
    """C14's tally on rows with missing features, NaN features, infinite and negative targets."""
    return ml.dropped_rows(_with_gaps(spark, sf_dir), "deaths").select(F.lit("deaths").alias("model"), "*")


@register("restored_predictions", with_prepared(_GAPS_SQL + """
SELECT row_id, target, prediction, CAST(round_even(prediction, 0) AS BIGINT) AS predicted_count FROM pred"""), ("target", "prediction"), ("C12", "C13", "C7", "C14"))
def q_restored_predictions(spark, sf_dir):
    """C12 + C13: predictions of the log scale restored, clamped and counted."""
    return _deterministic_predictions(spark, sf_dir).select("row_id", "target", "prediction", "predicted_count")


@register("regression_metrics", with_prepared(_GAPS_SQL + """
SELECT count(*) AS n, avg((target - prediction) * (target - prediction)) AS mse, sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
  1 - sum((target - prediction) * (target - prediction)) / nullif(var_pop(target) * count(target), 0) AS r2 FROM pred"""), ("mse", "rmse", "r2"), ("A23",))
def q_regression_metrics(spark, sf_dir):
    """A23 on those predictions."""
    return ml.regression_metrics(_deterministic_predictions(spark, sf_dir))


PARAMS = ml.ForestParams()


@register("model_training", None, (), ("M3", "M4", "A23", "C12", "C7"))
def q_model_training(spark, sf_dir):
    """M4: both forests (100 trees), trained and kept where they aren't yet, and their held-out MSE/RMSE/R^2."""
    table = prepared_table(spark, sf_dir)
    outs = [ml.training_report(table.read(), name, model) for name, model in ml.kept_models(table, PARAMS).items()]
    return outs[0].unionByName(outs[1])


@register("feature_importance", None, (), ("K5",))
def q_feature_importance(spark, sf_dir):
    """K5: feature importances of both kept forests."""
    return ml.feature_importances(spark, ml.kept_models(prepared_table(spark, sf_dir), PARAMS))


@register("model_reevaluation", None, (), ("S4", "S5", "M6", "A23"))
def q_model_reevaluation(spark, sf_dir):
    """S4 -> S5 -> M6: both kept forests loaded and evaluated on the held-out rows of the full table."""
    table = prepared_table(spark, sf_dir)
    outs = []
    for name, model in ml.kept_models(table, PARAMS).items():
        found = ml.evaluate(model, table.read(), name)
        outs.append(found.withColumn("model", F.lit(name)).withColumn("features", F.lit(",".join(model.stages[0].getInputCols()))))
    return outs[0].unionByName(outs[1])


def _latest_scenarios(panel):
    """What-if inputs derived from the data: every entity's latest population,
    fully vaccinated and total vaccinations (A3)."""
    latest = agg.latest_stats(panel)
    return latest.select(
        F.col("country").alias("scenario_id"),
        F.col("Latest_Population").alias("population"),
        F.col("Latest_People_Fully_Vaccinated").alias("people_fully_vaccinated"),
        F.col("Latest_Total_Vaccinations").alias("total_vaccinations"),
    )


def _scenario_frame(panel, model="deaths"):
    frame = ml.scenario_frame(_latest_scenarios(panel), panel, panel, model)
    frame = ml.validate_scenarios(frame, model)
    return frame.withColumnRenamed("_default_days", "default_days").withColumnRenamed(
        "_default_population", "default_population")


def _last(col):
    return f"arg_max({col}, struct_pack(d := date, r := row_id)) FILTER (WHERE {col} IS NOT NULL)"


_MED = ", ".join(f"CAST(coalesce(median({c}), {float(v)!r}) AS DOUBLE) AS {c}"
                 for c, v in agg.SCENARIO_FALLBACKS.items() if c != "days_since_start")

_SCENARIO_SQL = f"""
, dflt AS (SELECT {_MED},
    CAST(coalesce(CAST(max(date) - (SELECT min(date) FROM prepared) AS DOUBLE), 365.0) AS DOUBLE) AS days_since_start
  FROM prepared)
, sc AS (SELECT country AS scenario_id, {_last('population')} AS population,
           {_last('people_fully_vaccinated')} AS people_fully_vaccinated,
           {_last('total_vaccinations')} AS total_vaccinations
         FROM prepared WHERE country IS NOT NULL GROUP BY country)
, f AS (SELECT sc.scenario_id,
    coalesce(CAST(sc.population AS DOUBLE), trunc(dflt.population)) AS population,
    coalesce(CAST(sc.people_fully_vaccinated AS DOUBLE), trunc(dflt.people_fully_vaccinated)) AS people_fully_vaccinated,
    coalesce(CAST(sc.total_vaccinations AS DOUBLE), trunc(dflt.total_vaccinations)) AS total_vaccinations,
    dflt.people_vaccinated, dflt.ratio, trunc(dflt.New_deaths) AS New_deaths, trunc(dflt.days_since_start) AS days_since_start,
    dflt.days_since_start AS default_days, dflt.population AS default_population
  FROM sc, dflt)
, g AS (SELECT *, CASE WHEN population > 0 THEN people_fully_vaccinated / population ELSE 0.0 END
                 AS vaccination_coverage FROM f)
, v AS (SELECT *, CASE
    WHEN coalesce(NOT (population BETWEEN 1000000 AND 2000000000), TRUE) THEN 'population out of [1e6, 2e9]'
    {{total}}
    WHEN coalesce(NOT (people_fully_vaccinated BETWEEN 0 AND trunc(population)), TRUE)
      THEN 'people_fully_vaccinated out of [0, population]'
    WHEN coalesce(NOT (days_since_start BETWEEN 0 AND trunc(default_days + 365)), TRUE)
      THEN 'days_since_start out of [0, default + 365]'
    WHEN coalesce(vaccination_coverage > 1, TRUE) THEN 'vaccination_coverage above 1'
    {{deaths}}
    END AS reason FROM g)
SELECT scenario_id, population, people_fully_vaccinated, total_vaccinations, people_vaccinated, {{own}},
  days_since_start, vaccination_coverage, default_days, default_population, reason, reason IS NULL AS valid
FROM v"""
_TOTAL_BOUND = """WHEN coalesce(NOT (total_vaccinations BETWEEN 0 AND trunc(default_population * 2)), TRUE)
      THEN 'total_vaccinations out of [0, 2 x default population]'"""
_DEATHS_BOUND = "WHEN coalesce(NOT (New_deaths BETWEEN 0 AND 5000), TRUE) THEN 'New_deaths out of [0, 5000]'"
_SCENARIO_DOUBLES = ("population", "people_fully_vaccinated", "total_vaccinations", "people_vaccinated",
                     "days_since_start", "vaccination_coverage", "default_days", "default_population")


@register("scenario_validation", with_prepared(_SCENARIO_SQL.format(total=_TOTAL_BOUND, deaths="", own="ratio")),
          _SCENARIO_DOUBLES + ("ratio",), ("M7", "M8", "A14"))
def q_scenario_validation(spark, sf_dir):
    """M7 + M8: data-derived what-if scenarios completed with medians and checked
    against the input bounds."""
    return _scenario_frame(prepared(spark, sf_dir))


@register("scenario_validation_vaccinations", with_prepared(_SCENARIO_SQL.format(total="", deaths=_DEATHS_BOUND, own="New_deaths")),
          _SCENARIO_DOUBLES + ("New_deaths",), ("M7", "M8", "A14"))
def q_scenario_validation_vaccinations(spark, sf_dir):
    """M7 + M8 for the vaccinations model, whose bounds are others."""
    return _scenario_frame(prepared(spark, sf_dir), "vaccinations")


@register("scenario_scores", None, (), ("M5", "M7", "M8", "C12", "C13"))
def q_scenario_scores(spark, sf_dir):
    """M5 + M7: the valid scenarios scored with both kept forests."""
    table = prepared_table(spark, sf_dir)
    found = None
    for name, model in ml.kept_models(table, PARAMS).items():
        scored = ml.score_scenarios(model, _scenario_frame(table.read(), name), name)
        scored = scored.select(F.lit(name).alias("model"), "scenario_id", "population", "valid", "reason", "prediction", "predicted_count")
        found = scored if found is None else found.unionByName(scored)
    return found


_MEANS = ", ".join(f"CAST(CASE WHEN sum({c}) > 0 THEN avg({c}) ELSE {float(v)!r} END AS DOUBLE) AS {c}"
                   for c, v in agg.FORM_FALLBACKS.items())


@register("prediction_defaults", with_prepared(f"""
SELECT {_MEANS},
  CAST((SELECT max(date) FROM prepared) + 7 AS DATE) AS prediction_date,
  CAST((SELECT max(date) FROM prepared) + 7 - (SELECT min(date) FROM prepared) AS INTEGER) AS days_since_start
FROM prepared"""), tuple(agg.FORM_FALLBACKS), ("M9", "A13", "C10"))
def q_prediction_defaults(spark, sf_dir):
    """M9: single-prediction form defaults (means, date = last + 7 days)."""
    p = prepared(spark, sf_dir)
    return ml.prediction_defaults(p, p)


@register("prediction_form", None, (), ("M9", "M5", "C12", "C13"))
def q_prediction_form(spark, sf_dir):
    """M9 scored: the form's defaults predicted by both kept forests."""
    table = prepared_table(spark, sf_dir)
    p = table.read()
    return ml.score_form(ml.kept_models(table, PARAMS), ml.prediction_defaults(p, p))
