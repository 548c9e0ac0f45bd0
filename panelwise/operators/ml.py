"""Random-forest training, evaluation, scoring and
what-if scenarios with Spark ML.

The target is modelled on the log1p scale and predictions are mapped back
with expm1, clamped at zero and rounded half-to-even, as in the reference.
The train/test split is a hash of the row id (deterministic, independent of
partitioning, reproducible in SQL) instead of a seeded shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwise.functions.columns import clamp_zero, half_even_int, nan_to_null, safe_div
from panelwise.operators.aggregate import mean_defaults, median_defaults
from panelwise.sources.panel_io import PanelSourceError, require_path
from panelwise.sources.prepared import PreparedTable, move_path, path_exists
from panelwise.spec import DEFAULT_SPEC, PanelSpec

# The two models' targets and feature lists, in model order.
TARGETS = {"deaths": "New_deaths", "vaccinations": "daily_vaccinations"}
FEATURES = {
    "deaths": [
        "total_vaccinations", "people_vaccinated", "people_fully_vaccinated",
        "population", "ratio", "vaccination_coverage", "days_since_start",
    ],
    "vaccinations": [
        "people_vaccinated", "people_fully_vaccinated", "population",
        "vaccination_coverage", "days_since_start", "New_deaths",
    ],
}
SPLIT_SEED = 42
TEST_PERCENT = 20


# ---------------------------------------------------------------------- M2
def test_flag(row_id: str = "row_id", seed: int = SPLIT_SEED, test_percent: int = TEST_PERCENT) -> Column:
    """M2: row goes to the test set when md5(row_id:seed) mod 100 < test_percent."""
    h = F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}")))
    bucket = F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return bucket < F.lit(test_percent)


# ---------------------------------------------------------------------- C11/C14
def _candidates(df: DataFrame, model: str) -> DataFrame:
    """C11: rows whose target is known, at least 0 and finite (log1p of it is a label)."""
    target = F.col(TARGETS[model]).cast("double")
    return df.where((target >= 0) & (target < float("inf")))


def _has_all(model: str) -> Column:
    """NULL and NaN are missing; an infinite feature is not."""
    found = F.lit(True)
    for c in FEATURES[model]:
        found = found & nan_to_null(F.col(c).cast("double")).isNotNull()
    return found


def training_frame(df: DataFrame, model: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """C11 + C14 + M2: label = log1p(target), rows with a missing feature
    dropped, test flag attached."""
    target = F.col(TARGETS[model]).cast("double")
    return _candidates(df, model).where(_has_all(model)).select(
        spec.row_id, *[F.col(c).cast("double").alias(c) for c in FEATURES[model]],
        target.alias("target"),
        F.log1p(target).alias("label"),
    ).withColumn("is_test", test_flag(spec.row_id))


def dropped_rows(df: DataFrame, model: str) -> DataFrame:
    """C14 tally: of the rows with a usable target, those removed for a missing feature (one row)."""
    return _candidates(df, model).agg(F.count_if(~_has_all(model)).alias("dropped_rows"), F.count(F.lit(1)).alias("candidate_rows"))


# ---------------------------------------------------------------------- M3/M4
@dataclass
class ForestParams:
    num_trees: int = 100
    max_depth: int = 10
    max_bins: int = 64
    seed: int = SPLIT_SEED
    feature_subset: str = "all"
    checkpoint_interval: int = 10
    max_memory_mb: int = 512
    cache_node_ids: bool = False


def forest_pipeline(model: str, params: ForestParams = ForestParams()) -> Pipeline:
    """M1 + M3: assembler over the model's features + random forest on ``label``."""
    assembler = VectorAssembler(inputCols=FEATURES[model], outputCol="features", handleInvalid="error")
    rf = RandomForestRegressor(
        featuresCol="features", labelCol="label", predictionCol="prediction_log",
        numTrees=params.num_trees, maxDepth=params.max_depth, maxBins=params.max_bins,
        seed=params.seed, featureSubsetStrategy=params.feature_subset,
        # cache_node_ids=True trades a per-row node cache (checkpointed every
        # checkpoint_interval levels into the shared folder) for fewer
        # passes; worth it for deep trees on large inputs.
        checkpointInterval=params.checkpoint_interval, cacheNodeIds=params.cache_node_ids,
        maxMemoryInMB=params.max_memory_mb,
    )
    return Pipeline(stages=[assembler, rf])


def fit_model(df: DataFrame, model: str, params: ForestParams = ForestParams(),
              spec: PanelSpec = DEFAULT_SPEC) -> PipelineModel:
    """M4 (fit part): train on the non-test rows.

    The forest reads its input several times (metadata, split candidates,
    bagging); the training frame is persisted first so the panel is derived
    once, and released after the fit.
    """
    from panelwise.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    train = training_frame(df, model, spec).where(~F.col("is_test")).persist()
    try:
        return forest_pipeline(model, params).fit(train)
    finally:
        train.unpersist()


def restored(df: DataFrame, log_column: str = "prediction_log") -> DataFrame:
    """C12 + C13: from the log1p scale, ``prediction`` (expm1, clamped at 0) and
    ``predicted_count`` (rounded half to even, BIGINT)."""
    value = clamp_zero(F.expm1(F.col(log_column)))
    return df.withColumn("prediction", value).withColumn("predicted_count", half_even_int(value))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M5: the model's predictions on the original scale."""
    return restored(model.transform(df)).drop("features")


# ---------------------------------------------------------------------- A23
def regression_metrics(scored: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    """MSE, RMSE and R^2 on the original scale, in one aggregate."""
    y, p = F.col(label), F.col(prediction)
    m = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.sum((y - p) * (y - p)).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    return m.select("n", "mse", F.sqrt("mse").alias("rmse"),
                    (F.lit(1.0) - safe_div(F.col("_sse"), F.col("_sst"))).alias("r2"))


def evaluate(model: PipelineModel, df: DataFrame, model_name: str, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """M6: score the held-out rows of ``df`` and report A23's metrics."""
    test = training_frame(df, model_name, spec).where(F.col("is_test"))
    return regression_metrics(predict(model, test))


def training_report(df: DataFrame, model_name: str, model: PipelineModel, spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """What M4 prints of a model: its rows, those dropped, and A23 on the held-out ones."""
    frame = training_frame(df, model_name, spec)
    counts = frame.select(F.struct(F.count_if(~F.col("is_test")).alias("n_train"),
                                   F.count_if("is_test").alias("n_test"))).scalar()
    dropped = dropped_rows(df, model_name).select("dropped_rows").scalar()
    metrics = regression_metrics(predict(model, frame.where(F.col("is_test"))))
    return metrics.select(F.lit(model_name).alias("model"), counts.getField("n_train").alias("n_train"),
                          counts.getField("n_test").alias("n_test"), dropped.alias("dropped_rows"),
                          "mse", "rmse", "r2")


def train_and_evaluate(df: DataFrame, model_name: str, params: ForestParams = ForestParams(),
                       spec: PanelSpec = DEFAULT_SPEC):
    """M4: C11 -> C14 -> M2 -> M3 -> C12 -> C7 -> A23.  Returns (model, metrics)."""
    model = fit_model(df, model_name, params, spec)
    return model, training_report(df, model_name, model, spec)


# ---------------------------------------------------------------------- K5
def feature_importances(spark: SparkSession, models: dict[str, PipelineModel]) -> DataFrame:
    """K5: each forest's feature importances with their positions, largest first (ties by name)."""
    rows = []
    for name, model in models.items():
        features = model.stages[0].getInputCols()
        ranked = sorted(zip(model.stages[-1].featureImportances.toArray().tolist(), features), key=lambda r: (-r[0], r[1]))
        rows += [(name, i, feature, float(v)) for i, (v, feature) in enumerate(ranked, 1)]
    return spark.createDataFrame(rows, "model string, position long, feature string, importance double")


# ---------------------------------------------------------------------- S4/S5
def save_models(models: dict, path: str) -> None:
    """One PipelineModel directory per model (its assembler keeps the features)."""
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")


def load_models(path: str, required=("deaths",), optional=("vaccinations",)):
    """(models, features); a missing optional model is ``None``, a missing
    required one raises.  Only a missing path is "missing"; a model that is
    there but can't be read raises its own error."""
    models, feats = {}, {}
    spark = SparkSession.getActiveSession()
    for name in tuple(required) + tuple(optional):
        try:
            require_path(spark, f"{path}/{name}")
        except PanelSourceError as exc:
            if name in required:
                raise FileNotFoundError(f"required model '{name}' not found under {path}") from exc
            models[name], feats[name] = None, None
            continue
        m = models[name] = PipelineModel.load(f"{path}/{name}")
        feats[name] = list(m.stages[0].getInputCols())
    return models, feats


def kept_models(table: PreparedTable, params: ForestParams = ForestParams(), names=("deaths", "vaccinations")) -> dict[str, PipelineModel]:
    """S4 + S5: the models of a prepared table, fitted once and kept beside it.

    They are found under the table's fingerprint and the parameters, so a
    changed input or parameter trains anew.
    """
    root = f"{table.path}-models/{hashlib.sha256(repr(params).encode()).hexdigest()[:16]}"
    missing = [n for n in names if not path_exists(table.spark, f"{root}/{n}/_DONE")]
    for name in missing:
        draft = f"{root}/draft-{uuid.uuid4().hex}"
        save_models({name: fit_model(table.read(), name, params, table.spec)}, draft)
        table.spark.createDataFrame([(name,)], "model string").write.parquet(f"{draft}/{name}/_DONE")
        if not move_path(table.spark, f"{draft}/{name}", f"{root}/{name}") and not path_exists(table.spark, f"{root}/{name}/_DONE"):
            raise OSError(f"can't move the model to {root}/{name}")
    return load_models(root, required=names, optional=())[0]


# ---------------------------------------------------------------------- M7/M8/M9
#: Inputs whose default is cut to a whole number, as their controls hold whole numbers.
WHOLE_DEFAULTS = ("population", "total_vaccinations", "people_fully_vaccinated", "days_since_start", "New_deaths")


def _whole(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")


def scenario_frame(scenarios: DataFrame, filtered: DataFrame, full: DataFrame, model_name: str,
                   spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """M7: complete partial scenarios with the selection's defaults.

    ``scenarios`` holds any subset of the model's features (plus any id
    columns).  Missing values come from the medians of ``filtered`` (A14), cut
    to whole numbers where the control holds whole numbers;
    ``vaccination_coverage`` is re-derived as fully / population (0 when the
    population is not positive).  The defaults are one row of numbers.
    """
    defaults = median_defaults(filtered, full=full, spec=spec)
    dflt = defaults.first().asDict()  # exactly one row
    value = {c: _whole(F.lit(v)) if c in WHOLE_DEFAULTS else F.lit(v) for c, v in dflt.items()}
    out = scenarios
    for c in [*FEATURES[model_name], "population", "people_fully_vaccinated", "total_vaccinations"]:
        if c in value:
            given = F.coalesce(F.col(c).cast("double"), value[c]) if c in scenarios.columns else value[c]
            out = out.withColumn(c, given)
    pop, pfv = F.col("population"), F.col("people_fully_vaccinated")
    out = out.withColumn("vaccination_coverage", F.when(pop > 0, pfv / pop).otherwise(F.lit(0.0)))
    return out.withColumn("_default_days", F.lit(dflt["days_since_start"])).withColumn("_default_population", F.lit(dflt["population"]))


def validate_scenarios(frame: DataFrame, model_name: str) -> DataFrame:
    """M8: the input bounds of the what-if controls.  Adds ``valid`` and a
    ``reason`` naming the first violated bound (NULL when valid)."""
    pop = F.col("population")
    # The bounds of the controls, cut to whole numbers where they follow from defaults.
    checks = [
        ("population out of [1e6, 2e9]", ~pop.between(1_000_000, 2_000_000_000)),
        ("total_vaccinations out of [0, 2 x default population]",
         ~F.col("total_vaccinations").between(F.lit(0), _whole(F.col("_default_population") * 2))),
        ("people_fully_vaccinated out of [0, population]", ~F.col("people_fully_vaccinated").between(F.lit(0), _whole(pop))),
        ("days_since_start out of [0, default + 365]",
         ~F.col("days_since_start").between(F.lit(0), _whole(F.col("_default_days") + 365))),
        ("vaccination_coverage above 1", F.col("vaccination_coverage") > 1),
    ]
    if model_name == "vaccinations":
        checks.append(("New_deaths out of [0, 5000]", ~F.col("New_deaths").between(0, 5000)))
    # a bound holds only for the model's own features and the population they are scaled by
    own = set(FEATURES[model_name]) | {"population"}
    checks = [(text, bad) for text, bad in checks if text.split()[0] in own]
    reason = F.lit(None).cast("string")
    for text, bad in reversed(checks):
        reason = F.when(F.coalesce(bad, F.lit(True)), F.lit(text)).otherwise(reason)
    return frame.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def score_scenarios(model: PipelineModel, frame: DataFrame, model_name: str) -> DataFrame:
    """M5 + M7: score the valid scenarios; invalid ones keep a NULL prediction."""
    scored = predict(model, frame.where("valid")).select(*frame.columns, "prediction", "predicted_count")
    invalid = frame.where("not valid").select("*", F.lit(None).cast("double").alias("prediction"),
                                              F.lit(None).cast("bigint").alias("predicted_count"))
    return scored.unionByName(invalid)


def prediction_defaults(filtered: DataFrame, full: DataFrame, horizon_days: int = 7,
                        spec: PanelSpec = DEFAULT_SPEC) -> DataFrame:
    """M9: the single-prediction form's defaults: A13 means, and
    days_since_start for the full table's last date + ``horizon_days``."""
    means = mean_defaults(filtered)
    span = full.select(F.struct(F.min(spec.date).alias("lo"), F.max(spec.date).alias("hi"))).scalar()
    target_day = F.date_add(span.getField("hi"), horizon_days)
    return means.select(
        "*",
        target_day.alias("prediction_date"),
        F.datediff(target_day, span.getField("lo")).alias("days_since_start"),
    )


def score_form(models: dict[str, PipelineModel], defaults: DataFrame) -> DataFrame:
    """M9: the form's inputs (one row a prediction) scored by each model, with the text shown."""
    found = None
    for name, model in models.items():
        scored = predict(model, defaults).select(F.lit(name).alias("model"), "prediction_date", "days_since_start", "prediction", "predicted_count",
                                                 F.format_number("predicted_count", 0).alias("shown"))
        found = scored if found is None else found.unionByName(scored)
    return found
