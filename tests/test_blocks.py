"""Series in blocks: the same rows whatever the blocks, and as many tasks as a hot entity needs."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import Window, functions as F

from panelwise.operators import blocks as bl
from panelwise.operators import windows as win
from panelwise.operators.exact_sums import limbs_of
from panelwise.operators.prepare import prepare_panel
from panelwise.sources import panel_view
from panelwise.spec import DEFAULT_SPEC

from conftest import SF001

BLOCKS = [1, 2, 9, 60]


@pytest.fixture(scope="module")
def hard_panel(spark, raw_panel):
    """The driver's panel with undated rows, an entity of one repeated date, rows without entity, and fractions of many sizes."""
    raw = panel_view(spark, SF001)
    raw = raw.withColumn("date", F.when(F.pmod(F.hash("row_id"), F.lit(6)) > 0, F.col("date")))
    raw = raw.withColumn("date", F.when(F.col("country") == "NATION_4", F.lit("1995-05-05").cast("date")).otherwise(F.col("date")))
    raw = raw.withColumn("country", F.when(F.col("country") != "NATION_6", F.col("country")))
    for c, by in (("New_deaths", 3), ("people_vaccinated", 7), ("total_vaccinations", 11)):
        raw = raw.withColumn(c, F.col(c) / by * F.pow(F.lit(10.0), F.pmod(F.hash("row_id"), F.lit(9))))
    return raw.select(*raw_panel.columns).cache()


def _plain_prepared(raw):
    """W1-W3 by windows over whole entities."""
    from panelwise.operators import prepare as pr

    d = pr.add_ratio_features(pr.clean_panel(raw))
    d = pr._window_columns(d, DEFAULT_SPEC, Window.partitionBy("country").orderBy(*DEFAULT_SPEC.order()))
    return pr.add_days_since_start(d)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("blocks", BLOCKS)
def test_features_equal_whole_entity_windows(hard_panel, raw_panel, blocks):
    for raw in (hard_panel, raw_panel):
        plain = _plain_prepared(raw)
        assert _rows(prepare_panel(raw, blocks=blocks).select(*plain.columns)) == _rows(plain)


@pytest.fixture(scope="module")
def prepared(hard_panel):
    return prepare_panel(hard_panel, blocks=3).cache()


@pytest.mark.parametrize("blocks", BLOCKS)
def test_lags_and_changes_equal_whole_entity_windows(prepared, blocks):
    w = Window.partitionBy("country").orderBy(*DEFAULT_SPEC.order())
    base = prepared.select("country", "date", "row_id", "New_deaths")
    for lag in (1, 7, 30):
        lagged = F.when(F.col("country").isNotNull(), F.lag("New_deaths", lag).over(w))
        assert _rows(win.lag_pairs(prepared, "New_deaths", lag, blocks=blocks)) == _rows(base.withColumn("l", lagged).dropna(subset=["New_deaths", "l"]))
    c = F.col("people_vaccinated")
    change = F.when(F.col("country").isNull(), 0.0).otherwise(F.coalesce(c - F.lag(c).over(w), F.lit(0.0)))
    assert _rows(win.daily_change(prepared, "people_vaccinated", blocks=blocks)) == _rows(prepared.select("country", "date", "row_id", change.alias("x")))


@pytest.mark.parametrize("blocks", BLOCKS)
def test_totals_are_the_nearest_doubles_and_means_those_of_whole_entities(prepared, blocks):
    found = {r["row_id"]: r for r in win.cumulative_and_rolling(prepared, blocks=blocks).collect()}
    w = Window.partitionBy("country").orderBy(*DEFAULT_SPEC.order()).rowsBetween(-6, 0)
    means = prepared.select("row_id", F.when(F.col("country").isNotNull(), F.avg("New_deaths").over(w)).alias("m"))
    assert all(found[r["row_id"]]["Rolling_Avg_Deaths"] == r["m"] for r in means.collect())
    totals = {}
    far = len(found)
    rows = prepared.select("country", "date", "row_id", "New_deaths", "daily_vaccinations").collect()
    for r in sorted(rows, key=lambda r: (r["country"] or "", r["date"] is None, str(r["date"]), r["row_id"])):
        for metric, name in (("New_deaths", "Cumulative_New_Deaths"), ("daily_vaccinations", "Cumulative_Daily_Vaccinations")):
            key = (r["country"], metric)
            totals[key] = totals.get(key, Fraction(0)) + Fraction(r[metric])
            expected = None if r["country"] is None else float(totals[key])  # Fraction rounds to the nearest double
            assert found[r["row_id"]][name] == expected
    assert far > 1000


def _total(spark, values):
    d = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    cut = limbs_of(d, ["v"])["v"]
    names = [f"l{i}" for i in range(cut.count)]
    sums = d.select(*[c.alias(n) for c, n in zip(cut.of_value(), names)], cut.not_finite().alias("beyond")).agg(*[F.sum(n).alias(n) for n in [*names, "beyond"]])
    return sums.select(cut.total(names, "beyond")).first()[0]


def test_exact_sums(spark):
    rng = random.Random(4)
    cases = [[0.1] * 10 + [1e16, -1e16, 3.3], [1.0, 2.0, -10.0], [1e300, 1e-300, -1e300, 5e-324], [None, 0.0], [2.0 ** 53, 1.0, 1.0, 2.0 ** -60, -(2.0 ** -61)],
             [rng.uniform(-1, 1) * 10 ** rng.randint(-5, 9) for _ in range(2000)], [rng.uniform(-1, 1) * 10 ** rng.randint(-250, 250) for _ in range(300)],
             [2.0 ** 53, 1.0], [2.0 ** 53, 1.0, 2.0 ** -40], [2.0 ** 54, 2.0, -(2.0 ** -50)], [-0.1, -0.2, -0.3]]
    for values in cases:
        assert _total(spark, values) == math.fsum(v for v in values if v is not None), values[:5]
    assert _total(spark, [math.inf, 1.0]) == math.inf
    assert math.isnan(_total(spark, [math.inf, -math.inf, 1.0]))


def test_one_date_repeated_spreads_over_blocks(spark):
    """An entity of one date holds 90 % of the rows; no block holds much more than its share."""
    d = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 50)).alias("country"),
                                   F.lit("2021-01-01").cast("date").alias("date"), F.col("id").alias("row_id"), (F.col("id") / 3).alias("m"))
    sizes = [r["count"] for r in bl.in_blocks(d, ["country"], DEFAULT_SPEC.order(), 8).groupBy(bl.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 40_000 / 8
    total = win.running_totals(d, {"m": "t"}, blocks=8).where("country = 'hot'").orderBy("row_id").collect()
    at = Fraction(0)
    for r in total:
        at += Fraction(r["row_id"] / 3)
        assert r["t"] == float(at)


@pytest.mark.parametrize("blocks", [1, 5, 50])
def test_position_counts_all_rows_before(spark, blocks):
    d = spark.range(3000).select(F.col("id"), F.pmod(F.hash("id"), F.lit(20)).alias("v"))
    found = bl.with_position(d, [F.desc("v"), F.asc("id")], blocks=blocks).collect()
    order = sorted(found, key=lambda r: (-r["v"], r["id"]))
    assert [r["position"] for r in order] == list(range(1, 3001))


def test_plan_has_one_shuffle_after_the_blocks(prepared):
    """Windows over the blocks' table shuffle once; halos and prefix states are broadcast."""
    plan = win.lag_pairs(prepared, "New_deaths", 7)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan
