"""Cross-operator properties on the driver panel (sf0.001) and the fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import aggregate as agg
from panelwise.operators import distribution as dist
from panelwise.operators import profile as prof
from panelwise.operators import timeseries as ts
from panelwise.operators import windows as win
from panelwise.operators.prepare import prepare_panel
from panelwise.sources import panel_view

from conftest import SF001


@pytest.fixture(scope="module")
def panel(spark):
    return prepare_panel(panel_view(spark, SF001)).cache()


def test_running_total_ends_at_group_sum(panel):
    cum = win.cumulative_and_rolling(panel)
    last = (cum.groupBy("country").agg(F.max_by("Cumulative_New_Deaths", F.struct("date", "row_id")).alias("c"))
            .collect())
    sums = {r["country"]: r["Total_New_Deaths"] for r in agg.entity_comparison(panel).collect()}
    for r in last:
        assert r["c"] == pytest.approx(sums[r["country"]])


def test_rolling_mean_first_row_is_value(panel):
    cum = win.cumulative_and_rolling(panel).join(panel.select("row_id", "New_deaths"), "row_id")
    first = cum.orderBy("country", "date", "row_id").first()
    assert first["Rolling_Avg_Deaths"] == first["New_deaths"]


def test_histogram_counts_sum_to_rows(panel):
    h = dist.histogram(panel, "New_deaths", 30).collect()
    assert len(h) == 30
    assert sum(r["count"] for r in h) == panel.where(F.col("New_deaths").isNotNull()).count()
    edges = sorted((r["bin"], r["lower"], r["upper"]) for r in h)
    assert all(a[2] == pytest.approx(b[1]) for a, b in zip(edges, edges[1:]))


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "v double")
    h = dist.histogram(df, "v", 30).collect()
    assert len(h) == 3  # min(30, rows)
    assert [r["count"] for r in sorted(h, key=lambda r: r["bin"])] == [0, 3, 0]


def test_kde_integrates_to_one(panel):
    k = dist.kde(panel, "New_deaths", by="country").toPandas()
    for _, g in k.groupby("country"):
        g = g.sort_values("grid_index")
        area = np.trapezoid(g["density"], g["x"])
        assert area == pytest.approx(1.0, abs=0.02)


def test_status_shares_sum_to_one(panel):
    rows = agg.vaccination_status(panel).collect()
    assert sum(r["share"] for r in rows) == pytest.approx(1.0)


def test_top_bottom_subset_of_entities(panel):
    ents = {r["country"] for r in agg.entity_list(panel).collect()}
    tb = agg.top_bottom(panel, "daily_deaths_growth_rate").collect()
    assert {r["country"] for r in tb} <= ents
    assert len([r for r in tb if r["side"] == "top"]) == min(5, len(ents))


def test_correlation_matrix_symmetric(panel):
    m = {(r["x"], r["y"]): r["r"] for r in prof.correlation_matrix(panel).collect()}
    for (a, b), v in m.items():
        assert m[(b, a)] == v
        if v is not None:
            assert -1.0 - 1e-9 <= v <= 1.0 + 1e-9


def test_describe_matches_direct_aggregates(panel):
    d = {r["column"]: r for r in prof.describe(panel, ["New_deaths"]).collect()}["New_deaths"]
    pdf = panel.select("New_deaths").toPandas()["New_deaths"]
    assert d["count"] == len(pdf)
    assert d["mean"] == pytest.approx(pdf.mean())
    assert d["std"] == pytest.approx(pdf.std())
    assert d["q25"] == pytest.approx(pdf.quantile(0.25))
    assert d["q75"] == pytest.approx(pdf.quantile(0.75))


def test_box_stats_against_numpy(panel):
    b = {r["country"]: r for r in dist.box_stats(panel, "New_deaths").collect()}
    pdf = panel.select("country", "New_deaths").toPandas()
    for c, g in pdf.groupby("country"):
        v = g["New_deaths"].to_numpy()
        q1, q3 = np.percentile(v, [25, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert b[c]["whisker_low"] == pytest.approx(v[v >= lo].min())
        assert b[c]["whisker_high"] == pytest.approx(v[v <= hi].max())
        assert b[c]["n_outliers"] == int(((v < lo) | (v > hi)).sum())


def test_daily_grid_is_gap_free(panel):
    g = ts.daily_grid(panel, "New_deaths")
    per = g.groupBy("country").agg(F.count(F.lit(1)).alias("n"),
                                   F.datediff(F.max("date"), F.min("date")).alias("span")).collect()
    assert all(r["n"] == r["span"] + 1 for r in per)
    # totals are preserved: filled days add zeros only
    assert g.agg(F.sum("New_deaths")).first()[0] == pytest.approx(panel.agg(F.sum("New_deaths")).first()[0])


def test_stl_components_sum_to_series(spark):
    from panelwise.sources import events_view
    from panelwise.spec import PanelSpec

    spec = PanelSpec(entity="event_type", date="date", row_id="date")
    out = ts.stl_by_entity(events_view(spark, SF001), "n_events", spec=spec).toPandas()
    assert len(out) > 0
    err = (out["trend"] + out["seasonal"] + out["resid"] - out["observed"]).abs().max()
    assert err < 1e-9


def test_stl_recovers_weekly_pattern():
    rng = np.random.default_rng(1)
    t = np.arange(140)
    season = np.tile([3.0, 1.0, 0.0, -1.0, -2.0, -1.0, 0.0], 20)
    y = 0.05 * t + season + rng.normal(0, 0.1, len(t))
    tr, se, re = ts.stl_decompose(y)
    assert np.abs(se[21:119] - season[21:119]).max() < 0.5
    assert np.abs(tr + se + re - y).max() < 1e-9


def test_forecast_is_flat_mean_of_last_seven(panel):
    f = ts.moving_average_forecast(panel, "New_deaths", horizon=3)
    fc = f.where("kind = 'forecast'")
    lv = {r["country"]: r["level"] for r in win.last_rows_mean(panel, "New_deaths").collect()}
    rows = fc.collect()
    assert rows and all(r["value"] == pytest.approx(lv[r["country"]]) for r in rows)
    per = fc.groupBy("country").count().collect()
    assert all(r["count"] == 3 for r in per)


def test_lag_pairs_drop_incomplete(panel):
    lp = win.lag_pairs(panel, "New_deaths", 3)
    firsts = panel.groupBy("country").count().collect()
    expected = sum(max(0, r["count"] - 3) for r in firsts)
    assert lp.count() == expected


def test_pair_bins_counts(panel):
    cols = ["New_deaths", "vaccination_coverage", "population"]
    pb = dist.pair_bins(panel, cols, 10).collect()
    n = panel.dropna(subset=cols).count()
    per_pair = {}
    for r in pb:
        per_pair[(r["x"], r["y"])] = per_pair.get((r["x"], r["y"]), 0) + r["count"]
    assert set(per_pair.values()) == {n} and len(per_pair) == 3


def test_missing_cells_shape(spark, raw_panel):
    m = prof.missing_cells(raw_panel)
    assert m.count() == raw_panel.count()
    assert m.where("population").count() == 1  # the empty population cell


def test_describe_approximate_option(panel):
    exact = {r["column"]: r for r in prof.describe(panel, ["New_deaths"]).collect()}["New_deaths"]
    approx = {r["column"]: r for r in prof.describe(panel, ["New_deaths"], exact=False).collect()}["New_deaths"]
    assert approx["count"] == exact["count"] and approx["mean"] == pytest.approx(exact["mean"])
    assert approx["q50"] == pytest.approx(exact["q50"], rel=0.05, abs=1.0)


def test_kde_binned_path_close_to_exact(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 4000)], "v double")
    exact = dist.kde(df, "v").toPandas().sort_values("grid_index")
    binned = dist.kde(df, "v", bins=4096).toPandas().sort_values("grid_index")
    assert np.allclose(exact["x"], binned["x"])
    assert np.max(np.abs(exact["density"].to_numpy() - binned["density"].to_numpy())) < 1e-4


def test_column_profile_approx_close(panel):
    exact = {r["column"]: r["unique"] for r in prof.column_profile(panel).collect()}
    approx = {r["column"]: r["unique"] for r in prof.column_profile(panel, approx=True).collect()}
    for c, v in exact.items():
        assert abs(approx[c] - v) <= max(2, 0.1 * v)


def _direct_density(values, x):
    """The kernel sum in Python's longest floats, one value at a time."""
    v = np.asarray(values, dtype=np.longdouble)
    bw = np.std(v, ddof=1) * np.longdouble(len(v)) ** np.longdouble(-0.2)
    z = (np.asarray(x, dtype=np.longdouble)[:, None] - v[None, :]) / bw
    return np.exp(-0.5 * z * z).sum(axis=1) / (len(v) * bw * np.sqrt(2 * np.longdouble(np.pi)))


@pytest.mark.parametrize("shape", ["normal", "heavy_tail", "ties", "two_values", "gap"])
def test_kde_error_is_within_its_bound(spark, shape):
    rng = np.random.default_rng(11)
    values = {"normal": rng.normal(50, 3, 3000), "heavy_tail": np.exp(rng.normal(0, 2.5, 3000)),
              "ties": np.floor(rng.gamma(0.4, 9, 4000)), "two_values": np.array([1.0, 2.0]),
              "gap": np.concatenate([rng.normal(0, 1, 5000), [400.0]])}[shape]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 1.0), ("c", 3.0), (None, 7.0), ("a", None)],
                               "g string, v double")
    got = dist.kde(df, "v", by="g").toPandas().sort_values("grid_index")
    assert set(got["g"]) == {"a"} and got["grid_index"].tolist() == list(range(200))
    want = _direct_density(values, got["x"])
    seen = want > 1e-300
    assert np.max(np.abs(got["density"].to_numpy()[seen] / want[seen] - 1)) < 1e-11
    assert np.all(got["density"].to_numpy()[~seen] <= 1e-299)


def test_kde_moments_meet_the_stated_bound():
    z = dist.REACH / (2 * dist.CELLS_PER_BANDWIDTH)
    m = dist.HIGHEST_MOMENT
    assert z < 1.22 and math.exp(2 * z) * z ** (m + 1) / math.factorial(m + 1) < 1e-12


def test_kde_reads_rows_without_a_grid_or_a_loop(spark, panel):
    for by in ("country", None):
        plan = dist.kde(panel, "New_deaths", by=by)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_kde_of_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert dist.kde(df, "v").count() == 0 and dist.kde(df, "v", by="g").count() == 0
