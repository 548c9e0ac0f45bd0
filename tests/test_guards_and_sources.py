"""Edge cases and guards: empty input, short series, missing sources, filters."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.operators import aggregate as agg
from panelwise.operators import filters as flt
from panelwise.operators import timeseries as ts
from panelwise.operators.prepare import prepare_panel
from panelwise.sources import PanelSourceError, read_panel_csv, read_panel_parquet


def test_missing_source_raises(spark):
    with pytest.raises(PanelSourceError):
        read_panel_csv(spark, "/nonexistent/panel.csv")
    with pytest.raises(FileNotFoundError):
        read_panel_parquet(spark, "/nonexistent/panel.parquet")


def test_bad_date_is_an_error(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text(",country,iso_code,date,total_vaccinations,people_vaccinated,people_fully_vaccinated,"
                 "New_deaths,population,ratio\n1,A,AAA,not-a-date,1,1,1,1,10,1\n")
    with pytest.raises(Exception):
        prepare_panel(read_panel_csv(spark, str(p))).collect()


def test_filter_inclusive_range(prepared_fixture):
    out = flt.filter_panel(prepared_fixture, ["Alpha", "Beta"], "2021-01-02", "2021-01-03")
    assert sorted(r["row_id"] for r in out.collect()) == [2, 5, 6, 7]
    sel = prepared_fixture.sparkSession.createDataFrame([("Alpha",)], "name string")
    assert flt.filter_panel(prepared_fixture, sel).count() == 3


def test_filter_keeps_features_of_full_table(prepared_fixture):
    # features are computed before filtering: the first kept day has a real diff
    out = flt.filter_panel(prepared_fixture, ["Alpha"], "2021-01-02", None).orderBy("date").first()
    assert out["daily_vaccinations"] == 50.0


def test_default_filters(prepared_fixture):
    names, (lo, hi) = flt.default_filters(prepared_fixture)
    assert names == ["Alpha", "Beta", "Delta"]
    assert (lo, hi) == (dt.date(2021, 1, 1), dt.date(2021, 1, 5))


def test_on_date_default_latest(prepared_fixture):
    assert [r["row_id"] for r in flt.on_date(prepared_fixture).collect()] == [12]


def test_empty_guard(prepared_fixture):
    empty = flt.filter_panel(prepared_fixture, ["Nobody"])
    assert flt.is_empty(empty)
    assert agg.entity_comparison(empty).count() == 0
    assert agg.kpi_summary(empty).first()["total_new_deaths"] == 0.0


def test_stl_skips_short_series(prepared_fixture):
    assert ts.stl_by_entity(prepared_fixture, "New_deaths").count() == 0  # < 14 days everywhere


def test_forecast_needs_more_than_seven_values(prepared_fixture):
    assert ts.moving_average_forecast(prepared_fixture, "New_deaths").count() == 0


def test_horizon_and_lag_bounds(prepared_fixture):
    from panelwise.operators import windows as win

    with pytest.raises(ValueError):
        ts.moving_average_forecast(prepared_fixture, "New_deaths", horizon=31)
    with pytest.raises(ValueError):
        win.lag_pairs(prepared_fixture, "New_deaths", 0)


def test_daily_change_cumulative_vs_daily(prepared_fixture):
    from panelwise.operators import windows as win

    dc = {r["row_id"]: r for r in win.daily_change(prepared_fixture, "total_vaccinations").collect()}
    assert dc[3]["total_vaccinations_calculated_daily_change"] == -30.0  # not clamped
    assert dc[1]["total_vaccinations_calculated_daily_change"] == 0.0
    same = win.daily_change(prepared_fixture, "New_deaths")
    assert same.columns[-1] == "New_deaths"


def test_null_counts_on_raw(raw_panel):
    from panelwise.operators import profile as prof

    nc = {r["column"]: r["missing"] for r in prof.null_counts(raw_panel).collect()}
    assert nc == {"iso_code": 3, "New_deaths": 1, "population": 1, "ratio": 1, "country": 1,
                  "total_vaccinations": 1}


def test_write_prepared_partitions_by_year(prepared_fixture, tmp_path):
    from panelwise.sources import write_prepared

    out = str(tmp_path / "prepared")
    write_prepared(prepared_fixture, out)
    back = prepared_fixture.sparkSession.read.parquet(out)
    assert back.count() == prepared_fixture.count()
    assert back.where(F.col("year") == 2021).count() == back.count()


def test_csv_keeps_whitespace_and_matches_tokens_exactly(spark, tmp_path):
    p = tmp_path / "ws.csv"
    p.write_text(",country,iso_code,date,total_vaccinations,people_vaccinated,people_fully_vaccinated,"
                 "New_deaths,population,ratio\n1, Alpha,NA,2021-01-01,1,1,1, NA,10,n/a\n")
    r = read_panel_csv(spark, str(p)).first()
    assert r["country"] == " Alpha" and r["iso_code"] is None and r["ratio"] is None
    assert r["New_deaths"] == " NA"  # not a missing token for pandas either; typing makes it NULL -> 0


def test_csv_goes_by_header(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text(",iso_code,country,extra,date,total_vaccinations,people_vaccinated,people_fully_vaccinated,New_deaths,population,ratio\n"
                 "1,AAA,Alpha,e,2021-01-01,1,2,3,4,1000,5\n2,AAA,Alpha,e,2021-01-02,12abc,2,3,4,1000,5\n")
    r = read_panel_csv(spark, str(p)).first()
    assert (r["country"], r["iso_code"], r["extra"], r["row_id"]) == ("Alpha", "AAA", "e", 1)
    with pytest.raises(Exception, match="12abc"):
        prepare_panel(read_panel_csv(spark, str(p))).collect()
    q = tmp_path / "q.csv"
    q.write_text(",country,date\n1,Alpha,2021-01-01\n")
    with pytest.raises(ValueError, match="iso_code"):
        read_panel_csv(spark, str(q))


def test_undated_rows_come_last(spark, raw_csv_path, tmp_path):
    p = tmp_path / "n.csv"
    head = open(raw_csv_path).readline()
    p.write_text(head + "1,A,AAA,2021-01-01,10,1,1,1,100,1\n2,A,AAA,2021-01-02,20,1,1,1,100,1\n3,A,AAA,,4,1,1,1,100,1\n")
    got = {r["row_id"]: r["daily_vaccinations"] for r in prepare_panel(read_panel_csv(spark, str(p))).collect()}
    assert got == {1: 0.0, 2: 10.0, 3: 0.0}


def test_top_bottom_takes_the_limit_asked_for(spark):
    from panelwise.operators import aggregate as agg

    d = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(30)], "country string, m double")
    assert agg.top_bottom(d, "m", n=15).count() == 30
