"""F1 on the hand-made panel: literal expected values, worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwise.operators import aggregate as agg

D = dt.date


def rows_by_id(df):
    return {r["row_id"]: r.asDict() for r in df.collect()}


def test_row_filtering(prepared_fixture):
    ids = sorted(rows_by_id(prepared_fixture))
    # Gamma (population 0, NULL, "abc") is dropped, everything else kept
    assert ids == [1, 2, 3, 4, 5, 6, 7, 11, 12, 13, 14, 15]


def test_types(prepared_fixture):
    types = dict(prepared_fixture.dtypes)
    assert types["date"] == "date"
    assert types["population"] == "double"
    assert types["days_since_start"] == "int"
    assert all(types[c] == "double" for c in ("daily_vaccinations", "daily_deaths_growth_rate"))


EXPECTED = {
    # row: (coverage, deaths/M, tv/100, daily_vacc, daily_vacc/M, deaths growth, vacc growth, days)
    1: (0.01, 5000.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0),
    2: (0.02, 0.0, 15.0, 50.0, 50000.0, -1.0, 0.0, 1),      # NULL deaths -> 0; 50/0 -> 0
    3: (0.03, 10000.0, 12.0, 0.0, 0.0, 0.0, -1.0, 3),        # counter down -> 0; 10/0 -> 0; gap
    4: (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0),
    5: (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1),               # 0 -> 0
    6: (0.0025, 2500.0, 2.5, 50.0, 25000.0, 0.0, 0.0, 2),   # 0 -> 5
    7: (0.003, 3500.0, 3.0, 10.0, 5000.0, 0.4, -0.8, 2),     # duplicate date, after row 6
    11: (0.02, 4000.0, 8.0, 0.0, 0.0, 0.0, 0.0, 1),          # NULL country -> window values 0
    12: (0.005, 1333.3333333333333, 2.3333333333333335, 0.0, 0.0, 0.0, 0.0, 4),
    13: (0.1, 70000.0, 10.0, 0.0, 0.0, 0.0, 0.0, 0),
    14: (0.1, 70000.0, 10.0, 0.0, 0.0, 0.0, 0.0, 1),         # constant deaths -> growth 0
    15: (0.1, 70000.0, 0.0, 0.0, 0.0, 0.0, 0.0, 2),          # "NA" -> 0; drop clamped
}
COLS = ("vaccination_coverage", "new_deaths_per_million", "total_vaccinations_per_hundred",
        "daily_vaccinations", "daily_vaccinated_per_million", "daily_deaths_growth_rate",
        "daily_vaccinations_growth_rate", "days_since_start")


@pytest.mark.parametrize("row_id", sorted(EXPECTED))
def test_derived_values(prepared_fixture, row_id):
    got = rows_by_id(prepared_fixture)[row_id]
    for c, want in zip(COLS, EXPECTED[row_id]):
        assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-12), (row_id, c)


def test_fill_zero_and_dates(prepared_fixture):
    r = rows_by_id(prepared_fixture)
    assert r[2]["New_deaths"] == 0.0
    assert r[4]["ratio"] == 0.0
    assert r[15]["total_vaccinations"] == 0.0
    assert r[3]["date"] == D(2021, 1, 4)


def test_entity_comparison(prepared_fixture):
    cmp = {r["country"]: r for r in agg.entity_comparison(prepared_fixture).collect()}
    assert None not in cmp  # NULL entity dropped from group-bys
    a = cmp["Alpha"]
    assert a["Total_New_Deaths"] == 15.0
    assert a["Max_Total_Vaccinations"] == 150.0
    assert a["Avg_Daily_New_Deaths"] == pytest.approx(5.0)
    assert a["Avg_Daily_Vaccinations"] == pytest.approx(50.0 / 3)


def test_formatted_comparison(prepared_fixture):
    f = {r["country"]: r for r in agg.format_entity_comparison(agg.entity_comparison(prepared_fixture)).collect()}
    assert f["Alpha"]["Max_Population"] == "1,000"
    assert f["Alpha"]["Avg_Daily_Vaccinations"] == "16"  # int() truncates 16.67
    assert f["Alpha"]["Avg_Vaccination_Coverage"] == "2.00%"
    assert f["Delta"]["Avg_New_Deaths_Per_Million"] == "1333.33"


def test_latest_stats_ties_and_nulls(prepared_fixture):
    latest = {r["country"]: r for r in agg.latest_stats(prepared_fixture).collect()}
    assert latest["Beta"]["Latest_New_Deaths"] == 7.0  # same date: higher row id is later
    assert latest["Alpha"]["Latest_Total_Vaccinations"] == 120.0


def test_geo_snapshot_fan_out(prepared_fixture):
    rows = agg.geo_snapshot(prepared_fixture).collect()
    aaa = sorted((r["country"], r["Cumulative_New_Deaths"]) for r in rows if r["iso_code"] == "AAA")
    # latest AAA row is Delta's; cumulative deaths fan out over Alpha and Delta
    assert aaa == [("Delta", 4.0), ("Delta", 15.0)]
    zzz = [r for r in rows if r["iso_code"] == "ZZZ"]
    assert len(zzz) == 1 and zzz[0]["country"] is None and zzz[0]["Cumulative_New_Deaths"] == 0.0


def test_vaccination_status_shares(prepared_fixture):
    rows = {r["status"]: r for r in agg.vaccination_status(prepared_fixture).collect()}
    # latest rows: Alpha r3, Beta r6 AND r7 (tied date), Delta r12, Epsilon r15
    # -> v=157, f=66, p=8100
    assert rows["Fully Vaccinated"]["count"] == 66.0
    assert rows["Partially Vaccinated"]["count"] == 91.0
    assert rows["Unvaccinated"]["count"] == 8100.0 - 157.0
    assert sum(r["share"] for r in rows.values()) == pytest.approx(1.0)


def test_top_bottom(prepared_fixture):
    rows = agg.top_bottom(prepared_fixture, "New_deaths").collect()
    top = [r["country"] for r in rows if r["side"] == "top"]
    bottom = [r["country"] for r in rows if r["side"] == "bottom"]
    # four entities -> n = 4; means: Epsilon 7, Alpha 5, Delta 4, Beta 3
    assert top == ["Epsilon", "Alpha", "Delta", "Beta"]
    assert bottom == top  # tail(4) of a 4-entity ranking, still descending
    rows2 = agg.top_bottom(prepared_fixture, "New_deaths", n=1).collect()
    assert [(r["side"], r["country"]) for r in rows2] == [("top", "Epsilon"), ("bottom", "Beta")]


def test_period_totals(prepared_fixture):
    m = agg.period_totals(prepared_fixture, "New_deaths", "month").collect()
    assert {(r["time_period"], r["country"]): r["New_deaths"] for r in m}[("2021-01", "Alpha")] == 15.0
    y = agg.period_totals(prepared_fixture, "New_deaths", "year").collect()
    assert {r["time_period"] for r in y} == {2021}


def test_defaults(prepared_fixture):
    mean = agg.mean_defaults(prepared_fixture).first()
    assert mean["population"] == pytest.approx((3 * 1000 + 4 * 2000 + 500 + 3000 + 3 * 100) / 12)
    med = agg.median_defaults(prepared_fixture).first()
    assert med["New_deaths"] == pytest.approx(5.0)
    assert med["days_since_start"] == 4.0


def test_kpi_counts_missing_entity(prepared_fixture):
    k = agg.kpi_summary(prepared_fixture).first()
    assert k["entity_count"] == 5  # four names + the missing one, like unique()
    assert k["total_new_deaths"] == 15 + 12 + 2 + 4 + 21
