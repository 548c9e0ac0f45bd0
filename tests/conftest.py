import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwise.session import local_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# Hand-made raw panel (FIXTURES F-A): nulls, NA tokens, population 0 / NULL /
# "abc", a counter that goes down, a date gap, a duplicate (country, date),
# a NULL country, a NULL iso code, two countries sharing an iso code, a
# single-row entity, a constant metric, previous values 0 -> 0 and 0 -> 5.
RAW_CSV = """,country,iso_code,date,total_vaccinations,people_vaccinated,people_fully_vaccinated,New_deaths,population,ratio
1,Alpha,AAA,2021-01-01,100,80,10,5,1000,8
2,Alpha,AAA,2021-01-02,150,90,20,,1000,9
3,Alpha,AAA,2021-01-04,120,95,30,10,1000,9.5
4,Beta,BBB,2021-01-01,0,0,0,0,2000,
5,Beta,BBB,2021-01-02,0,0,0,0,2000,0
6,Beta,BBB,2021-01-03,50,10,5,5,2000,0.5
7,Beta,BBB,2021-01-03,60,12,6,7,2000,0.6
8,Gamma,,2021-01-02,10,5,1,3,0,0.5
9,Gamma,,2021-01-03,10,5,1,3,,0.5
10,Gamma,,2021-01-04,10,5,1,3,abc,0.5
11,,ZZZ,2021-01-02,40,20,10,2,500,4
12,Delta,AAA,2021-01-05,70,30,15,4,3000,1
13,Epsilon,EEE,2021-01-01,10,10,10,7,100,10
14,Epsilon,EEE,2021-01-02,10,10,10,7,100,10
15,Epsilon,EEE,2021-01-03,NA,10,10,7,100,10
"""


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="panelwise-tests")
    yield s


@pytest.fixture(scope="session")
def raw_csv_path(tmp_path_factory):
    p = tmp_path_factory.mktemp("panel") / "panel.csv"
    p.write_text(RAW_CSV)
    return str(p)


@pytest.fixture(scope="session")
def raw_panel(spark, raw_csv_path):
    from panelwise.sources import read_panel_csv

    return read_panel_csv(spark, raw_csv_path)


@pytest.fixture(scope="session")
def prepared_fixture(raw_panel):
    from panelwise.operators.prepare import prepare_panel

    return prepare_panel(raw_panel).cache()
