"""Panel column naming and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F, types as T


@dataclass(frozen=True)
class PanelSpec:
    """Names of the columns that give a panel table its shape.

    ``entity`` is the series key (a country), ``date`` the daily time axis and
    ``row_id`` a unique row identity used to break ties between equal
    (entity, date) pairs so that every ordering is deterministic.
    """

    entity: str = "country"
    date: str = "date"
    row_id: str = "row_id"
    iso: str = "iso_code"
    population: str = "population"
    total_vaccinations: str = "total_vaccinations"
    people_vaccinated: str = "people_vaccinated"
    people_fully_vaccinated: str = "people_fully_vaccinated"
    new_deaths: str = "New_deaths"
    ratio: str = "ratio"

    def order(self):
        """Window ordering inside one entity: date (undated rows last), then row id."""
        return [F.asc_nulls_last(self.date), F.asc(self.row_id)]


DEFAULT_SPEC = PanelSpec()

# Raw metric columns whose missing values mean zero.
FILL_ZERO_COLUMNS = (
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
    "New_deaths",
    "ratio",
)

# Derived columns, in the order prepare_panel appends them.
DERIVED_COLUMNS = (
    "vaccination_coverage",
    "new_deaths_per_million",
    "total_vaccinations_per_hundred",
    "daily_vaccinations",
    "daily_vaccinated_per_million",
    "daily_deaths_growth_rate",
    "daily_vaccinations_growth_rate",
    "days_since_start",
)

RAW_COLUMNS = (
    "row_id",
    "country",
    "iso_code",
    "date",
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
    "New_deaths",
    "population",
    "ratio",
)

# CSV layout: every value is read as text and typed afterwards, so that
# lenient numeric coercion (bad token -> NULL) and strict date parsing are
# explicit steps rather than reader side effects.
RAW_CSV_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType(), True)]
    + [T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS[1:]]
)

# The numeric columns correlated in the reference's heatmap and offered on
# the scatter axes (fixed list, in the reference's order).
CORRELATION_COLUMNS = (
    "total_vaccinations",
    "people_vaccinated",
    "people_fully_vaccinated",
    "New_deaths",
    "population",
    "ratio",
    "vaccination_coverage",
    "days_since_start",
    "new_deaths_per_million",
    "total_vaccinations_per_hundred",
    "daily_vaccinations",
    "daily_vaccinated_per_million",
    "daily_deaths_growth_rate",
    "daily_vaccinations_growth_rate",
)
