"""Query registry: a Spark plan builder + DuckDB oracle text per operator.

Every query reads the driver tables (through the panel / events views) in
full.  Double outputs are published through the engine-independent rounding
in both engines (``panelwise.functions.rounding``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwise.functions.rounding import stable_round_doubles
from panelwise.operators.prepare import prepare_panel
from panelwise.plans.oracle_base import finalize, with_prepared, with_raw
from panelwise.sources.driver_views import events_view, panel_view
from panelwise.sources.prepared import PreparedTable, keep_prepared


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    doubles: tuple = ()
    operators: tuple = field(default_factory=tuple)


REGISTRY: dict[str, Query] = {}


def register(name: str, oracle: str | None, doubles=(), operators=(), exact: bool = False):
    """``exact``: the doubles are the same in both engines to the last bit and are published as they are."""
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = fn(spark, sf_dir)
            return found if exact else stable_round_doubles(found)

        build.__name__ = f"q_{name}"
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, finalize(oracle, () if exact else doubles) if oracle else None,
                               tuple(doubles), tuple(operators))
        return fn

    return deco


def prepared_table(spark: SparkSession, sf_dir: str) -> PreparedTable:
    """The prepared panel of a folder's tables, derived once and kept while they don't change."""
    inputs = [f"{sf_dir}/{name}.parquet" for name in ("orders", "customer", "nation")]
    return keep_prepared(spark, inputs, lambda: prepare_panel(panel_view(spark, sf_dir)))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_table(spark, sf_dir).read()


PREPARED_DOUBLES = (
    "total_vaccinations", "people_vaccinated", "people_fully_vaccinated", "New_deaths", "population",
    "ratio", "vaccination_coverage", "new_deaths_per_million", "total_vaccinations_per_hundred",
    "daily_vaccinations", "daily_vaccinated_per_million", "daily_deaths_growth_rate",
    "daily_vaccinations_growth_rate",
)
RAW_DOUBLES = ("total_vaccinations", "people_vaccinated", "people_fully_vaccinated", "New_deaths",
               "population", "ratio")


