"""Exact quantiles: equal to numpy's linear percentiles for columns and groups of any shape."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import distribution as dist
from panelwise.operators import profile as prof
from panelwise.operators import quantiles as qt
from panelwise.operators.quantiles import column_quantiles, group_quantiles, value_counts_in_blocks

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    """One group holds 90 % of the rows, 70 % of which are equal."""
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(0, 1, 1500), np.full(4200, 0.125), rng.integers(0, 5, 300).astype(float)])
    rng.shuffle(vals)
    grp = np.where(np.arange(len(vals)) % 10 == 0, "small", "hot")
    rows = [(g, float(v), None if i % 97 == 0 else float(v) * 10 ** (i % 40 - 20)) for i, (g, v) in enumerate(zip(grp, vals))]
    return spark.createDataFrame(rows, "g string, a double, b double").repartition(5).cache(), vals, grp


@pytest.mark.parametrize("shape", [(400, 32, 2000, 1000), (4, 4, 10, 0), (2, 2, 3, 0), (4, 4, 10, 30)])
def test_columns_exact(data, monkeypatch, shape):
    """With tiny sketches the brackets need many passes; the results are the same."""
    for name, value in zip(("GRID", "INNER_GRID", "ACCURACY", "SORTED_VALUES"), shape):
        monkeypatch.setattr(qt, name, value)
    df, vals, _ = data
    got = column_quantiles(df, ["a", "b"], PROBS)
    b = df.select("b").toPandas()["b"].dropna().to_numpy()
    for i, p in enumerate(PROBS):
        assert got["a"][i] == pytest.approx(np.percentile(vals, p * 100), abs=1e-12)
        assert got["b"][i] == pytest.approx(np.percentile(b, p * 100), rel=1e-12)


def test_columns_of_one_value_none_and_infinities(spark):
    d = spark.createDataFrame([(3.0, None, math.inf, float("nan"), -0.0), (3.0, None, -math.inf, 1.0, 0.0), (3.0, None, 5.0, 2.0, 0.0)],
                              "a double, b double, c double, d double, e double")
    got = column_quantiles(d, "abcde", [0.0, 0.5, 1.0])
    assert got == {"a": [3.0] * 3, "b": None, "c": [-math.inf, 5.0, math.inf], "d": [1.0, 1.5, 2.0], "e": [0.0] * 3}
    assert column_quantiles(d.limit(0), ["a"], [0.5]) == {"a": None}


def test_bits_keep_the_order():
    rng = random.Random(2)
    xs = sorted([rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(500)] + [0.0, math.inf, -math.inf, 5e-324, -5e-324])
    assert [qt.from_bits(qt.to_bits(x)) for x in xs] == xs
    assert sorted(map(qt.to_bits, xs)) == list(map(qt.to_bits, xs))


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_groups_exact(data, blocks):
    df, vals, grp = data
    names = [f"q{i}" for i in range(len(PROBS))]
    got = {r["g"]: r for r in group_quantiles(value_counts_in_blocks(df, "g", "a", blocks), "g", PROBS, names).collect()}
    assert set(got) == {"hot", "small"}
    for g, r in got.items():
        assert r["n"] == (grp == g).sum()
        for p, n in zip(PROBS, names):
            assert r[n] == pytest.approx(np.percentile(vals[grp == g], p * 100), abs=1e-12)


def test_hot_group_spreads_over_blocks(spark):
    d = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("small").alias("g"), F.rand(3).alias("a"))
    sizes = [r["count"] for r in value_counts_in_blocks(d, "g", "a", 8).groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2.5 * 20_000 / 8


@pytest.mark.parametrize("blocks", [1, 7])
def test_box_stats_with_a_hot_entity(data, blocks):
    df, vals, grp = data
    d = df.withColumnRenamed("g", "country")
    got = {r["country"]: r for r in dist.box_stats(d, "a", blocks=blocks).collect()}
    outside = dist.box_outliers(d.withColumns({"date": F.lit(1), "row_id": F.lit(1)}), "a", blocks=blocks).groupBy("country").count().collect()
    for g, r in got.items():
        v = vals[grp == g]
        q1, q3 = np.percentile(v, [25, 75])
        inside = (v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))
        assert (r["whisker_low"], r["whisker_high"], r["n_outliers"]) == (v[inside].min(), v[inside].max(), (~inside).sum())
    assert {r["country"]: r["count"] for r in outside} == {g: r["n_outliers"] for g, r in got.items() if r["n_outliers"]}


def test_correlations_with_missing_and_constant_columns(spark):
    rng = np.random.default_rng(5)
    n = 500
    a, c = rng.normal(1e6, 3, n), np.full(n, 0.1)
    b = a * 2 + rng.normal(0, 2, n)
    gaps = [None if i % 3 == 0 else float(v) for i, v in enumerate(b)]
    flat = [7.7 if i % 3 else None for i in range(n)]
    never = [1.0 * i if i % 3 == 0 else None for i in range(n)]
    rows = [(float(a[i]), gaps[i], float(c[i]), flat[i], never[i]) for i in range(n)]
    d = spark.createDataFrame(rows, "a double, b double, c double, flat double, never double").repartition(4)
    got = {(r["x"], r["y"]): r["r"] for r in prof.correlation_matrix(d, d.columns).collect()}
    assert len(got) == 25
    pdf = d.toPandas()
    for (x, y), r in got.items():
        if "c" in (x, y) or "flat" in (x, y) or {x, y} == {"b", "never"}:
            assert r is None
        else:
            assert r == pytest.approx(pdf[x].corr(pdf[y]), abs=1e-9) and got[y, x] == r


def test_profile_counts_values_of_all_types(spark):
    d = spark.sql("SELECT id, CAST(id % 3 AS INT) AS i, id % 2 = 0 AS b, date_add(DATE'2021-01-01', CAST(id % 5 AS INT)) AS d, "
                  "9007199254740992 + id % 2 AS l, IF(id % 4 = 0, NULL, concat('x', id % 7)) AS s, CAST(NULL AS DOUBLE) AS n, "
                  "CAST(id % 6 AS DECIMAL(20,2)) AS m, IF(id % 2 = 0, 0.0D, -0.0D) AS z, array(id % 3) AS a FROM range(1000)")
    got = {r["column"]: (r["dtype"], r["non_null"], r["unique"]) for r in prof.column_profile(d).collect()}
    assert got == {"id": ("bigint", 1000, 1000), "i": ("int", 1000, 3), "b": ("boolean", 1000, 2), "d": ("date", 1000, 5), "l": ("bigint", 1000, 2),
                   "s": ("string", 750, 7), "n": ("double", 0, 0), "m": ("decimal(20,2)", 1000, 6), "z": ("double", 1000, 1), "a": ("array<bigint>", 1000, 3)}
