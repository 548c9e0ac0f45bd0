"""The published-double rounding gives bit-identical results in Spark and
DuckDB, including exact decimal ties and values next to powers of ten."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from panelwise.functions.rounding import stable_round_sql


def test_spark_and_duckdb_round_identically(spark):
    rng = np.random.default_rng(11)
    vals = list(rng.normal(0, 1, 300) * 10.0 ** rng.integers(-8, 16, 300))
    vals += [9.978111375, 1000.0, 999.9999999999999, 0.125, 2.5e-7, -182292082.5, 123456789.5, 1e18, 3e20,
             1e-12, -0.0, 0.0, 7.0 / 5.0 - 1.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "i int, x double")
    got = {r["i"]: r["y"] for r in df.select("i", F.expr(stable_round_sql("x", dialect="spark")).alias("y")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, float(v)) for i, v in enumerate(vals)])
    want = dict(con.execute(f"SELECT i, {stable_round_sql('x', dialect='duckdb')} FROM t").fetchall())
    for i, v in enumerate(vals):
        assert repr(got[i]) == repr(want[i]), (v, got[i], want[i])
        if abs(v) >= 1e-9:
            assert abs(got[i] - v) <= abs(v) * 1e-8
