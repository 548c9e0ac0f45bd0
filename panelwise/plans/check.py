"""Run registered queries in Spark and their oracle texts in DuckDB, and
compare them the way the correctness gate does: columns sorted by name, row
count, column types, and an order-insensitive multiset of exact values."""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import sys
import time

import duckdb

from panelwise.sources.driver_views import TABLES


def duck_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, _dt.datetime):
        return v.isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


_SPARK_KIND = {"double": "float", "float": "float", "bigint": "int64", "int": "int32", "smallint": "int16",
               "tinyint": "int8", "string": "str", "date": "date", "boolean": "bool", "timestamp": "ts",
               "timestamp_ntz": "ts"}
_DUCK_KIND = {"DOUBLE": "float", "FLOAT": "float", "BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16",
              "TINYINT": "int8", "VARCHAR": "str", "DATE": "date", "BOOLEAN": "bool", "TIMESTAMP": "ts"}


def compare(spark, name, query, sf_dir, con=None, verbose=True):
    con = con or duck_connection(sf_dir)
    t0 = time.time()
    sdf = query.build(spark, sf_dir)
    s_rows = [r.asDict() for r in sdf.collect()]
    s_types = {f.name: _SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema}
    t1 = time.time()
    if query.oracle is None:
        res = {"name": name, "status": "rows-only", "rows": len(s_rows), "spark_s": round(t1 - t0, 2)}
        if verbose:
            print(res, flush=True)
        return res
    rel = con.sql(query.oracle)
    d_cols = rel.columns
    d_types = {c: _DUCK_KIND.get(str(t), str(t)) for c, t in zip(d_cols, rel.types)}
    d_rows = rel.fetchall()
    t2 = time.time()
    res = {"name": name, "rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    s_cols = sorted(s_types)
    problems = []
    if s_cols != sorted(d_cols):
        problems.append(f"columns differ: spark={s_cols} duck={sorted(d_cols)}")
    else:
        tdiff = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
        if tdiff:
            problems.append(f"types differ: {tdiff}")
        s_set = sorted((tuple(_norm(r[c]) for c in s_cols) for r in s_rows), key=repr)
        idx = [d_cols.index(c) for c in s_cols]
        d_set = sorted((tuple(_norm(r[i]) for i in idx) for r in d_rows), key=repr)
        if len(s_rows) != len(d_rows):
            problems.append("row counts differ")
        elif s_set != d_set:
            bad = [(a, b) for a, b in zip(s_set, d_set) if a != b]
            problems.append(f"{len(bad)} rows differ; first: spark={bad[0][0]} duck={bad[0][1]} cols={s_cols}")
    res["status"] = "match" if not problems else "MISMATCH"
    if problems:
        res["problems"] = problems
    if verbose:
        print({k: v for k, v in res.items()}, flush=True)
    return res


def main(argv=None):
    argv = sys.argv[1:] if argv is None else argv
    from panelwise.plans.catalog import REGISTRY
    from panelwise.session import local_session

    sf_dir = "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("--")] or list(REGISTRY)
    spark = local_session(8)
    con = duck_connection(sf_dir)
    results = [compare(spark, n, REGISTRY[n], sf_dir, con) for n in names]
    bad = [r["name"] for r in results if r["status"] == "MISMATCH"]
    print("SUMMARY", len(results), "queries;", "mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
