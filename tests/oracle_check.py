"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

STRICT = os.environ.get("ORACLE_STRICT") == "1"  # compare doubles bit for bit

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, strict=None):
    strict = STRICT if strict is None else strict
    if v is None:
        return None
    if isinstance(v, (float, np.floating)):
        v = float(v)
        if math.isnan(v):
            return None
        return v if strict else round(v, 9)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x, strict) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    return v


def rows_of(df: pd.DataFrame, strict=None) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c], strict) for c in cols) for _, r in df.iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, name: str, sf_dir: str, con=None, strict=None) -> dict:
    from wearline.plans.catalog import ORACLE, QUERIES
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_schema = [(f.name, f.dataType.simpleString()) for f in sdf.schema.fields]
    sp = sdf.toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sp), "spark_sec": round(t1 - t0, 2), "schema": s_schema}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    rel = con.execute(ORACLE[name])
    duck_types = {d[0]: str(d[1]).upper() for d in rel.description}
    dp = rel.df()
    res["duck_rows"] = len(dp)
    res["duck_sec"] = round(time.time() - t1, 2)
    if sorted(sp.columns) != sorted(dp.columns):
        res["status"] = f"COLUMNS differ spark={sorted(sp.columns)} duck={sorted(dp.columns)}"
        return res
    want = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    bad_types = {c: (t, duck_types.get(c)) for c, t in s_schema if want.get(t, t.upper()) != duck_types.get(c)}
    if bad_types:
        res["status"] = f"TYPES differ {bad_types}"
        return res
    a, b = rows_of(sp, strict), rows_of(dp, strict)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT differs"
        return res
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    res["status"] = "ok" if not bad else f"VALUES differ in {len(bad)} rows, e.g. {bad[:2]}"
    return res


if __name__ == "__main__":
    from wearline.plans.catalog import QUERIES
    from wearline.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = get_spark()
    con = duck(sf)
    fails = 0
    for n in names:
        try:
            r = compare(spark, n, sf, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}
        ok = r["status"] in ("ok", "rows-only")
        fails += not ok
        print(("PASS " if ok else "FAIL ") + str(r), flush=True)
    print(f"{len(names) - fails}/{len(names)} pass")
