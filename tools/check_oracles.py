"""Run registered queries and their DuckDB twins side by side; report matches.

usage: python tools/check_oracles.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

from driftkit.sources.tables import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    res = {"name": name, "spark_rows": len(sp), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        res["oracle"] = "none"
        return res
    dk = con.sql(sql).df()
    res["oracle_rows"] = len(dk)
    res["cols_match"] = sorted(sp.columns) == sorted(dk.columns)
    if not res["cols_match"]:
        res["only_spark"] = sorted(set(sp.columns) - set(dk.columns))
        res["only_oracle"] = sorted(set(dk.columns) - set(sp.columns))
        return res
    a, b = canon(sp), canon(dk)
    res["values_match"] = a == b
    if not res["values_match"]:
        for i, (x, y) in enumerate(zip(a, b)):
            if x != y:
                cols = sorted(sp.columns)
                res["first_diff"] = {c: (u, v) for c, u, v in zip(cols, x, y) if u != v}
                break
    return res


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    from driftkit.plans import registry
    from driftkit.session import build_session

    spark = build_session()
    con = duck(sf_dir)
    qs, os_ = registry.queries(), registry.oracles()
    bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, name, fn, os_.get(name), sf_dir, con)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "error": f"{type(e).__name__}: {str(e)[:500]}"}
        ok = r.get("values_match") or r.get("oracle") == "none"
        bad += not ok
        print(json.dumps(r, default=str), flush=True)
    print(f"FAILED {bad}")


if __name__ == "__main__":
    main()
