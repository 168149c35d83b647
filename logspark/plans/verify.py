"""Local twin of the driver's correctness gate.

Runs each registered Spark query and its DuckDB SQL on the same parquet
directory and compares row count, column names and order-insensitive
values.  Usage: ``python -m logspark.plans.verify [sf_dir] [name ...]``.
"""

from __future__ import annotations

import datetime as _dt
import decimal
import json
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [_norm(x) for x in v]
    if isinstance(v, dict):
        return {k: _norm(x) for k, x in sorted(v.items())}
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [json.dumps([_norm(r[i]) for i in order], default=str, sort_keys=True) for r in rows]
    return [cols[i] for i in order], sorted(out)


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def check(spark, sf_dir: str, names=None) -> dict:
    sys.path.insert(0, ".")
    from logspark.plans.catalog import REGISTRY

    con = duck_connection(sf_dir)
    results = {}
    for r in REGISTRY:
        if names and r.name not in names:
            continue
        t0 = time.time()
        try:
            df = r.build(spark, sf_dir)
            srows = [tuple(x) for x in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[r.name] = {"ok": False, "error": f"spark: {type(e).__name__}: {str(e)[:400]}"}
            continue
        ts = time.time() - t0
        if r.sql is None:
            results[r.name] = {"ok": True, "rows": len(srows), "oracle": "rows-only", "spark_s": round(ts, 2)}
            continue
        try:
            cur = con.execute(r.sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[r.name] = {"ok": False, "error": f"duckdb: {type(e).__name__}: {str(e)[:400]}"}
            continue
        sc, sv = _canon(scols, srows)
        dc, dv = _canon(dcols, drows)
        ok = sc == dc and sv == dv
        res = {"ok": ok, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(ts, 2)}
        if not ok:
            if sc != dc:
                res["columns"] = {"spark": sc, "oracle": dc}
            else:
                only_s = sorted(set(sv) - set(dv))[:3]
                only_d = sorted(set(dv) - set(sv))[:3]
                res["diff"] = {"spark_only": only_s, "oracle_only": only_d}
        results[r.name] = res
    return results


def main(argv):
    sys.path.insert(0, ".")
    from logspark.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = set(argv[2:]) or None
    spark = local_session()
    res = check(spark, sf_dir, names)
    bad = 0
    for name, r in res.items():
        flag = "OK " if r["ok"] else "BAD"
        bad += not r["ok"]
        print(flag, name, json.dumps({k: v for k, v in r.items() if k != "ok"}, default=str)[:1500])
    print(f"{len(res) - bad}/{len(res)} ok")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
