"""Run every registered query beside its SQL and compare rows.

Usage: python tools/check_oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from rolegrid.catalog import ORACLES, QUERIES  # noqa: E402
from rolegrid.session import TABLES, local_session  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(norm(r[i]) for i in order) for r in data], key=repr)


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = sys.argv[2:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            got = rows_of(df.columns, df.collect())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: spark: {str(e)[:600]}")
            continue
        took = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name}: {len(got)} rows {took:.1f}s")
            continue
        try:
            cur = con.execute(ORACLES[name])
            cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = rows_of(cols, cur.fetchall())
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL  {name}: duckdb: {str(e)[:600]}")
            continue
        sd = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        odd = {c: (sd.get(c), types.get(c)) for c in set(sd) | set(types)
               if {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "int": "INTEGER"}.get(sd.get(c)) != types.get(c)}
        if got != want:
            bad += 1
            print(f"DIFF  {name}: spark {len(got)} duckdb {len(want)} types {odd}")
            only = [r for r in got if r not in set(want)][:3] if len(got) < 200000 else []
            other = [r for r in want if r not in set(got)][:3] if len(got) < 200000 else []
            print("   cols", sorted(df.columns))
            for r in only:
                print("   spark ", str(r)[:500])
            for r in other:
                print("   duckdb", str(r)[:500])
        else:
            print(f"ok    {name}: {len(got)} rows {took:.1f}s" + (f"  TYPES {odd}" if odd else "") + ("  EMPTY" if not got else ""))
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
