"""Run registered queries next to their SQL on DuckDB and compare whole results.

usage: python tools/check_queries.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from seriesloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, decimal.Decimal)):
        v = float(v)
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.9g}".replace("-0", "-0") if v else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def kind(name):
    name = name.lower()
    for k, group in {"int": ("bigint", "integer", "int", "smallint", "hugeint"), "float": ("double", "float"),
                     "text": ("string", "varchar"), "time": ("timestamp", "timestamp_ntz"),
                     "bool": ("boolean",)}.items():
        if name in group:
            return k
    return name


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from seriesloom.catalog import ORACLES, QUERIES

    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = []
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        started = time.time()
        try:
            df = fn(spark, args.sf)
            rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: spark: {type(e).__name__} {str(e)[:500]}", flush=True)
            continue
        took = time.time() - started
        if name not in ORACLES:
            print(f"rows  {name}: {len(rows)} rows {took:.1f}s", flush=True)
            if not rows:
                bad.append(name)
            continue
        try:
            started = time.time()
            rel = con.sql(ORACLES[name])
            other_cols = sorted(rel.columns)
            types = dict(zip(rel.columns, map(str, rel.types)))
            got = rel.fetchall()
            order = [rel.columns.index(c) for c in other_cols]
            other = [tuple(r[i] for i in order) for r in got]
            sql_took = time.time() - started
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: duckdb: {str(e)[:1500]}", flush=True)
            continue
        problems = []
        if sorted(df.columns) != other_cols:
            problems.append(f"columns {sorted(df.columns)} vs {other_cols}")
        else:
            for f in df.schema.fields:
                if kind(f.dataType.simpleString()) != kind(types[f.name]):
                    problems.append(f"type of {f.name}: {f.dataType.simpleString()} vs {types[f.name]}")
        a = sorted(tuple(map(norm, r)) for r in rows)
        b = sorted(tuple(map(norm, r)) for r in other)
        if len(a) != len(b):
            problems.append(f"rows {len(a)} vs {len(b)}")
        elif a != b:
            wrong = [(x, y) for x, y in zip(a, b) if x != y]
            problems.append(f"{len(wrong)} of {len(a)} rows differ; first {wrong[0]}")
        if not rows:
            problems.append("no rows")
        if problems:
            bad.append(name)
            print(f"FAIL  {name}: " + "; ".join(problems), flush=True)
        else:
            print(f"ok    {name}: {len(rows)} rows {took:.1f}s (sql {sql_took:.1f}s)", flush=True)
    print(f"{len(bad)} bad: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
