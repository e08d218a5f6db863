"""Run registered queries beside their comparison text: ``python tests/check.py [sf] [prefix...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from cuewright.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


SPARK_KINDS = {"bigint": "int", "int": "int", "double": "float", "string": "text", "boolean": "bool", "date": "date", "timestamp": "time", "timestamp_ntz": "time"}
DUCK_KINDS = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "text", "BOOLEAN": "bool", "DATE": "date", "TIMESTAMP": "time"}


def _plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((repr(tuple(_plain(r[i]) for i in order)) for r in rows))


def compare(spark, con, name, run, sql, sf_dir):
    t = time.time()
    df = run(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return len(got) > 0, f"rows={len(got)} (no text) {took:.1f}s"
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    kinds = {r[0]: r[1] for r in con.execute("describe " + sql).fetchall()}
    odd = [(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema if SPARK_KINDS.get(f.dataType.simpleString()) != DUCK_KINDS.get(kinds[f.name])]
    if odd:
        return False, f"types {odd}"
    if got != want:
        extra = [r for r in set(got) - set(want)][:3]
        missing = [r for r in set(want) - set(got)][:3]
        return False, f"rows {len(got)} vs {len(want)}; extra {sorted(extra)}; missing {sorted(missing)}"
    return True, f"rows={len(got)} {took:.1f}s"


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(folder), []
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, note = compare(spark, con, name, run, sqls.get(name), folder)
        except Exception as err:  # noqa: BLE001
            ok, note = False, f"{type(err).__name__}: {str(err)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(len(bad), "failing:", bad)
