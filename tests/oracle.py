"""Run catalog queries against their SQL in DuckDB: `python tests/oracle.py [-s sf] [name ...]`."""

from __future__ import annotations

import sys
import time
from datetime import date, datetime
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "∅" if value != value else f"{value + 0.0:.6g}" if abs(value) < 1e15 else str(value)
    if isinstance(value, int):
        return f"{float(value):.6g}"
    if isinstance(value, (datetime, date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return str([norm(v) for v in value])
    return str(value)


def exact(value):
    """Value as a strict comparison would see it (full float digits)."""
    if isinstance(value, float):
        return "∅" if value != value else repr(value + 0.0)
    if isinstance(value, int) and not isinstance(value, bool):
        return repr(float(value))
    return norm(value)


def rows_of(columns, rows, f=norm):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f(r[i]) for i in order) for r in rows)


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, fn, sql) -> str:
    """Empty if both sides agree, else what differs."""
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    rel = con.sql(sql)
    want, names = rel.fetchall(), rel.columns
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "no rows"
    odd = [n for n, t in zip(names, rel.types) if str(t).startswith(("DECIMAL", "HUGEINT"))]
    if odd:
        return f"SQL types to cast: {odd}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}"
    if rows_of(df.columns, got, exact) != rows_of(names, want, exact):
        return "equal only to six digits"
    return ""


if __name__ == "__main__":
    from hearthline.catalog import load_all
    from hearthline.session import build_session

    args = sys.argv[1:]
    sf, conf = "0.01", {}
    if args and args[0] == "-s":
        sf, args = args[1], args[2:]
    if args and args[0] == "--hot":
        conf, args = {"spark.hearthline.hotRows": args[1]}, args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **({"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"} | conf))
    con = connect(folder)
    queries, oracle = load_all()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t0 = time.time()
        try:
            message = compare(spark, con, folder, fn, oracle.get(name))
        except Exception as e:  # noqa: BLE001
            message = "ERROR " + str(e)[:700]
        bad += bool(message)
        print(f"{'ok ' if not message else 'BAD'} {time.time() - t0:5.2f}s {'sql ' if name in oracle else 'rows'} {name} {message}", flush=True)
    print("bad:", bad)
