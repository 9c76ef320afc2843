"""Run registered queries beside their SQL in DuckDB and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, query, oracle):
    started = time.time()
    df = query(spark, sf_dir)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    got = rows_of(df.columns, got_rows)
    if oracle is None:
        return True, f"{len(got_rows)} rows (no SQL)", spent
    cur = con.execute(oracle)
    columns = [c[0] for c in cur.description]
    want = rows_of(columns, cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", spent
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        lost = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"{len(got[1])} vs {len(want[1])} rows\n   columns {got[0]}\n   spark only {extra}\n   sql only {lost}", spent
    return True, f"{len(got_rows)} rows", spent


def main():
    sys.path.insert(0, "/root/repo")
    from assetflow.plans.registry import REGISTRY
    from assetflow.session import build_session

    sf_dir = sys.argv[1]
    names = sys.argv[2:] or list(REGISTRY)
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note, spent = compare(spark, con, sf_dir, name, *REGISTRY[name])
        except Exception as exc:  # report and go on to the next query
            ok, note, spent = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0
        bad += not ok
        print(("ok  " if ok else "BAD ") + f"{name} {spent:.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
