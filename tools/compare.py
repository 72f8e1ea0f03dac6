"""Run registered queries against their DuckDB twins and report differences.

Usage: python tools/compare.py [sf folder] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fleetgrain.catalog.index import all_entries  # noqa: E402
from fleetgrain.session import build_session  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(row[i] for i in order) for row in rows], key=repr)


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    con = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{folder}/{file}'")
    spark = build_session(app="compare")
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for entry in all_entries():
        if wanted and not any(entry.name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            df = entry.run(spark, folder)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
            took = time.time() - started
            if entry.sql is None:
                print(f"rows  {entry.name} rows={len(got)} {took:.1f}s", flush=True)
                continue
            result = con.execute(entry.oracle())
            names = [d[0] for d in result.description]
            want = canonical(result.fetchall(), names)
            same = got == want and sorted(names) == sorted(df.columns)
            print(f"{'ok   ' if same else 'DIFF '} {entry.name} rows={len(got)}/{len(want)} {took:.1f}s", flush=True)
            if not same:
                bad += 1
                missing = [w for w in want if w not in set(got)][:3]
                extra = [g for g in got if g not in set(want)][:3]
                print("   columns", sorted(df.columns), "\n   only sql  ", missing, "\n   only spark", extra)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"ERROR {entry.name}: {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
