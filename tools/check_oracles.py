"""Run registered queries and their SQL side by side and report differences.

usage: python tools/check_oracles.py FOLDER [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from corpusmill.session import get_session  # noqa: E402
from queryset import ORACLES, QUERIES  # noqa: E402


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(value(row[i]) for i in order) for row in rows)


def main():
    folder, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = get_session("check", spark__ui__showConsoleProgress="false")
    duck = duckdb.connect()
    for file in sorted(os.listdir(folder)):
        name = file.removesuffix(".parquet")
        duck.execute(f"create view {name} as select * from '{folder}/{file}'")
    bad = 0
    for name, query in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            mine = [tuple(r) for r in df.collect()]
        except Exception as error:
            print(f"ERROR {name}: {str(error)[:700]}", flush=True)
            bad += 1
            continue
        spent = time.time() - start
        if name not in ORACLES:
            print(f"rows  {name} {len(mine)} {spent:.1f}s", flush=True)
            continue
        try:
            start = time.time()
            result = duck.execute(ORACLES[name])
            theirs_columns = [d[0] for d in result.description]
            theirs = result.fetchall()
        except Exception as error:
            print(f"SQLERR {name}: {str(error)[:500]}", flush=True)
            bad += 1
            continue
        a, b = canonical(mine, df.columns), canonical(theirs, theirs_columns)
        same = sorted(df.columns) == sorted(theirs_columns) and a == b
        print(f"{'ok   ' if same else 'DIFF '} {name} {len(a)}/{len(b)} {spent:.1f}s sql {time.time() - start:.1f}s", flush=True)
        if not same:
            bad += 1
            print("   columns", sorted(df.columns), sorted(theirs_columns))
            left, right = set(a) - set(b), set(b) - set(a)
            print("   only spark", sorted(left)[:3], "\n   only sql  ", sorted(right)[:3], flush=True)
    print("differences:", bad)


main()
