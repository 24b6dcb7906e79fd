"""Compare registered queries with their SQL on DuckDB.

    python tests/check_oracle.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def family(name: str) -> str:
    name = name.lower()
    if name.startswith("decimal"):
        return name
    return {
        "tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int",
        "long": "int", "double": "double", "float": "double", "varchar": "string", "string": "string",
        "boolean": "boolean",
    }.get(name, name)


def cell(v):
    if v is None:
        return ("", 0)
    if isinstance(v, float):
        return ("nan", 0) if math.isnan(v) else ("f", 0.0 if v == 0 else v)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("f", v)
    return ("s", str(v))


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows))


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, name, fn, sql, folder):
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(got), None
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = res.fetchall()
    types = {r[0]: family(str(r[1])) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    mine = {n: family(t) for n, t in df.dtypes}
    if sorted(mine) != sorted(types):
        return len(got), f"columns {sorted(mine)} vs {sorted(types)}"
    bad = {c: (mine[c], types[c]) for c in mine if mine[c] != types[c]}
    if bad:
        return len(got), f"types {bad}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return len(got), f"{len(a)} rows vs {len(b)}; first differences {diff}"
    return len(got), None


def main():
    import __spark_entry__ as entry
    from tidemark import session

    args = sys.argv[1:]
    folder = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = session.build("local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="12g",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    failed, none, slow = [], [], []
    for name, fn in qs.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            n, err = compare(spark, con, name, fn, sqls.get(name), folder)
        except Exception as e:  # noqa: BLE001
            n, err = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        took = time.time() - t
        slow.append((took, name))
        note = "rows only" if name not in sqls else ""
        if err:
            failed.append(name)
            print(f"FAIL {name} {took:.1f}s {err}", flush=True)
        else:
            if n == 0:
                none.append(name)
            if "-v" in os.environ.get("CHECK", "") or n == 0 or note:
                print(f"ok   {name} {took:.1f}s rows={n} {note}", flush=True)
    print(f"{len(slow)} run, {len(failed)} failed: {failed}; empty: {none}")
    print("slowest", [(round(t, 1), n) for t, n in sorted(slow, reverse=True)[:12]])


if __name__ == "__main__":
    main()
