"""Side-by-side comparison of a registered query with its SQL twin on the same files."""

import glob
import math
import os
import time

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _value(value):
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, sql, folder):
    started = time.time()
    df = query(spark, folder)
    found = df.collect()
    seconds = time.time() - started
    got = rows_of(df.columns, found)
    if sql is None:
        return f"ROWS {name} {len(found)} rows {seconds:.1f}s", True
    cursor = con.execute(sql)
    want = rows_of([column[0] for column in cursor.description], cursor.fetchall())
    if got == want:
        return f"OK   {name} {len(found)} rows {seconds:.1f}s", True
    detail = f"columns {got[0]} / {want[0]}" if got[0] != want[0] else (
        f"rows {len(got[1])} / {len(want[1])}; only here {[r for r in got[1] if r not in set(want[1])][:3]};"
        f" only in SQL {[r for r in want[1] if r not in set(got[1])][:3]}")
    return f"DIFF {name} {seconds:.1f}s {detail}", False


if __name__ == "__main__":
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from lorespark.session import local_session
    import __spark_entry__ as entry

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("oracle", cores=8), connect(folder)
    wanted = sys.argv[1:]
    failed = 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(prefix) for prefix in wanted):
            continue
        try:
            text, good = compare(spark, con, name, query, entry.oracle_sql().get(name), folder)
        except Exception as error:  # report every query, then fail at the end
            text, good = f"FAIL {name} {type(error).__name__}: {str(error)[:600]}", False
        failed += not good
        print(text, flush=True)
    print("failed", failed)
