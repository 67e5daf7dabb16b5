"""Run registered jobs next to their SQL and compare all rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> tuple[bool, str]:
    start = time.time()
    frame = query(spark, sf_dir)
    columns = frame.columns
    mine = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    start = time.time()
    result = con.execute(sql)
    theirs_columns = [d[0] for d in result.description]
    theirs = result.fetchall()
    note = f"{name:24s} rows={len(mine)} spark={took:.2f}s duck={time.time() - start:.2f}s"
    if sorted(columns) != sorted(theirs_columns):
        return False, f"{note} columns {sorted(columns)} != {sorted(theirs_columns)}"
    a, b = _rows(columns, mine), _rows(theirs_columns, theirs)
    if len(a) != len(b):
        return False, f"{note} row counts {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        return False, f"{note} {len(wrong)} rows differ, first {str(wrong[0][0])[:700]}\n   != {str(wrong[0][1])[:700]}"
    return True, note


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tests.session import make_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
    spark = make_session()
    con = connect(sf_dir)
    sqls, bad = oracle_sql(), 0
    for name, query in queries().items():
        if argv and name not in argv:
            continue
        try:
            if name in sqls:
                ok, note = compare(spark, con, sf_dir, name, query, sqls[name])
            else:
                start = time.time()
                rows = query(spark, sf_dir).collect()
                ok, note = True, f"{name:24s} rows={len(rows)} spark={time.time() - start:.2f}s (no SQL)"
        except Exception as error:  # report and go on to the next job
            ok, note = False, f"{name:24s} {type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "FAIL", note, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
