"""Compares the registered queries with their SQL in DuckDB.

    python tests/compare.py [folder] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value, digits: int):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.{digits}g}")
    if isinstance(value, (int, str)):
        return float(value) if isinstance(value, int) else value
    return str(value)


DIGITS = int(os.environ.get("COMPARE_DIGITS", "9"))


def rows(columns, data, digits: int = DIGITS):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i], digits) for i in place) for r in data]
    return sorted(columns), sorted(out, key=repr)


def difference(spark, con, run, sql, folder) -> str | None:
    df = run(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"columns {set(got[0]) ^ set(want[0])}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        names = [n for n, a, b in zip(got[0], *wrong[0]) if a != b]
        return f"{len(wrong)} rows differ, first in {names}: {wrong[0]}"[:600]
    return None


def main() -> None:
    import __spark_entry__ as entry
    from logrisk.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    wanted = sys.argv[2:] or list(entry.queries())
    for name in wanted:
        start = time.time()
        try:
            if name in sql:
                bad = difference(spark, con, entry.queries()[name], sql[name], folder)
                note = bad or "ok"
            else:
                note = f"rows only: {entry.queries()[name](spark, folder).count()}"
        except Exception as error:  # noqa: BLE001
            note = f"ERROR {str(error)[:700]}"
        print(f"{name:24} {time.time() - start:6.1f}s  {note}", flush=True)


if __name__ == "__main__":
    main()
