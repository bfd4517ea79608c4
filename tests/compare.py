"""Run registered queries beside their SQL and compare results row by row.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _text(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(round(float(v), 6) + 0.0) if not isinstance(v, (bool,)) and str(getattr(v, "dtype", "")) != "bool" else str(bool(v))
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    return str(v)


def rows(columns, data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_text(r[i]) for i in order) for r in data)


def compare(spark_df, con, sql) -> str:
    """'' when equal, otherwise what differs."""
    left = spark_df.collect()
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    right = cur.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    if len(left) != len(right):
        return f"rows {len(left)} / {len(right)}"
    a, b = rows(spark_df.columns, left), rows(names, right)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(names)} {bad[0][0]} / {bad[0][1]}"
    kinds = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    odd = [f"{c[0]}:{kinds[c[0]]}/{c[1]}" for c in cur.description
           if _KINDS.get(kinds[c[0]], kinds[c[0]]) != str(c[1]).upper()]
    return f"(types {' '.join(odd)})" if odd else ""


_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


if __name__ == "__main__":
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    folder = sys.argv[1]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    sqls, qs = entry.oracle_sql(), entry.queries()
    names = sys.argv[2:] or list(qs)
    failed = 0
    for name in names:
        t = time.time()
        try:
            if name in sqls:
                found = compare(qs[name](spark, folder), con, sqls[name])
            else:
                found = f"(no SQL, {len(qs[name](spark, folder).collect())} rows)"
        except Exception as e:  # noqa: BLE001
            found = "ERROR " + str(e)[:600].replace("\n", " ")
        ok = not found or found.startswith("(")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} {time.time() - t:6.2f}s {found}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
