"""Side-by-side run of a registered query in Spark and of its SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    """A value in a form that both engines share. Whole floats and integers stay distinct types."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def kinds(rows: Counter) -> list[set]:
    out: list[set] = []
    for row in rows:
        if not out:
            out = [set() for _ in row]
        for i, v in enumerate(row):
            if v is not None:
                out[i].add(type(v).__name__)
    return out


def compare(query, sql: str, spark, con, folder: str) -> tuple[str, str]:
    """("ok" or "bad", explanation)."""
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return "bad", f"columns {sorted(df.columns)} against {sorted(rel.columns)}"
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return "bad", f"rows {sum(got.values())} against {sum(want.values())}\n  spark only {extra}\n  sql only {missing}"
    if kinds(got) != kinds(want):
        return "bad", f"types {kinds(got)} against {kinds(want)}"
    return "ok", f"{sum(got.values())} rows"


def main() -> None:
    import __spark_entry__ as entry
    from bourselight.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sqls:
                state, why = compare(query, sqls[name], spark, con, folder)
            else:
                state, why = "rows", str(query(spark, folder).count())
        except Exception as error:  # noqa: BLE001 - every query is reported
            state, why = "bad", f"{type(error).__name__}: {str(error)[:700]}"
        bad += state == "bad"
        print(f"{state:4} {name:32} {time.time() - start:6.2f}s {why}", flush=True)
    print("failures", bad)


if __name__ == "__main__":
    main()
