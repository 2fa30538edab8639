"""Run registered queries and their SQL twins side by side: python tests/compare.py [sf] [names...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v) if isinstance(v, datetime.date) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, con, folder, name, query, sql):
    df = query(spark, folder)
    left = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = canonical([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if not left[1]:
        return "no rows"
    return f"{len(wrong)} of {len(left[1])} differ: {wrong[:2]}" if wrong else None


def main():
    import __spark_entry__ as entry
    from procura.session import local_session

    folder = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    plain_session = os.environ.get("PLAIN")  # Spark's own defaults, as a caller may bring them
    spark = SparkSession.builder.master("local[8]").getOrCreate() if plain_session else local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, queries = connect(folder), entry.oracle_sql(), entry.queries()
    bad = 0
    for name in sys.argv[2:] or queries:
        start = time.time()
        try:
            if name in sqls:
                fault = compare(spark, con, folder, name, queries[name], sqls[name])
            else:
                n = queries[name](spark, folder).count()
                fault = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += fault is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok  ' if fault is None else 'FAIL'} {kind:4} {name} {time.time() - start:.1f}s {fault or ''}"[:2500], flush=True)
    print(f"{bad} failures; SQL without query: {sorted(set(sqls) - set(queries))}")


if __name__ == "__main__":
    main()
