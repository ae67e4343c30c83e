"""Compare registered queries with their SQL: python tests/compare.py [sf dir] [name ...]"""

from __future__ import annotations

import math
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in data), sorted(names)


def compare(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    if got[1] != want[1]:
        return f"columns {got[1]} instead of {want[1]}"
    if got[0] != want[0]:
        extra = [r for r in got[0] if r not in set(want[0])][:2]
        missing = [r for r in want[0] if r not in set(got[0])][:2]
        return f"{len(got[0])} rows, {len(want[0])} wanted; only here {extra}, only there {missing}"
    return ""


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args[1:] or [n for n in queries if n in sql]:
        try:
            why = compare(spark, con, sf_dir, queries[name], sql[name])
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(why)
        if why:
            print("BAD", name, why, flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(sys.argv[1:]))
