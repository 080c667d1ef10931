"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(_plain(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    kinds = {d[0]: str(d[1]) for d in res.description}
    want = rows_of(cols, res.fetchall())
    t2 = time.time()
    timing = f"spark {t1 - t0:.1f}s duckdb {t2 - t1:.1f}s"
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", timing
    spark_kinds = dict(df.dtypes)
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    off = [
        (c, spark_kinds[c], kinds[c])
        for c in cols
        if alias.get(spark_kinds[c]) != kinds[c] and not (kinds[c] in ("NUMBER", "STRING", "bool"))
    ]
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", timing
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g.\n  {bad[0][0]}\n  {bad[0][1]}", timing
    return (f"types {off}" if off else None), timing


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if names and name not in names:
            continue
        try:
            if name not in sqls:
                t = time.time()
                n = len(fn(spark, sf_dir).collect())
                print(f"{name}: rows {n} {time.time() - t:.1f}s", flush=True)
                continue
            diff, timing = compare(spark, con, name, fn, sqls[name], sf_dir)
            print(f"{name}: {'ok' if diff is None else 'DIFF ' + diff} ({timing})", flush=True)
        except Exception as e:  # noqa: BLE001 - a report, not a test
            print(f"{name}: ERROR {type(e).__name__} {str(e)[:600]}", flush=True)
