"""Run registered queries against their SQL and report every difference.

    python tests/compare.py sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, name: str, sf: str) -> str | None:
    """None when the query and its SQL give the same rows."""
    from __spark_entry__ import oracle_sql, queries

    QUERIES, ORACLES = queries(), oracle_sql()
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None if got else "no rows"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    want = rows_of(names, cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    odd = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(odd)} of {len(got)} rows differ: {odd[:3]}" if odd else None


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{cores}]").appName("holdfast-tests") \
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false") \
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC") \
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from __spark_entry__ import oracle_sql, queries

    QUERIES, ORACLES = queries(), oracle_sql()

    sf, wanted = f"{DATA}/{sys.argv[1]}", sys.argv[2:] or list(QUERIES)
    spark, con = session(), duck(f"{DATA}/{sys.argv[1]}")
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            problem = difference(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'ok  ' if problem is None else 'BAD '} {kind} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")


if __name__ == "__main__":
    main()
