"""Compares registered queries with their SQL in DuckDB: ``python tests/compare.py sf_dir [name...]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(os.listdir(sf_dir)):
        at = f"{sf_dir}/{p}"
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{at if os.path.isfile(at) else at + '/*.parquet'}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    shown = lambda v: "" if v is None or v is pd.NA or v != v else repr(float(v) + 0.0) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)
    df = pd.DataFrame({c: [shown(v) for v in df[c].tolist()] for c in df.columns})
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    got = query(spark, sf_dir).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    a, b = normal(got), normal(want)
    if not a.equals(b):
        odd = (a != b).any(axis=1)
        return f"{int(odd.sum())} of {len(a)} rows differ\n{a[odd].head(3).to_string()}\n{b[odd].head(3).to_string()}"
    return ""


def main() -> int:
    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = session(), connection(sf_dir), 0
    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in names or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        t = time.time()
        try:
            if n in oracles:
                said = differences(spark, con, sf_dir, queries[n], oracles[n])
            else:
                said = "" if queries[n](spark, sf_dir).count() >= 0 else "?"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(said)
        print(f"{'BAD ' if said else 'ok  '} {n} {time.time() - t:.1f}s {'' if n in oracles else '(rows only)'} {said}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
