"""Run registered queries and their SQL side by side: names, row counts, types and values must agree.

    python tests/oracle_check.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(pdf: pd.DataFrame) -> list[str]:
    """Rows as sorted text; integers, floats, times and NULLs keep their own spelling."""
    out = []
    for name in sorted(pdf.columns):
        col = pdf[name]
        if pd.api.types.is_datetime64_any_dtype(col):
            text = col.astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(col):
            text = col.map(str)
        elif pd.api.types.is_float_dtype(col):
            text = col.map(lambda v: "null" if pd.isna(v) else repr(float(v) + 0.0))
        else:
            text = col.map(lambda v: "null" if v is None or v is pd.NaT or v != v else str(v))
        out.append(text.where(~col.isna(), "null").tolist())
    return sorted("|".join(r) for r in zip(*out)) if out else []


def compare(spark, con, key: str, query, statement: str, sf_dir: str) -> str:
    """Empty when both agree, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(statement).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    kinds = {
        c: (got[c].dtype.kind, want[c].dtype.kind)
        for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and "O" not in (got[c].dtype.kind, want[c].dtype.kind)
    }
    if kinds:
        return f"types {kinds}"
    a, b = canonical(got), canonical(want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(diff)} rows differ, e.g. {diff[:2]}"
    return ""


def main() -> int:
    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, every, statements = connect(sf_dir), queries(), oracle_sql()
    failed = []
    for key in sys.argv[2:] or every:
        t0 = time.time()
        try:
            if key in statements:
                problem = compare(spark, con, key, every[key], statements[key], sf_dir)
                note = problem or "ok"
            else:
                problem, note = "", f"rows only: {every[key](spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            problem = note = f"{type(exc).__name__}: {str(exc)[:600]}"
        print(f"{key:28s} {time.time() - t0:6.2f}s  {note}", flush=True)
        if problem:
            failed.append(key)
    print(f"{len(failed)} failed {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
