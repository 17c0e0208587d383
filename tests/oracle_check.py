"""Compare registered queries with their SQL: ``python tests/oracle_check.py SF_DIR [query ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = normalised(df.columns, df.collect())
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = normalised(want_columns, cur.fetchall())
    if sorted(df.columns) != sorted(want_columns):
        return f"{name}: columns {sorted(df.columns)} != {sorted(want_columns)}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"{name}: {len(got)} rows vs {len(want)}; extra {extra}; missing {missing}"
    return None


def main() -> int:
    import __spark_entry__ as E
    from tallywell.session import build_session

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, query in E.queries().items():
        if only and name not in only:
            continue
        sql, began = E.oracle_sql().get(name), time.time()
        try:
            problem = compare(spark, con, name, query, sql, sf_dir) if sql else "no SQL"
        except Exception as e:  # noqa: BLE001 - report and go on
            problem = f"{name}: {type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - began:.2f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
