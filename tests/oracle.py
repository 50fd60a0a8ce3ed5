"""Run registered queries and their SQL side by side: ``python -m tests.oracle sf0.01 [keys...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from intakelake.sources.views import RAW


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in RAW:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(norm(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, query, sql) -> str:
    df = query(spark, sf_dir)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows {len(a[1])}"
    cur = con.execute(sql)
    b = rows([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"COLUMNS {a[0]} {b[0]}"
    if a[1] != b[1]:
        sa, sb = set(a[1]), set(b[1])
        return f"DIFF {len(a[1])} {len(b[1])}\n    {a[0]}\n    spark {sorted(sa - sb)[:2]}\n    sql   {sorted(sb - sa)[:2]}"
    return f"ok {len(a[1])}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import session

    sf = f"/root/testdata/{sys.argv[1]}"
    spark, con, oracle = session(), connect(sf), oracle_sql()
    for key, query in queries().items():
        if len(sys.argv) > 2 and not any(key == k or (k.endswith("*") and key.startswith(k[:-1])) for k in sys.argv[2:]):
            continue
        t = time.time()
        try:
            out = compare(spark, con, sf, query, oracle.get(key))
        except Exception as e:  # noqa: BLE001
            out = f"ERROR {type(e).__name__} {str(e)[:700]}"
        print(f"{key}: {out} [{time.time() - t:.1f}s]", flush=True)
