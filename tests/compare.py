"""Runs queries against their oracles, as the driver does."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def one(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return None
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted((tuple(one(x) for x in r) for r in df.itertuples(index=False)), key=str)


def difference(spark, con, run, sql: str, sf_dir: str) -> str:
    a, b = run(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} {sorted(b.columns)}"
    x, y = canonical(a), canonical(b)
    if x == y:
        return ""
    return f"{len(x)} and {len(y)} rows; {[r for r in x if r not in set(y)][:2]} / {[r for r in y if r not in set(x)][:2]}"
