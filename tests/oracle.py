"""Compare a registered query with its DuckDB SQL on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}'")
    return con.sql(sql).df()


def normal(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    def text(v) -> str:
        if pd.isna(v):
            return "NULL"
        return repr(float(v)) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)

    return sorted("|".join(map(text, row)) for row in df.astype(object).itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = spark_df.toPandas(), expected(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = normal(got), normal(want)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:5]
