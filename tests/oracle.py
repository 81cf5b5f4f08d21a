"""Compare a query's rows with DuckDB's, as the driver does: columns by name, rows in any order."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, (np.ndarray, list, tuple)):
        return [_plain(x) for x in v]
    if pd.isna(v):
        return None
    if isinstance(v, (float, np.floating)) and float(v).is_integer():
        return int(v)  # pandas makes floats of whole numbers where some are missing
    return v.item() if isinstance(v, np.generic) else v


def _rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr(tuple(map(_plain, r))) for r in df.itertuples(index=False, name=None))


def same_rows(spark, folder, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got, want = _rows(run(spark, folder).toPandas()), _rows(con.sql(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]
