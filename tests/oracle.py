"""Rows of a query and of its SQL, in a form that can be compared."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [cell(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return None if v != v else float(v)
    return str(v)


def rows(df):
    return sorted(repr([cell(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())
