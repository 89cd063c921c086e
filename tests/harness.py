"""Compares registered queries with their DuckDB SQL: same columns, same rows in any order, floats to nine digits."""

import glob
import math
import os


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    import pandas as pd

    whole = lambda v: isinstance(v, float) and math.isfinite(v) and v == int(v)  # noqa: E731  pandas widens nullable integers
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v)) if whole(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, sf_dir, query, sql):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns), (list(got.columns), list(want.columns))
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
    return len(a)
