"""Every registered document query against its SQL."""

import math

import pytest

from docloom.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or type(x).__name__ in ("NAType", "NaTType"):
            return None
        x = x.item() if hasattr(x, "item") else x
        return round(x, 6) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=repr)


def same(a, b):
    return a[0] == b[0] and len(a[1]) == len(b[1]) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and x == y) for p, q in zip(a[1], b[1], strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, D).toPandas().convert_dtypes(convert_floating=False)
    if name not in SQL:
        assert len(got)
        return
    assert same(rows(got), rows(duck.execute(SQL[name]).df().convert_dtypes(convert_floating=False)))
