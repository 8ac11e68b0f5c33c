"""Every query with SQL gives the rows of its SQL on the smallest data."""

import glob
import math
import os

import pytest

import __spark_entry__

duckdb = pytest.importorskip("duckdb")
#: One query of each family here; the driver compares all.
SOME = ["p1_found", "bout_metrics", "interp_and_flat_hold", "turned_away_windows", "pairwise_distance", "approach_avoid", "mannwhitney_ks_cliff", "label_agreement", "silhouette_squared", "fuzzy_pairing"]


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 5) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)


@pytest.mark.parametrize("name", SOME)
def test_rows_are_those_of_the_sql(spark, data, name):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    cols = sorted(c[0] for c in want.description)
    w = want.fetchall()
    order = [[c[0] for c in want.description].index(c) for c in cols]
    got = __spark_entry__.queries()[name](spark, data)
    assert sorted(got.columns) == cols
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(plain(x) for x in r) for r in got.select(*cols).collect()), key=key)
    b = sorted((tuple(plain(r[i]) for i in order) for r in w), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, abs_tol=2e-4) for p, q in zip(x, y, strict=True)), (x, y)


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark, data):
    assert __spark_entry__.entry(spark).count() > 0
