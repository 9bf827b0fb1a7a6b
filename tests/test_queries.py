"""Every core query with SQL against DuckDB on the smallest tables; the others must run."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import catalog


def canonical(frame):
    def text(v):
        if pd.isna(v):
            return "null"
        if isinstance(v, str):
            return v
        if hasattr(v, "isoformat"):
            return str(v)[:26].replace(" 00:00:00", "").replace("+00:00", "")
        if isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
            return str(bool(v))
        f = float(v)
        return str(int(f)) if math.isfinite(f) and f == int(f) else f"{f:.5f}"

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(text(v) for v in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, data, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, data).toPandas(), duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_centres_half_way_are_rounded_as_in_sql(spark, data, duck):
    """All digits of the centres: means of few decimals lie half way, whatever the order of their sum."""
    from tidemark.plans.reference import bins

    noise = spark.createDataFrame([("a", [0.5], [0.02616249999999999, -0.043587499999999994, 0.026162500000000003])], "k string, edges array<double>, centres array<double>")
    assert [r.centre for r in bins(noise, "k", 7, 6).orderBy("bin").collect()] == [0.026163, -0.043588, 0.026163]
    ours = {(str(r.day), r.bin): r.centre for r in catalog.QUERIES["rolling_gpd_bins"](spark, data).collect()}
    theirs = {(str(r[0])[:10], r[1]): r[3] for r in duck.execute(catalog.SQL["rolling_gpd_bins"]).fetchall()}
    assert ours.keys() == theirs.keys() and all(abs(ours[k] - theirs[k]) < 1e-9 for k in theirs)
