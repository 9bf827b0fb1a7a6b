import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.trailing import daily_totals, trailing


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "e string, d int, v double, day string, bucket int")
    out = trailing(daily_totals(df, "e", F.col("d"), {"v": F.col("v")}), ["v"], (7, 30), **how)
    return {(r.entity, r.day): r for r in out.collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(e, int(d), float(rng.normal()) if rng.random() > 0.1 else (None if rng.random() < 0.5 else float("nan")), "x", 1) for e in "ab" for d in sorted(rng.choice(np.arange(-40, 160), 60))]
    got = run(spark, rows)
    for e in "ab":
        own = [(d, v) for x, d, v, *_ in rows if x == e]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own)
        assert {d for x, d in got if x == e} == set(range(lo + 29, hi + 1))
        for d in range(lo + 29, hi + 1):
            for p in (7, 30):
                inside = [v for x, v in own if d - p < x <= d and v is not None and not math.isnan(v)]
                r = got[e, d]
                assert r[f"v_total_{p}"] == pytest.approx(sum(inside), abs=1e-9) and r[f"v_n_{p}"] == len(inside)
                assert r[f"v_avg_{p}"] == (pytest.approx(sum(inside) / len(inside)) if inside else None)


def test_edges(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, 1, 1.0, "", 1), ("a", None, 1.0, "", 1)]) == {}
    assert run(spark, [("a", 1, 1.0, "", 1), ("a", 29, 1.0, "", 1)]) == {}
    assert list(run(spark, [("a", 1, 1.0, "", 1), ("a", 30, 1.0, "", 1)])) == [("a", 30)]
    assert len(run(spark, [("a", 1, 1.0, "", 1), ("a", 30, 1.0, "", 1)], warm_up=0)) == 30
    twice = run(spark, [("a", 5, 1.0, "", 1), ("a", 5, 1.0, "", 1)], warm_up=0)
    assert twice["a", 5].v_total_7 == 2.0
