import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.regrid import GridConfig, epoch_seconds, regular_grid, session_minute, solve_normal

SCHEMA = "source string, day int, slot int, at double, y double, volume double, value string"


def grid(spark, rows, config=GridConfig()):
    out = regular_grid(spark.createDataFrame(rows, SCHEMA), config).collect()
    return {(r.source, r.day, r.slot): r for r in out}


def test_units_and_session(spark):
    at = [1073295001.5, 1073295001.5e3, 1073295001.5e6, 1073295001.5e9]
    rows = spark.createDataFrame([(x,) for x in at], "t double").select(epoch_seconds(F.col("t")).alias("s"))
    assert [r.s for r in rows.collect()] == pytest.approx([1073295001.5] * 4)
    cases = {"09:29": None, "09:30": 0, "11:29": 119, "11:30": None, "12:59": None, "13:00": 120, "14:59": 239, "15:00": None}
    seconds = [(k, (int(k[:2]) * 60 + int(k[3:])) * 60.0 + 59.9 + 86400 * 12345) for k in cases]
    got = {r.k: r.m for r in spark.createDataFrame(seconds, "k string, s double").select("k", session_minute(F.col("s")).alias("m")).collect()}
    assert got == cases


def test_readings_stay_and_gaps_are_bridged(spark):
    c = GridConfig(slots=8, harmonics=1)
    rows = [("a", 1, 2, 1.0, 10.0, 5.0, "x"), ("a", 1, 2, 2.0, 11.0, 5.0, "x"), ("a", 1, 6, 3.0, 13.0, None, "x"), ("a", 2, 0, 1.0, 12.0, 1.0, "x")]
    got = grid(spark, rows, c)
    assert len(got) == 16 and not got["a", 1, 2].filled and got["a", 1, 2].value == 11.0 and got["a", 1, 2].n_readings == 2 and got["a", 1, 2].volume == 10.0
    assert got["a", 1, 4].filled and got["a", 1, 4].volume == 0.0
    assert all(np.isfinite(r.value) for r in got.values())


def test_a_fitted_pattern_is_predicted(spark):
    c = GridConfig(slots=24, harmonics=2, ridge=1e-6)
    truth = lambda d, s: 3 + 0.1 * (d + s / 24) + np.sin(2 * np.pi * s / 24)
    rng = np.random.default_rng(1)
    rows = [("a", d, s, float(s), float(truth(d, s)), 1.0, "") for d in range(30) for s in range(24) if rng.random() < 0.4]
    got = grid(spark, rows, c)
    assert max(abs(r.value - truth(d, s)) for (_, d, s), r in got.items()) < 1e-3


def test_normal_equations_match_least_squares():
    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(200), rng.normal(120, 0.5, 200), rng.normal(size=(200, 2))])
    y = rng.normal(size=200)
    xx, xy = x.T @ x, x.T @ y
    sums = np.concatenate([xx[np.triu_indices(4)], xy])[None, :]
    assert np.allclose(solve_normal(sums, 4, 1e-9)[0], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-5)


def test_nulls_repeats_and_empty(spark):
    assert grid(spark, []) == {}
    bad = [(None, 1, 1, 1.0, 1.0, 1.0, ""), ("a", None, 1, 1.0, 1.0, 1.0, ""), ("a", 1, None, 1.0, 1.0, 1.0, ""), ("a", 1, 1, 1.0, None, 1.0, ""), ("a", 1, 240, 1.0, 1.0, 1.0, ""), ("a", 1, 1, 1.0, float("nan"), 1.0, "")]
    assert grid(spark, bad) == {}
    one = grid(spark, [("a", 1, 5, 1.0, 7.0, None, "")])
    assert len(one) == 240 and all(abs(r.value - 7.0) < 1e-6 for r in one.values())
    tied = grid(spark, [("a", 1, 5, 1.0, 7.0, 1.0, ""), ("a", 1, 5, 1.0, 9.0, 1.0, "")])
    assert tied["a", 1, 5].value == 9.0


def test_whole_table(spark, data):
    from tidemark.plans.problems import p2_grid

    out = p2_grid(spark, data).toPandas()
    assert (out.groupby(["sid", "day"]).size() == 240).all() and out.close.gt(0).all()
