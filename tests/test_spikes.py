import numpy as np
from pyspark.sql import functions as F

from tidemark.kernels.wavelet import group_median, neighbours, runs
from tidemark.operators.spikes import SpikeConfig, implausible_readings

SCHEMA = "sid string, day int, open double, high double, low double, close double, volume double, amount double, _b int, _own string"


def series(sid="a", n=200, seed=0, start=20200000):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = []
    for i, c in enumerate(close):
        o = c * (1 + rng.normal(0, 0.002))
        h, lo = max(o, c) * 1.004, min(o, c) * 0.996
        v = float(rng.integers(1000, 9000))
        rows.append([sid, start + i, o, h, lo, c, v, v * (h + lo + c) / 3, 1, "x"])
    return rows


def found(spark, rows, config=SpikeConfig()):
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, float) else x for x in r) for r in rows], SCHEMA)
    return {(r.sid, r.day, r.field): r.reason for r in implausible_readings(df, "sid", "day", F.col("day").cast("long"), config).collect()}


def test_clean_series_has_no_case(spark):
    assert found(spark, series()) == {}


def test_each_kind(spark):
    rows = series()
    rows[20][5] *= 1.5  # close alone leaves the range
    rows[40][3] *= 1.6  # a high
    rows[60][5] = rows[60][3] = rows[60][5] * 1.5  # the high carried along by a false close
    rows[80][3], rows[80][4] = rows[80][4], rows[80][3]  # high below low
    rows[100][6] *= 1000
    rows[110][6], rows[111][4], rows[112][5] = 0.0, -rows[111][4], float("nan")
    for i in range(121, 130):
        rows[i][6] = rows[120][6]
    got = found(spark, rows)
    day = lambda i: 20200000 + i
    assert got[("a", day(20), "close")] == "bounds" and got[("a", day(40), "high")] == "spike"
    assert {k[2] for k in got if k[1] == day(60)} == {"high", "close"} and {k[2] for k in got if k[1] == day(80)} == {"high", "low"}
    assert got[("a", day(100), "volume")] == "spike" and got[("a", day(110), "volume")] == "bounds" and got[("a", day(111), "low")] == "bounds"
    assert {k[1] for k in got if k[2] == "volume" and k[1] > day(115)} == {day(i) for i in range(121, 130)}
    assert not any(k[1] == day(112) for k in got)


def test_lasting_move_and_real_turnover_are_no_cases(spark):
    rows = series()
    for r in rows[100:]:
        for i in (2, 3, 4, 5):
            r[i] *= 0.5
        r[7] *= 0.5
    rows[50][6] *= 20
    rows[50][7] *= 20
    assert found(spark, rows) == {}


def test_blocks_don_t_change_the_result(spark):
    rows = series(n=400)
    rows[150][5] *= 1.5
    for i in range(190, 215):
        rows[i][3] = rows[189][3] = max(r[3] for r in rows) * 1.01
    small, large = found(spark, rows, SpikeConfig(block=100, halo=40)), found(spark, rows, SpikeConfig(block=100_000, halo=40))
    assert {k for k in small if k[2] == "close"} == {k for k in large if k[2] == "close"}
    assert {k for k in small if small[k] == "stuck"} == {k for k in large if large[k] == "stuck"}


def test_nulls_and_empty(spark):
    assert found(spark, []) == {}
    nulls = [[None, 1, *[None] * 6, 1, "x"], ["a", None, *[1.0] * 6, 1, "x"], ["a", 2, *[None] * 6, 1, "x"], ["a", 3, *[float("nan")] * 6, 1, "x"]]
    assert found(spark, nulls) == {}


def test_kernels():
    x, g = np.array([1.0, np.nan, 2, 4, 8, 8]), np.array([0, 0, 0, 0, 1, 1])
    before, after = neighbours(x, g, 1)
    assert np.array_equal(before, [np.nan, np.nan, 1, 2, np.nan, 8], equal_nan=True) and np.array_equal(after, [2, np.nan, 4, np.nan, 8, np.nan], equal_nan=True)
    assert np.array_equal(group_median(x, g, 3), [2, 8, np.nan], equal_nan=True)
    length, begins, n, repeats = runs(np.array([1.0, 1, np.nan, 1, 2, 2]), g, 2)
    assert length.tolist() == [3, 3, 0, 3, 2, 2] and begins.tolist() == [True, False, False, False, True, False] and n.tolist() == [3, 2] and repeats.tolist() == [1, 1]


def test_small_false_volumes_are_judged_by_the_sid_s_own_scale(spark):
    rows = series()
    for i, r in enumerate(rows):
        r[7] *= 5000 / r[6] * (1 + 0.02 * (i % 5))
        r[6] = 5000.0 * (1 + 0.02 * (i % 5)) + i * 0.01
    rows[30][6] *= 2
    rows[60][6] *= 0.5
    rows[90][6] *= 1.4
    rows[91][6] *= 1.4
    rows[120][6] *= 10
    rows[120][7] = None
    assert {k[1] - 20200000 for k in found(spark, rows) if k[2] == "volume"} == {30, 60, 90, 91, 120}


def test_run_lengths_follow_the_sid_s_own_rate(spark):
    quiet, coarse = series("quiet", 300), series("coarse", 300, seed=3)
    for i in range(101, 104):
        quiet[i][6] = quiet[100][6]
    rng = np.random.default_rng(5)
    for i in range(1, 300):
        if rng.random() < 0.5 and i not in (201,):
            coarse[i][6] = coarse[i - 1][6]
    for r in quiet + coarse:
        r[7] = r[6] * (r[3] + r[4] + r[5]) / 3
    for i in range(201, 208):
        coarse[i][6] = coarse[200][6]
        coarse[i][7] = coarse[i][6] * (coarse[i][3] + coarse[i][4] + coarse[i][5]) / 3
    got = {k for k, why in found(spark, quiet + coarse).items() if why == "stuck" and k[2] == "volume"}
    assert got == {("quiet", 20200000 + i, "volume") for i in range(101, 104)}


def test_excursions_that_return_are_spikes_on_all_rows(spark):
    rows = series(n=300)
    for first, size, by in ((50, 3, 1.17), (100, 9, 1.15), (150, 20, 0.85)):
        for r in rows[first : first + size]:
            for i in (2, 3, 4, 5):
                r[i] *= by
            r[7] *= by
    for r in rows[220:]:
        for i in (2, 3, 4, 5):
            r[i] *= 0.8
        r[7] *= 0.8
    days = {20200000 + i for first, size in ((50, 3), (100, 9), (150, 20)) for i in range(first, first + size)}
    got = found(spark, rows)
    assert {k[1] for k in got if k[2] == "close"} == days and set(got.values()) == {"spike"}


def test_rows_with_volume_or_amount_unknown_keep_bounds_and_spikes(spark):
    rows = series()
    for i, volume, amount in ((40, 0.0, None), (60, None, 0.0), (80, 0.0, None), (100, 0.0, 0.0)):
        rows[i][6], rows[i][7] = volume, amount
    rows[40][3], rows[40][4] = rows[40][4], rows[40][3]
    rows[60][4] = -1.0
    rows[80][3] *= 1.6
    rows[100][4] = -1.0
    for i in range(120, 130):
        rows[i][2:6], rows[i][6:8] = rows[119][2:6], [0.0, None]
    day = lambda i: 20200000 + i
    assert set(found(spark, rows)) == {("a", day(40), "high"), ("a", day(40), "low"), ("a", day(60), "low"), ("a", day(80), "high")}


def test_a_stuck_close_carries_nothing(spark):
    rows = series(n=300, seed=4)
    for i in range(101, 115):
        rows[i][5] = rows[100][5]
        rows[i][3], rows[i][4] = max(rows[i][3], rows[i][5] * (1.001 + i % 5 / 1000)), min(rows[i][4], rows[i][5] * (0.999 - i % 5 / 1000))
    got = found(spark, rows)
    assert {k[1] - 20200000 for k in got if k[2] == "close"} == set(range(101, 115)) and {k[2] for k in got} == {"close"}


def test_blocks_keep_all_fields_and_reasons(spark):
    rows = series(n=400, seed=6)
    rows[150][3] *= 1.5
    rows[180][6] *= 100
    rows[220][4] *= -1
    for i in range(301, 312):
        rows[i][6] = rows[300][6]
    small, large = found(spark, rows, SpikeConfig(block=100, halo=60)), found(spark, rows, SpikeConfig(block=100_000, halo=60))
    assert small == large and {k[2] for k in small} == {"high", "low", "volume"}
