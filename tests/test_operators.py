import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.kernels.dtw import znorm
from tidemark.operators import motif as M
from tidemark.operators import panel as P
from tidemark.operators import reports as R
from tidemark.operators import residual as RS
from tidemark.operators import states as ST
from tidemark.operators import stats as SS
from tidemark.operators import tail as TL
from tidemark.operators import timeseries as TS
from tidemark.operators import universe as U
from tidemark.operators.globalrank import exact_quantiles, global_index
from tidemark.operators.inforce import in_force
from tidemark.operators.salting import fresh, spread_join


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_in_force_takes_the_latest_and_keeps_nulls(spark):
    df = spark.sql("select * from values ('a', 1, timestamp'2020-01-01', 1D), ('a', 1, timestamp'2020-01-02', null), ('a', 1, null, 5D), ('a', null, timestamp'2020-01-01', 1D), ('b', 1, null, 7D) t(k, d, at, v)")
    assert {(r.k, r.v) for r in in_force(df, ["k", "d"], "at", ["v"]).collect()} == {("a", None), ("b", 7.0)}
    assert in_force(df.where("false"), ["k", "d"], "at", ["v"]).count() == 0


def test_flow_ratio_worked_case(spark):
    bars = [("a", 1, i, *map(float, b)) for i, b in enumerate([(10, 12, 8, 11, 100), (11, 11, 11, 11, 50), (11, 13, 11, 13, 200), (13, 13, 9, 9, 100)])]
    sk = spark.createDataFrame(bars, "sid string, day int, minute_idx int, open double, high double, low double, close double, amount double")
    out = TS.flow_ratio_bars(sk, 2).orderBy("bar_idx").collect()
    assert [r.agg_ofi for r in out] == pytest.approx([50, 100], abs=1e-4) and [r.ofi_ratio for r in out] == pytest.approx([1 / 3, 1 / 3], abs=1e-6)


def test_skeleton_has_every_minute_once(spark):
    b = spark.createDataFrame([("a", 1, 5, 1.0, 2.0, 0.5, 1.5, 10.0, 15.0), ("a", 1, 9, 3.0, 3.0, 3.0, 3.0, 1.0, 3.0)], "sid string, day int, minute_idx int, open double, high double, low double, close double, volume double, amount double")
    out = {r.minute_idx: r for r in TS.minute_skeleton(b).collect()}
    assert sorted(out) == list(range(240)) and out[0].close == 1.5 and out[8].high == 1.5 and out[239].close == 3.0 and out[7].volume == 0


def test_minute_bars_don_t_depend_on_partitions(spark):
    ticks = [("a", 1, m, float(m * 60 + k), float(k), float(k), float(k), float(k), 1.0, 1.0) for m in range(5) for k in range(4)]
    random.Random(0).shuffle(ticks)
    df = spark.createDataFrame(ticks, "sid string, day int, minute_idx int, at double, open double, high double, low double, close double, volume double, amount double")
    one, many = (rows(TS.minute_bars(df.repartition(n)), "minute_idx", "open", "close", "volume") for n in (1, 7))
    assert one == many and one[0] == (0, 0.0, 3.0, 4.0)


def test_average_rank_keeps_three(spark):
    m = spark.createDataFrame([("a", 1, 50.0, 200), ("b", 1, 40.0, 200), ("c", 1, 40.0, 200), ("d", 1, 10.0, 200)], "sid string, month_id int, avg_amount double, days_since_ipo int")
    assert rows(U.kept_by_rank(m), "sid", "rank") == [("a", 1.0), ("b", 2.5), ("c", 2.5)]


def test_ordinal_bins_differ_from_ntile(spark):
    df = spark.createDataFrame([(1, float(i), i) for i in range(7)] + [(1, None, 9)], "day int, v double, id int")
    assert [b for _, b in rows(ST.rank_bins(df, "day", "v", 5, "id"), "v", "bin")] == [0, 0, 1, 2, 2, 3, 4]


@pytest.mark.parametrize(("n", "expected"), [(5, (2, 4)), (6, (3, 4)), (8, (3, 6))])
def test_nearest_quantiles(spark, n, expected):
    df = spark.createDataFrame([(float(i),) for i in range(1, n + 1)], "v double")
    assert ST.tercile_bounds(df, "v") == expected


def test_return_bins_and_nulls(spark):
    df = spark.sql("select * from values (0.03D, 0.02D, 1), (-0.01D, 0.02D, 2), (0.01D, 0.02D, 3), (null, 0.02D, 4), (0.1D, 0D, 5), (double('nan'), 0.02D, 6) t(r, v, k)")
    got = [r.b for r in df.select("k", *[F.when(F.col("k") == k, ST.return_bin(F.col("r"), F.col("v"), 1 if k == 1 else 2 if k == 2 else 3, 1.0)).alias(f"b{k}") for k in range(1, 7)]).orderBy("k").selectExpr("coalesce(b1, b2, b3, b4, b5, b6) b").collect()]
    assert got == [3, 1, 2, None, None, None]


def test_chain_and_scores_worked_case(spark):
    df = spark.createDataFrame([(0, 2, 3, 3), (0, 3, 3, 2), (0, 2, 1, 0), (2, 0, 1, 1), (None, 1, 1, 1)], "macro_state int, bin_1 int, bin_2 int, bin_3 int")
    chain = ST.transitions(df, [("macro_state", 3), ("bin_1", 4), ("bin_2", 4), ("bin_3", 4)])
    assert [p for *_, p in rows(chain.where("step = 'macro_state->bin_1' and from_state = 0"), "to_state", "p")] == pytest.approx([1 / 7, 1 / 7, 3 / 7, 2 / 7])
    assert chain.groupBy("step", "from_state").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    got = dict(rows(ST.state_scores(chain, ["macro_state", "bin_1", "bin_2", "bin_3"]), "macro_state", "fsm_score"))
    assert [got[k] for k in range(3)] == pytest.approx([0.167857, 0.01375, -0.097], abs=1e-6)


def test_mann_whitney_worked_case(spark):
    cond, rest = [3, 4, 5, 5, 6], [1, 2, 2, 3, 4]
    df = spark.createDataFrame([(float(v), True) for v in cond] + [(float(v), False) for v in cond + rest] + [(None, True)], "v double, f boolean")
    r = SS.mann_whitney(df, "v", F.col("f")).first()
    assert (r.n1, r.n2, r.u) == (5, 10, 35.5) and r.z == pytest.approx(1.247219, abs=1e-6)
    assert SS.normal_tail(r.z) == pytest.approx(0.106159, abs=1e-6) and SS.ladder(0.106159) == 0 and SS.ladder(0.106159, False) == 10
    one = SS.mann_whitney(df.withColumn("v", F.lit(1.0)), "v", F.col("f")).first()
    assert one.z is None


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=80).round(1), rng.normal(0.3, 1, 60).round(1)
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "v double, f boolean")
    grid = np.concatenate([a, b])
    assert SS.ks_statistic(df, "v", F.col("f")).first().d == pytest.approx(max(abs((a <= x).mean() - (b <= x).mean()) for x in grid))
    assert SS.ks_p(0.0, 5, 5) == 1.0 and SS.ks_p(0.9, 100, 100) < 1e-6


def test_expressions(spark):
    one = spark.range(1)
    edges = F.array(*[F.lit(float(e)) for e in (-1, 0, 1)])
    got = one.select(*[X.digitize(F.lit(float(v)), edges).alias(f"c{i}") for i, v in enumerate((-2, -1, -0.5, 0, 1, 3))]).first()
    assert list(got) == [0, 1, 1, 2, 3, 3]
    assert [X.motif_threshold(m, 0.85) for m in (6, 12, 24, 48)] == pytest.approx([1.341641, 1.897367, 2.683282, 3.794733], abs=1e-6)
    assert one.select(X.smooth_objective(F.lit(0.01), F.lit(0.002), F.lit(60), 48)).first()[0] == pytest.approx(31.465114, abs=1e-5)
    z = one.select(X.znorm(F.array(*[F.lit(float(v)) for v in (1, 2, 4)]))).first()[0]
    assert z == pytest.approx(znorm(np.array([1.0, 2, 4])).tolist())
    labels = one.select(*[X.volume_label(F.lit(float(v)), F.lit(1e9)).alias(f"c{i}") for i, v in enumerate((999, 1500, 2.5e6, 1.1e9, 1.3e9))]).first()
    assert list(labels) == ["0G", "0G", "0G", "1G", ""]
    values = one.select(*[X.zero_if_not_finite(F.lit(v)).alias(f"c{i}") for i, v in enumerate((1.0, float("nan"), float("inf")))]).first()
    assert list(values) == [1.0, 0.0, 0.0]


def test_mad_scale(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (1, 2, 3, 4, 100)], "k int, v double")
    assert [z for _, z in rows(M.mad_znormed(df, ["k"], "v"), "v", "robust_z")] == pytest.approx([-1.348982, -0.674491, 0, 0.674491, 65.425604], abs=1e-5)


def test_vol_isn_t_filled_across_sids(spark):
    df = spark.createDataFrame([(s, d, 10.0 + (d * 7 % 5)) for s in "ab" for d in range(30)], "sid string, day int, close double")
    out = {(r.sid, r.day): r for r in P.returns_and_vol(df).collect()}
    assert out["b", 3].vol_20d is None and out["b", 29].vol_20d >= 0.005 and out["b", 29].fwd_ret_1 is None
    sums = P.log_returns(df).select("sid", "day", P.forward_sum("log_ret", P.by_day(), 3).alias("f"))
    last = {(r.sid, r.day): r.f for r in sums.collect()}
    assert last["a", 27] is None and last["a", 26] == pytest.approx(math.log(df.where("sid='a' and day=29").first().close / df.where("sid='a' and day=26").first().close))


def test_asof_and_merge(spark):
    data = spark.createDataFrame([(1, 5), (2, 10), (3, 11), (4, 99)], "id int, ts int")
    clock = spark.createDataFrame([(5,), (10,), (20,), (20,)], "ts int")
    assert rows(TS.asof_index(data, clock, "ts").fillna(-1), "id", "clock_ts") == [(1, 5), (2, 10), (3, 20), (4, -1)]
    merged = TS.outer_merge([data, spark.createDataFrame([(7, 1.0)], "ts int, x double")], ["ts"])
    assert merged.count() == 5


def test_adjusted_by_factor_in_force(spark):
    prices = spark.createDataFrame([("a", d, 10.0) for d in (1, 5, 9)] + [("b", 1, 4.0)], "sid string, day int, close double")
    factors = spark.createDataFrame([("a", 3, 1.0), ("a", 8, 2.0)], "sid string, day int, factor double")
    assert rows(P.adjusted(prices, factors, ["close"]), "sid", "day", "close") == [("a", 1, 10.0), ("a", 5, 5.0), ("a", 9, 10.0), ("b", 1, 4.0)]


def test_wide_metrics_and_shift(spark):
    log = spark.createDataFrame([("k", 1, 1, "x", 1.0), ("k", 1, 2, "x", 2.0), ("k", 1, 3, "x", None), ("k", 2, 1, "y", 5.0)], "g string, t int, seq int, name string, v double")
    assert rows(TS.wide_metrics(log, ["g", "t"], "name", "v", ["seq"], ["x", "y"]).fillna(-1), "t", "x", "y") == [(1, 2.0, -1.0), (2, 2.0, 5.0)]
    df = spark.createDataFrame([("k", 1, 1.0), ("k", 2, None), ("k", 3, 3.0)], "g string, t int, v double")
    assert rows(TS.shifted(df, ["g"], ["t"], ["v"]), "t", "v") == [(2, 1.0)]


def test_global_index_and_pages(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    out = global_index(df, [F.col("v")]).collect()
    assert all(r["index"] == r.v for r in out) and len(out) == 1000
    assert global_index(df.where("false"), [F.col("v")]).count() == 0
    assert R.paged(df, ["v"], 7).groupBy("page").count().where("page < 6 and count <> 142").count() == 0


def test_spread_join_is_a_join(spark):
    big = spark.createDataFrame([("h", i % 3, i) for i in range(50)] + [("x", 1, 1), (None, 1, 1)], "k string, _salt int, v int")
    per = spark.createDataFrame([("h", 2.0), ("y", 1.0)], "k string, w double")
    out = spread_join(big, per, ["k"])
    assert out.count() == 50 and set(out.columns) == {"k", "_salt", "v", "w"} and fresh("_salt", big) == "_salt_"
    assert spread_join(big, per, ["k"], how="left").where("w is null").count() == 2
    big = big.unionByName(spark.createDataFrame([(None, 1, i) for i in range(30)], big.schema))
    per = per.unionByName(spark.createDataFrame([(None, 7.0)], per.schema))
    for how in ("inner", "left"):
        plain, parted = big.join(per, "k", how), spread_join(big, per, ["k"], how, split=10)
        assert parted.columns == plain.columns and sorted(map(str, parted.collect())) == sorted(map(str, plain.collect()))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(v)) for k, n in (("a", 101), ("b", 40), ("c", 1)) for v in np.round(rng.normal(size=n), 1)] + [("a", None), ("a", float("nan")), ("d", None), (None, 5.0)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: (r.lo, r.mid, r.top) for r in exact_quantiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "top": 1.0}).collect()}
    want = {k: np.quantile([v for j, v in data if j == k and v is not None and v == v], [0.1, 0.5, 1.0]) for k in ("a", "b", "c")}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k].tolist()) for k in want)
    one = exact_quantiles(df, [], "v", {"mid": 0.5}).collect()
    assert one[0].mid == pytest.approx(np.median([v for _, v in data if v is not None and v == v])) and exact_quantiles(df.where("false"), [], "v", {"mid": 0.5}).count() == 0


def test_asof_over_ranges(spark):
    rng = np.random.default_rng(2)
    data, clock = [(i, "k" if i % 4 else "l", int(rng.integers(0, 1000))) for i in range(300)] + [(900, "k", None)], [("k", int(t)) for t in rng.integers(100, 900, 40)] + [("l", 500), ("m", 1), ("k", None)]
    d, c = spark.createDataFrame(data, "id int, k string, t int"), spark.createDataFrame(clock, "k string, t int")
    want = {i: min((u for j, u in clock if j == k and u is not None and t is not None and u >= t), default=None) for i, k, t in data}
    assert {r.id: r.clock_ts for r in TS.asof_index(d, c, "t", ["k"]).collect()} == want
    whole = {i: min((u for _, u in clock if u is not None and t is not None and u >= t), default=None) for i, _, t in data}
    assert {r.id: r.clock_ts for r in TS.asof_index(d, c.select("t"), "t").collect()} == whole
    assert TS.asof_index(d, c.where("false"), "t", ["k"]).where("clock_ts is not null").count() == 0


def test_residuals_and_features(spark, data):
    from tidemark.plans.reference import skeleton

    sk = skeleton(spark, data)
    for signal in ("close", "vwap", "vpt"):
        assert RS.residuals(sk, signal).where("residual is null").count() == 0
    daily = RS.residuals(sk, reset_daily=True).groupBy("sid", "day").agg(F.sum("residual").alias("s"), F.max_by("cum", "minute_idx").alias("c"))
    assert daily.where("abs(s - c) > 1e-9").count() == 0


@pytest.mark.parametrize("block", [16, 100_000])
def test_matrix_profile_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    curves = {s: rng.normal(size=14) for s in range(12)} | {20: np.ones(14), 21: np.ones(14), 22: np.r_[np.zeros(7), np.arange(7.0)]}
    curves[23] = curves[3].copy()
    df = spark.createDataFrame([(s, c.tolist()) for s, c in curves.items()] + [(90, [1.0] * 3), (91, None), (92, [None] * 9), (93, [float("nan")] * 9)], "s int, c array<double>")
    got = {(r.series, r.pos): r for r in M.matrix_profile(df, ["s"], "c", 5, block=block).collect()}
    wins = {(str(s), i): znorm(c[i : i + 5]) for s, c in curves.items() for i in range(10)}
    assert set(got) == set(wins)
    for (s, i), w in wins.items():
        r = got[s, i]
        assert r.distance == pytest.approx(min(np.linalg.norm(w - v) for (t, j), v in wins.items() if not (t == s and abs(i - j) <= 2)), abs=1e-6)
        assert np.linalg.norm(w - wins[r.nn_series, r.nn_pos]) == pytest.approx(r.distance, abs=1e-6) and not (r.nn_series == s and abs(r.nn_pos - i) <= 2)
    assert M.matrix_profile(df.where("false"), ["s"], "c", 5).count() == 0 and M.matrix_profile(df.where("s = 3").select("s", F.slice("c", 1, 5).alias("c")), ["s"], "c", 5).count() == 0


def test_tail_bins_recover_known_tails(spark):
    rng = np.random.default_rng(5)
    n, xi, sigma = 40_000, 0.2, 1.5
    tail = lambda k: ((1 - rng.random(k)) ** -xi - 1) / xi * sigma
    x = np.concatenate([-1 - tail(n // 20), rng.uniform(-1, 1, n - 2 * (n // 20)), 1 + tail(n // 20)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("few", 1.0)] * 9 + [("a", None), ("a", float("nan")), (None, 1.0)], "k string, v double")
    out = TL.gpd_bins(df, "v", "k").collect()
    assert [r.k for r in out] == ["a"] and out[0].edges == pytest.approx(np.quantile(x, TL.QUANTILES), abs=5e-3)
    beyond = sigma / (1 - xi)
    assert out[0].centres[0] == pytest.approx(-1 - beyond, rel=0.06) and out[0].centres[4] == pytest.approx(1 + beyond, rel=0.06)
    inner = [x[(x >= a) & (x < b)].mean() for a, b in zip(out[0].edges, out[0].edges[1:])]
    assert out[0].centres[1:4] == pytest.approx(inner, abs=1e-3)
    assert TL.gpd_bins(df.where("false"), "v", "k").count() == 0


def test_anchored_chains_go_back_within_a_series(spark):
    rows = [("a", 9, 0.1, "a", 5), ("a", 5, 0.1, "a", 2), ("a", 2, 0.1, "a", 9), ("a", 7, 0.9, "a", 1), ("b", 9, 0.1, "a", 5), ("b", 3, 0.1, "b", 1)]
    profile = spark.createDataFrame(rows, "series string, pos int, distance double, nn_series string, nn_pos int")
    anchors = spark.createDataFrame([("a", 9), ("a", 7), ("b", 9), ("c", 1)], "series string, pos int")
    got = {}
    for r in M.anchored_chains(profile, anchors, 0.5).orderBy("step").collect():
        got.setdefault((r.series, r.anchor), []).append(r.pos)
    assert got == {("a", 9): [9, 5, 2], ("a", 7): [7], ("b", 9): [9]}
    assert M.anchored_chains(profile, anchors.where("false"), 0.5).count() == 0


def test_axis_helpers(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(10)], "k int, l string")
    assert sorted(r.k for r in R.row_slice(df, ["k"], -3, 9).collect()) == [7, 8] and R.row_slice(df, ["k"], 5, 2).count() == 0
    ticks = spark.createDataFrame([(-4.0,), (2.6,), (99.0,)], "tick double")
    assert rows(R.index_labels(df, ["k"], ticks, F.col("l")), "tick", "label") == [(-4.0, "l0"), (2.6, "l3"), (99.0, "l9")]
    assert R.index_labels(df.where("false"), ["k"], ticks, F.col("l")).where("label is null").count() == 3
    clocks = spark.createDataFrame([("a", 2, 1), ("b", 1, 5), ("c", 1, 3), ("d", None, 0)], "name string, timeframe int, compression int")
    assert [r.name for r in R.finest_clock(clocks).collect()] == ["c"] and R.finest_clock(clocks.where("false")).count() == 0


def test_volume_labels_share_the_divisor_of_their_axis(spark):
    from tidemark.functions.exprs import volume_label

    df = spark.createDataFrame([(950.0, 2e6), (1_500_000.0, 2e6), (2_500_000.0, 2e6), (-1500.0, 2000.0), (7e15, 9e15), (999.0, 999.0)], "v double, top double")
    assert [r.s for r in df.select(volume_label(F.col("v"), F.col("top")).alias("s")).collect()] == ["0M", "1M", "", "-1K", "7P", "999"]


def test_dashboard_leaves_other_kinds_and_sids_out(spark):
    log = spark.createDataFrame(
        [("bar", "a", 1, 5.0, None, None), ("bar", "a", 2, 6.0, None, None), ("bar", "b", 1, 7.0, None, None), ("fill", "a", 1, None, "BUY", 2.0), ("fill", "a", 1, None, "BUY", None), ("fill", "a", 1, None, "SELL", 3.0), ("fill", "a", 1, None, "HOLD", 9.0), ("note", "a", 2, None, "BUY", 9.0)],
        "table_type string, sid string, datetime int, close double, direction string, size double",
    )
    got = R.dashboard(log, "a", "bar", "fill").collect()
    assert [(r.datetime, r.close, r.buy, r.sell) for r in got] == [(1, 5.0, 2.0, 3.0), (2, 6.0, 0.0, 0.0)] and R.dashboard(log, "z", "bar", "fill").count() == 0


def test_bars_take_the_first_open_that_is_there(spark):
    ticks = spark.createDataFrame([("a", 1, 0, 1.0, None, 5.0, 4.0, 4.5, 1.0, 1.0), ("a", 1, 0, 2.0, 4.2, 6.0, 4.0, 5.5, 1.0, 1.0)], "sid string, day int, minute_idx int, at double, open double, high double, low double, close double, volume double, amount double")
    bar = TS.minute_bars(ticks).first()
    assert bar.open == 4.2 and bar.close == 5.5


def test_end_of_day_windows(spark):
    rng = np.random.default_rng(6)
    bars = [("a", d, i, float(rng.normal()), 10 + float(rng.normal())) for d in range(4) for i in range(240) if not (d == 2 and i > 200)]
    cum = spark.createDataFrame([r[:4] for r in bars], "sid string, day int, minute_idx int, cum double")
    price = spark.createDataFrame([(*r[:3], r[4]) for r in bars], "sid string, day int, minute_idx int, close double")
    got = {r.day: r.curve for r in RS.eod_features(cum, price, 5, 60).collect()}
    buckets = {}
    for _, d, i, v, _p in bars:
        if i <= 235:
            buckets[d, -(-i // 5)] = v * 1000
    order = sorted(buckets)
    assert set(got) == {1, 3}
    for d in got:
        upto = [buckets[k] for k in order if k[0] <= d]
        assert got[d] == pytest.approx(upto[-60:])


def test_matrix_profile_stores_its_windows_once_and_no_pairs(spark):
    """Files of the shared folder, for windows that come near each other's cells again and again."""
    import os

    from tidemark.session import shared_folder

    def size():
        folder = shared_folder(spark).removeprefix("file:").replace("//", "/")
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)

    curves = np.random.default_rng(8).normal(size=(150, 60))
    df = spark.createDataFrame([(s, c.tolist()) for s, c in enumerate(curves)], "s int, c array<double>")
    before = size()
    got = M.matrix_profile(df, ["s"], "c", 12, block=512).select("distance").toPandas()["distance"]
    assert len(got) == 150 * 49 and size() - before < 2 * 150 * 49 * 12 * 8
