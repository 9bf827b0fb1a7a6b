"""Queries of the research operators over the test tables, each with its SQL where SQL can express it.

Doubles are rounded to six digits on both sides, as sums run in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import exprs as X
from tidemark.operators import motif as M
from tidemark.operators import panel as P
from tidemark.operators import reports as R
from tidemark.operators import residual as RS
from tidemark.operators import search as SE
from tidemark.operators import states as ST
from tidemark.operators import stats as SS
from tidemark.operators import tail as TL
from tidemark.operators import timeseries as TS
from tidemark.operators import universe as U
from tidemark.operators.globalrank import exact_quantiles, global_index
from tidemark.operators.inforce import in_force, yyyymmdd_date
from tidemark.operators.regrid import epoch_seconds, session_minute
from tidemark.operators.salting import spread_join
from tidemark.session import new_path
from tidemark.sources import io
from tidemark.streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
DAY_OF = "CAST(strptime(CAST(day AS VARCHAR), '%Y%m%d') AS DATE)"

# Shared parts of the SQL, by name; a query's text begins with those it needs.
PARTS = {
    "daily_f": "SELECT sid, day, open, high, low, CASE WHEN isnan(close) THEN NULL ELSE close END AS close, volume, amount FROM (SELECT *, row_number() OVER (PARTITION BY sid, day ORDER BY recv_at DESC) AS rn FROM daily) WHERE rn = 1",
    "priced": f"SELECT *, {DAY_OF} AS date FROM daily_f WHERE close > 0",
    "listed": "SELECT sid, CAST(strptime(CAST(min(first_trading) AS VARCHAR), '%Y%m%d') AS DATE) AS ipo FROM instrument GROUP BY sid",
    "ticks": """SELECT *, CAST(floor(s / 86400) AS INT) AS day, CASE WHEN mm >= 570 AND mm < 690 THEN mm - 570 WHEN mm >= 780 AND mm < 900 THEN mm - 660 END AS minute
        FROM (SELECT *, CAST(floor((s - floor(s / 86400) * 86400) / 60) AS INT) AS mm FROM (
            SELECT DISTINCT *, CASE WHEN abs(tick) >= 1e17 THEN tick / 1e9 WHEN abs(tick) >= 1e14 THEN tick / 1e6 WHEN abs(tick) >= 1e11 THEN tick / 1e3 ELSE tick END AS s
            FROM tick WHERE tick IS NOT NULL AND close > 0 AND NOT isnan(close)))""",
    "bars": """SELECT sid, day, minute AS minute_idx, (min({'a': s, 'v': open}) FILTER (open IS NOT NULL)).v AS open, max(high) AS high, min(low) AS low, max({'a': s, 'v': close}).v AS close, sum(volume) AS volume, sum(amount) AS amount
        FROM ticks WHERE minute IS NOT NULL GROUP BY sid, day, minute""",
    "skeleton0": """SELECT g.sid, g.day, g.minute_idx, b.open, b.high, b.low, b.volume, b.amount,
        coalesce(last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.sid, g.day ORDER BY g.minute_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(b.close IGNORE NULLS) OVER (PARTITION BY g.sid, g.day ORDER BY g.minute_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
        FROM (SELECT p.sid, p.day, CAST(m.r AS INT) AS minute_idx FROM (SELECT DISTINCT sid, day FROM bars) p, (SELECT unnest(range(240)) AS r) m) g LEFT JOIN bars b USING (sid, day, minute_idx)""",
    "skeleton": "SELECT sid, day, minute_idx, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume, coalesce(amount, 0) AS amount FROM skeleton0",
    "flow": """SELECT sid, day, CAST(floor(minute_idx / 5) AS INT) AS bar_idx, sum((2 * close - high - low) / (high - low + 1e-8) * amount) AS agg_ofi, sum(amount) AS agg_amount, arg_max(close, minute_idx) AS close
        FROM skeleton GROUP BY sid, day, CAST(floor(minute_idx / 5) AS INT)""",
    "flow_bars": "SELECT *, sum(agg_ofi) OVER w / (sum(agg_amount) OVER w + 1e-8) AS ofi_ratio FROM flow WINDOW w AS (PARTITION BY sid, day ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)",
    "panel_d": "SELECT DISTINCT * FROM panel",
    "months": """SELECT sid, CAST(strftime(date, '%Y%m') AS INT) AS month_id, avg(amount) AS avg_amount, max(date) AS last_trade_date, date_diff('day', max(ipo), max(date)) AS days_since_ipo,
        CAST(strftime(max(date) + INTERVAL 1 MONTH, '%Y%m') AS INT) AS trade_month_id FROM priced LEFT JOIN listed USING (sid) GROUP BY sid, CAST(strftime(date, '%Y%m') AS INT)""",
    "old": "SELECT * FROM months WHERE days_since_ipo >= 120",
    "kept": """SELECT o.*, rank() OVER (PARTITION BY o.month_id ORDER BY avg_amount DESC) + (count(*) OVER (PARTITION BY o.month_id, avg_amount) - 1) / 2.0 AS rank, n.n
        FROM old o JOIN (SELECT month_id, count(*) AS n FROM old GROUP BY month_id) n USING (month_id) WHERE avg_amount IS NOT NULL""",
    "flows": "SELECT day, avg(list_sum(list_filter(daily_curve, lambda x: x IS NOT NULL AND NOT isnan(x)))) AS flow FROM panel_d GROUP BY day",
    "bounds": "SELECT v[1 + CAST(round((len(v) - 1) / 3.0) AS INT)] AS lo, v[1 + CAST(round((len(v) - 1) * 2 / 3.0) AS INT)] AS hi FROM (SELECT list_sort(list(flow)) AS v FROM flows)",
    "macro": "SELECT day, flow, CASE WHEN flow <= lo THEN 0 WHEN flow <= hi THEN 1 ELSE 2 END AS macro_state FROM flows, bounds",
    "binned": "SELECT sid, day, " + ", ".join(f"CASE WHEN fwd_ret_{k} IS NULL OR vol_20d IS NULL OR isnan(fwd_ret_{k}) OR isnan(vol_20d) OR vol_20d = 0 THEN NULL WHEN fwd_ret_{k} / (vol_20d * sqrt({k})) < -1 THEN 0 WHEN fwd_ret_{k} / (vol_20d * sqrt({k})) < 0 THEN 1 WHEN fwd_ret_{k} / (vol_20d * sqrt({k})) < 1 THEN 2 ELSE 3 END AS bin_{k}" for k in (1, 2, 3)) + " FROM panel_d",
    "labelled": "SELECT b.*, m.macro_state FROM binned b JOIN macro m USING (day) WHERE bin_1 IS NOT NULL AND bin_2 IS NOT NULL AND bin_3 IS NOT NULL",
    "cells": " UNION ALL ".join(f"SELECT '{a}->{b}' AS step, i.r AS from_state, j.r AS to_state, (SELECT count(*) FROM labelled l WHERE l.{a} = i.r AND l.{b} = j.r) AS n FROM (SELECT CAST(unnest(range({na})) AS INT) AS r) i, (SELECT CAST(unnest(range(4)) AS INT) AS r) j" for a, na, b in (("macro_state", 3, "bin_1"), ("bin_1", 4, "bin_2"), ("bin_2", 4, "bin_3"))),
    "chain": "SELECT step, from_state, to_state, n, (n + 1) / (sum(n) OVER (PARTITION BY step, from_state) + 4) AS p FROM cells",
    "logs": """SELECT sid, day, date, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY sid ORDER BY day), 0) AS log_ret FROM priced""",
    "sigmas0": "SELECT *, CASE WHEN count(log_ret) OVER w >= 20 THEN stddev_samp(log_ret) OVER w END AS s FROM logs WINDOW w AS (PARTITION BY sid ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "sigmas": "SELECT sid, day, date, log_ret, last_value(s IGNORE NULLS) OVER (PARTITION BY sid ORDER BY day ROWS UNBOUNDED PRECEDING) AS sigma FROM sigmas0",
}
NEEDS = {
    "priced": ["daily_f"], "bars": ["ticks"], "skeleton0": ["bars"], "skeleton": ["skeleton0"], "flow": ["skeleton"], "flow_bars": ["flow"], "months": ["priced", "listed"], "old": ["months"], "kept": ["old"],
    "flows": ["panel_d"], "bounds": ["flows"], "macro": ["flows", "bounds"], "binned": ["panel_d"], "labelled": ["binned", "macro"], "cells": ["labelled"], "chain": ["cells"], "logs": ["priced"], "sigmas0": ["logs"], "sigmas": ["sigmas0"],
}


def _with(parts: str, body: str) -> str:
    order: list[str] = []

    def add(p: str) -> None:
        for q in NEEDS.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts.split():
        add(p)
    head = "WITH " + ", ".join(f"{p} AS ({PARTS[p]})" for p in order) + " " if order else ""
    return head + body


def query(parts: str | None = None, sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _with(parts or "", sql)
        return f

    return register


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def daily_f(spark, d):
    rows = in_force(read(spark, d, "daily"), ["sid", "day"], "recv_at", ["open", "high", "low", "close", "volume", "amount"])
    return rows.withColumn("close", X.null_if_nan(F.col("close")))


def priced(spark, d):
    return daily_f(spark, d).where("close > 0").withColumn("date", yyyymmdd_date(F.col("day")))


def listed(spark, d):
    return read(spark, d, "instrument").groupBy("sid").agg(yyyymmdd_date(F.min("first_trading")).alias("ipo"))


def ticks(spark, d):
    s = epoch_seconds(F.col("tick"))
    rows = read(spark, d, "tick").where("tick is not null and close > 0 and not isnan(close)").distinct()
    return rows.select("sid", s.alias("at"), F.floor(s / 86400).cast("int").alias("day"), session_minute(s).alias("minute_idx"), "open", "high", "low", "close", "volume", "amount")


def bars(spark, d):
    return TS.minute_bars(ticks(spark, d).where("minute_idx is not null"))


def skeleton(spark, d):
    return TS.minute_skeleton(bars(spark, d))


def panel(spark, d):
    return read(spark, d, "panel").distinct()


def r6(*columns: str):
    return [F.round(c, 6).alias(c) for c in columns]


def s6(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


# Ingest and bars


@query("daily_f", f"SELECT sid, day, {s6('open', 'high', 'low', 'close', 'volume', 'amount')} FROM daily_f")
def daily_in_force(spark, d):
    return daily_f(spark, d).select("sid", "day", *r6("open", "high", "low", "close", "volume", "amount"))


@query("daily_f", f"SELECT sid, day, CAST(strftime({DAY_OF}, '%Y%m%d') AS INT) AS back, CAST(strftime({DAY_OF}, '%Y%m') AS INT) AS month_id, CAST(strftime({DAY_OF} + INTERVAL 1 MONTH, '%Y%m') AS INT) AS next_month FROM daily_f")
def int_date_roundtrip(spark, d):
    date = yyyymmdd_date(F.col("day"))
    return daily_f(spark, d).select("sid", "day", F.date_format(date, "yyyyMMdd").cast("int").alias("back"), F.date_format(date, "yyyyMM").cast("int").alias("month_id"), F.date_format(F.add_months(date, 1), "yyyyMM").cast("int").alias("next_month"))


@query("", "SELECT o_orderkey, o_orderpriority AS name, round(CAST(round(o_totalprice * 100000) AS BIGINT) * 1e-5, 2) AS open, round(CAST(round(o_totalprice * 90000) AS BIGINT) * 1e-5, 2) AS low, round(CAST(round(o_totalprice * 1000) AS BIGINT) * 1e-3, 2) AS price, round(CAST(floor(o_totalprice) AS BIGINT) * 10 * 1e-3, 2) AS volume FROM orders")
def tick_rescale(spark, d):
    scaled = lambda by: F.round(F.col("o_totalprice") * by).cast("bigint")
    wire = read(spark, d, "orders").select("o_orderkey", F.encode("o_orderpriority", "UTF-8").alias("name"), scaled(100000).alias("open"), scaled(90000).alias("low"), scaled(1000).alias("price"), (F.floor("o_totalprice") * 10).alias("volume"))
    return io.from_wire(wire)


@query("ticks", "SELECT sid, day, minute AS minute_idx, count(*) AS n, round(max(close), 6) AS top FROM ticks GROUP BY sid, day, minute")
def session_minutes(spark, d):
    return ticks(spark, d).groupBy("sid", "day", "minute_idx").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("close"), 6).alias("top"))


@query("skeleton", f"SELECT sid, day, minute_idx, {s6('open', 'high', 'low', 'close', 'volume', 'amount')} FROM skeleton")
def minute_skeleton(spark, d):
    return skeleton(spark, d).select("sid", "day", "minute_idx", *r6("open", "high", "low", "close", "volume", "amount"))


@query("flow_bars", f"SELECT sid, day, bar_idx, round(agg_ofi, 2) AS agg_ofi, {s6('agg_amount', 'close', 'ofi_ratio')} FROM flow_bars")
def flow_ratio_bars(spark, d):
    return TS.flow_ratio_bars(skeleton(spark, d)).select("sid", "day", "bar_idx", F.round("agg_ofi", 2).alias("agg_ofi"), *r6("agg_amount", "close", "ofi_ratio"))


def points(df: DataFrame, curve: str, keep: list[str], digits: int = 6) -> DataFrame:
    """A row per point of a curve, rounded."""
    return df.select(*keep, F.posexplode(curve).alias("pos", "v")).select(*keep, F.col("pos").cast("bigint").alias("pos"), F.round("v", digits).alias("v"))


@query("flow_bars", "SELECT sid, day, n AS curve_len, CAST(bar_idx AS BIGINT) AS pos, round(ofi_ratio, 6) AS v FROM (SELECT *, count(ofi_ratio) OVER (PARTITION BY sid, day) AS n FROM flow_bars) WHERE n = 48")
def daily_curve(spark, d):
    return points(TS.daily_curves(TS.flow_ratio_bars(skeleton(spark, d)), length=48), "daily_curve", ["sid", "day", "curve_len"])


@query("ticks", "SELECT sid, time_bucket(INTERVAL 30 MINUTE, t) AS ts, round((min({'a': t, 'v': open}) FILTER (open IS NOT NULL)).v, 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(max({'a': t, 'v': close}).v, 6) AS close, round(avg(close), 6) AS mean, round(sum(volume), 3) AS volume FROM (SELECT *, make_timestamp(CAST(floor(s * 1e6) AS BIGINT)) AS t FROM ticks) GROUP BY 1, 2")
def ohlcv_resample(spark, d):
    rows = ticks(spark, d).withColumn("ts", F.timestamp_micros(F.floor(F.col("at") * 1e6).cast("bigint"))).withColumn("mean", F.col("close"))
    out = TS.resampled(rows, ["sid"], "ts", "30 minutes", {"open": "first", "high": "max", "low": "min", "close": "last", "mean": "mean", "volume": "sum"})
    return out.select("sid", F.col("ts").cast("timestamp_ntz").alias("ts"), *r6("open", "high", "low", "close", "mean"), F.round("volume", 3).alias("volume"))


@query("ticks", "SELECT sid, time_bucket(INTERVAL 5 MINUTE, make_timestamp(CAST(floor(s * 1e6) AS BIGINT)) - INTERVAL 1 MICROSECOND) + INTERVAL 5 MINUTE AS ts, round(max({'a': make_timestamp(CAST(floor(s * 1e6) AS BIGINT)), 'v': close}).v, 6) AS close FROM ticks GROUP BY 1, 2")
def right_closed_resample(spark, d):
    rows = ticks(spark, d).select("sid", "close", F.timestamp_micros(F.floor(F.col("at") * 1e6).cast("bigint")).alias("ts"))
    return TS.resampled(rows, ["sid"], "ts", "5 minutes", {"close": "last"}, right=True).select("sid", F.col("ts").cast("timestamp_ntz").alias("ts"), *r6("close"))


@query("ticks", "SELECT sid, day, round(max(CASE WHEN mm <= 895 THEN {'a': s, 'v': close} END).a, 6) AS at, round(max(CASE WHEN mm <= 895 THEN {'a': s, 'v': close} END).v, 6) AS close FROM ticks WHERE mm <= 895 GROUP BY sid, day")
def eod_snapshot(spark, d):
    rows = ticks(spark, d).select("sid", "day", "at", "close", F.floor((F.col("at") - F.floor(F.col("at") / 86400) * 86400) / 60).alias("mm"))
    return RS.snapshot(rows, "at", "mm").select("sid", "day", *r6("at", "close"))


# Returns


_RETURNS = "SELECT *, CASE WHEN last_v IS NOT NULL THEN greatest(last_v, 0.005) END AS vol_20d FROM (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY sid ORDER BY day ROWS UNBOUNDED PRECEDING) AS last_v FROM (SELECT *, CASE WHEN count(ret) OVER w >= 5 THEN stddev_samp(ret) OVER w END AS v FROM (SELECT sid, day, date, close / lag(close) OVER o - 1 AS ret, lead(close, 1) OVER o / close - 1 AS fwd_ret_1, lead(close, 2) OVER o / close - 1 AS fwd_ret_2, lead(close, 3) OVER o / close - 1 AS fwd_ret_3 FROM priced WINDOW o AS (PARTITION BY sid ORDER BY day)) WINDOW w AS (PARTITION BY sid ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))"


@query("priced", f"SELECT sid, day, {s6('ret', 'vol_20d', 'fwd_ret_1', 'fwd_ret_2', 'fwd_ret_3')} FROM ({_RETURNS})")
def returns_and_vol(spark, d):
    return P.returns_and_vol(priced(spark, d)).select("sid", "day", *r6("ret", "vol_20d", "fwd_ret_1", "fwd_ret_2", "fwd_ret_3"))


@query("sigmas", f"SELECT sid, day, {s6('log_ret', 'sigma')} FROM sigmas")
def log_returns_ffill_vol(spark, d):
    return P.log_returns(priced(spark, d)).select("sid", "day", *r6("log_ret", "sigma"))


@query("logs", "SELECT sid, day, " + ", ".join(f"round(CASE WHEN count(log_ret) OVER (PARTITION BY sid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) = {k} THEN sum(log_ret) OVER (PARTITION BY sid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) END, 6) AS fwd_{k}" for k in (1, 3, 5)) + " FROM logs")
def fwd_sum_returns(spark, d):
    base = P.log_returns(priced(spark, d))
    return base.select("sid", "day", *[F.round(P.forward_sum("log_ret", P.by_day(), k), 6).alias(f"fwd_{k}") for k in (1, 3, 5)])


@query("sigmas listed", "SELECT sid, day, round(log_ret / sigma, 6) AS z, " + ", ".join(f"round(fwd_{k}, 6) AS fwd_{k}" for k in (1, 3, 5)) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN count(log_ret) OVER (PARTITION BY sid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) = {k} THEN sum(log_ret) OVER (PARTITION BY sid ORDER BY day ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING) END AS fwd_{k}" for k in (1, 3, 5)) + " FROM sigmas) JOIN listed USING (sid) WHERE date_diff('day', ipo, date) >= 120 AND sigma >= 1e-4")
def snapshot_panel(spark, d):
    rows = priced(spark, d).select("sid", F.col("date").alias("day"), "close")
    out = P.snapshot_panel(rows, listed(spark, d))
    return out.select("sid", F.date_format("day", "yyyyMMdd").cast("int").alias("day"), *r6("z", "fwd_1", "fwd_3", "fwd_5"))


@query("priced", "SELECT sid, day, round(ret, 6) AS ret, CASE WHEN ret < lo THEN 0 WHEN ret > hi THEN 2 ELSE 1 END AS macro_state FROM (SELECT *, CASE WHEN count(ret) OVER w >= 30 THEN quantile_cont(ret, 0.2) OVER w END AS lo, CASE WHEN count(ret) OVER w >= 30 THEN quantile_cont(ret, 0.8) OVER w END AS hi FROM (SELECT sid, day, coalesce(close / lag(close) OVER (PARTITION BY sid ORDER BY day) - 1, 0) AS ret FROM priced) WINDOW w AS (PARTITION BY sid ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) WHERE lo IS NOT NULL")
def rolling_macro_state(spark, d):
    return ST.rolling_macro(priced(spark, d)).select("sid", "day", *r6("ret"), "macro_state")


@query("priced", "SELECT sid, day, round(close * f.factor / l.factor, 6) AS close FROM (SELECT sid, day, close, day // 100 AS m FROM priced) p JOIN (SELECT sid, day // 100 AS m, 1 + (day // 100 % 100) / 100.0 AS factor FROM priced GROUP BY sid, day // 100) f USING (sid, m) JOIN (SELECT sid, arg_max(1 + (day // 100 % 100) / 100.0, day) AS factor FROM priced GROUP BY sid) l USING (sid)")
def adjusted_close(spark, d):
    rows = priced(spark, d).select("sid", "day", "close")
    month = F.floor(F.col("day") / 100)
    factors = rows.groupBy("sid", month.alias("m")).agg(F.min("day").alias("day")).select("sid", "day", (1 + (F.col("m") % 100) / 100.0).alias("factor"))
    return P.adjusted(rows, factors, ["close"]).select("sid", "day", *r6("close"))


# Universe


@query("months", f"SELECT sid, month_id, {s6('avg_amount')}, last_trade_date, days_since_ipo, trade_month_id FROM months")
def universe_monthly(spark, d):
    out = U.monthly(priced(spark, d).select("sid", "date", "amount"), listed(spark, d))
    return out.select("sid", "month_id", *r6("avg_amount"), "last_trade_date", F.col("days_since_ipo").cast("bigint").alias("days_since_ipo"), "trade_month_id")


@query("kept", f"SELECT sid, month_id, {s6('rank')}, n FROM kept WHERE rank <= 0.8 * n")
def universe_kept(spark, d):
    out = U.kept_by_rank(U.monthly(priced(spark, d).select("sid", "date", "amount"), listed(spark, d)))
    return out.select("sid", "month_id", *r6("rank"), "n")


@query("kept", "SELECT sid, day, round(p.close, 6) AS close FROM (SELECT *, CAST(strftime(date, '%Y%m') AS INT) AS m FROM priced) p WHERE volume > 0 AND high > low AND EXISTS (SELECT 1 FROM kept k WHERE k.rank <= 0.8 * k.n AND k.sid = p.sid AND k.trade_month_id = p.m)")
def universe_filtered(spark, d):
    rows = priced(spark, d).select("sid", "day", "date", "high", "low", "close", "volume", "amount")
    return U.universe(rows, listed(spark, d)).select("sid", "day", *r6("close"))


@query()
def stratified_sample(spark, d):
    turnover = daily_f(spark, d).groupBy("sid").agg(F.avg(F.coalesce("amount", F.col("volume") * F.col("close"), F.lit(0.0))).alias("turnover"))
    return U.stratified_sample(turnover)


@query("daily_f", "SELECT sid, round(t, 4) AS turnover FROM (SELECT *, row_number() OVER (ORDER BY t DESC, sid) AS i, count(*) OVER () AS n FROM (SELECT sid, avg(coalesce(amount, volume * close, 0)) AS t FROM daily_f GROUP BY sid)) WHERE i <= floor(n * 0.8)")
def top_fraction(spark, d):
    t = daily_f(spark, d).groupBy("sid").agg(F.avg(F.coalesce("amount", F.col("volume") * F.col("close"), F.lit(0.0))).alias("turnover"))
    ranked = global_index(t, [F.col("turnover").desc(), F.col("sid")], "i")
    n = ranked.count()
    return ranked.where(F.col("i") < int(n * 0.8)).select("sid", F.round("turnover", 4).alias("turnover"))


# Curves, states and chains


_CLEAN = "list_transform({0}, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END)"


@query("panel_d", f"SELECT sid, day, CAST(i - 1 AS BIGINT) AS pos, round(c[i], 6) AS v FROM (SELECT sid, day, c, unnest(range(1, len(c) + 1)) AS i FROM (SELECT sid, day, {_CLEAN.format('list_concat(lag_1, daily_curve)')} AS c FROM (SELECT sid, day, daily_curve, lag(daily_curve) OVER (PARTITION BY sid ORDER BY day) AS lag_1 FROM panel_d) WHERE lag_1 IS NOT NULL))")
def curve_lag_concat(spark, d):
    rows = TS.lagged_curves(panel(spark, d).select("sid", "day", "daily_curve"), 2).withColumn("x", F.transform(TS.joined_lags(2), X.zero_if_not_finite))
    return points(rows, "x", ["sid", "day"])


@query("macro", f"SELECT day, {s6('flow')}, macro_state FROM macro")
def macro_terciles(spark, d):
    return ST.macro_terciles(panel(spark, d)).select("day", *r6("flow"), "macro_state")


def binned(spark, d):
    p = panel(spark, d)
    return p.select("sid", "day", *[ST.return_bin(F.col(f"fwd_ret_{k}"), F.col("vol_20d"), k, 1.0).alias(f"bin_{k}") for k in (1, 2, 3)])


def labelled(spark, d):
    return binned(spark, d).join(ST.macro_terciles(panel(spark, d)).select("day", "macro_state"), "day")


@query("binned", "SELECT sid, day, bin_1, bin_2, bin_3 FROM binned")
def return_bins(spark, d):
    return binned(spark, d)


@query("cells", "SELECT step, from_state, to_state, n FROM cells")
def markov_counts(spark, d):
    return ST.transitions(labelled(spark, d), SE.CHAIN).drop("p")


@query("chain", "SELECT step, from_state, to_state, n, round(p, 6) AS p FROM chain")
def markov_probs(spark, d):
    return ST.transitions(labelled(spark, d), SE.CHAIN).select("step", "from_state", "to_state", "n", *r6("p"))


@query("chain", "SELECT macro_state, round(sum(s), 6) AS fsm_score FROM (" + " UNION ALL ".join([
    "SELECT a.from_state AS macro_state, 0.5 * a.p * [-1, -0.5, 0.5, 1][a.to_state + 1] AS s FROM chain a WHERE a.step = 'macro_state->bin_1'",
    "SELECT a.from_state, 0.3 * a.p * b.p * [-1, -0.5, 0.5, 1][b.to_state + 1] FROM chain a JOIN chain b ON a.step = 'macro_state->bin_1' AND b.step = 'bin_1->bin_2' AND a.to_state = b.from_state",
    "SELECT a.from_state, 0.2 * a.p * b.p * c.p * [-1, -0.5, 0.5, 1][c.to_state + 1] FROM chain a JOIN chain b ON a.step = 'macro_state->bin_1' AND b.step = 'bin_1->bin_2' AND a.to_state = b.from_state JOIN chain c ON c.step = 'bin_2->bin_3' AND b.to_state = c.from_state",
]) + ") GROUP BY macro_state")
def fsm_score(spark, d):
    chain = ST.transitions(labelled(spark, d), SE.CHAIN)
    return ST.state_scores(chain, [c for c, _ in SE.CHAIN]).select("macro_state", *r6("fsm_score"))


@query("panel_d", "SELECT sid, day, CAST(least(floor((row_number() OVER (PARTITION BY day ORDER BY fwd_ret_1, sid) - 1) / count(*) OVER (PARTITION BY day) * 5), 4) AS INT) AS bin FROM panel_d WHERE fwd_ret_1 IS NOT NULL AND NOT isnan(fwd_ret_1)")
def rank_bins(spark, d):
    return ST.rank_bins(panel(spark, d).select("sid", "day", "fwd_ret_1"), "day", "fwd_ret_1", 5, "sid").select("sid", "day", "bin")


@query("", "WITH e AS (SELECT user_id % 3 AS state, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS b FROM events WHERE value IS NOT NULL), g AS (SELECT i.r AS state, j.r AS b FROM (SELECT unnest(range(3)) AS r) i, (SELECT unnest(range(4)) AS r) j), c AS (SELECT state, b, count(*) AS n FROM e GROUP BY ALL) SELECT CAST(g.state AS INT) AS state, round(sum((coalesce(n, 0) + 1) / t.t * [5, 30, 75, 150][g.b + 1]), 6) AS expected_ret FROM g LEFT JOIN c ON g.state = c.state AND g.b = c.b JOIN (SELECT state, count(*) + 4 AS t FROM e GROUP BY state) t ON t.state = g.state GROUP BY g.state")
def expected_return(spark, d):
    edges = F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0))
    rows = read(spark, d, "events").select((F.col("user_id") % 3).cast("int").alias("state"), X.digitize(F.col("value"), edges).alias("bin"))
    return ST.expected_return(ST.posterior(rows, "state", "bin", 3, 4), [5, 30, 75, 150]).select("state", *r6("expected_ret"))


# Statistics


@query("panel_d", "SELECT n1, n2, round(u, 3) AS u, round((u - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM (SELECT n1, n2, r1 - n1 * (n1 + 1) / 2 AS u, ties FROM (SELECT sum(a) AS n1, sum(b) AS n2, sum(a * rank) AS r1, sum(t * t * t - t) AS ties FROM (SELECT a, b, t, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2 AS rank FROM (SELECT fwd_ret_1 AS v, CAST(count(*) FILTER (vol_20d > 0.02) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT coalesce(vol_20d > 0.02, false)) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS t FROM panel_d WHERE fwd_ret_1 IS NOT NULL AND NOT isnan(fwd_ret_1) GROUP BY fwd_ret_1))))")
def mann_whitney_u(spark, d):
    out = SS.mann_whitney(panel(spark, d), "fwd_ret_1", F.coalesce(F.col("vol_20d") > 0.02, F.lit(False)))
    return out.select(F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), F.round("u", 3).alias("u"), *r6("z"))


@query("", "SELECT event_type, sum(a) AS n1, sum(b) AS n2, round(max(abs(ca / ta - cb / tb)), 6) AS d FROM (SELECT event_type, a, b, sum(a) OVER (PARTITION BY event_type ORDER BY v) AS ca, sum(a) OVER (PARTITION BY event_type) AS ta, sum(b) OVER (PARTITION BY event_type ORDER BY v) AS cb, sum(b) OVER (PARTITION BY event_type) AS tb FROM (SELECT event_type, value AS v, CAST(count(*) FILTER (user_id % 2 = 0) AS DOUBLE) AS a, CAST(count(*) FILTER (user_id % 2 = 1) AS DOUBLE) AS b FROM events WHERE value IS NOT NULL GROUP BY event_type, value)) GROUP BY event_type")
def ks_stat(spark, d):
    out = SS.ks_statistic(read(spark, d, "events"), "value", F.col("user_id") % 2 == 0, ["event_type"])
    return out.select("event_type", F.col("n1").cast("double").alias("n1"), F.col("n2").cast("double").alias("n2"), *r6("d"))


@query("", "WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY event_type), dev AS (SELECT event_type, any_value(med) AS med, quantile_cont(abs(value - med), 0.5) AS mad FROM events JOIN m USING (event_type) GROUP BY event_type) SELECT event_id, round((value - med) / (1.4826 * mad + 1e-8), 6) AS robust_z FROM events JOIN dev USING (event_type)")
def mad_znorm(spark, d):
    return M.mad_znormed(read(spark, d, "events"), ["event_type"], "value").select("event_id", *r6("robust_z"))


@query("", "SELECT score_id, round(-log10(greatest(exp(-distance), 1e-300)) * abs(fsm_score) * 1e4 * CASE WHEN macro_state * 40 > 48 THEN exp(-(macro_state * 40 - 48) / 50.0) ELSE 1 END, 6) AS objective FROM (SELECT DISTINCT * FROM scores) WHERE fsm_score IS NOT NULL AND NOT isnan(fsm_score) AND macro_state IS NOT NULL")
def objective_score(spark, d):
    rows = read(spark, d, "scores").distinct().where("fsm_score is not null and not isnan(fsm_score) and macro_state is not null")
    return rows.select("score_id", F.round(X.smooth_objective(F.exp(-F.col("distance")), F.col("fsm_score"), F.col("macro_state") * 40, 48), 6).alias("objective"))


def bins(fitted: DataFrame, key: str, edge_digits: int, centre_digits: int) -> DataFrame:
    """A row per bin of a key: its lower edge (null for the first) and its centre, rounded.

    A mean of decimals often lies just half way between two rounded values, and then the order of its sum would decide. So
    centres are rounded twice, first to eight digits more, which takes that noise away.
    """
    rows = fitted.select(key, "edges", F.posexplode("centres").alias("bin", "centre"))
    return rows.select(key, "bin", F.round(F.when(F.col("bin") > 0, F.get("edges", F.col("bin") - 1)), edge_digits).alias("edge"), F.round(F.round("centre", centre_digits + 8), centre_digits).alias("centre"))


@query()
def gpd_tail_bins(spark, d):
    return bins(TL.gpd_bins(read(spark, d, "events"), "value", "event_type"), "event_type", 5, 4)


@query()
def rolling_gpd_bins(spark, d):
    return bins(TL.rolling_gpd(panel(spark, d), "day", "fwd_ret_1"), "day", 7, 6)


# Motifs

MOTIF = [0.0, 0.1, 0.25, 0.4, 0.5, 0.55, 0.5, 0.35, 0.2, 0.1, 0.0, -0.05]
_Z = "list_transform({0}, lambda x: (x - list_avg({0})) / (sqrt(list_avg(list_transform({0}, lambda y: (y - list_avg({0})) * (y - list_avg({0}))))) + 1e-8))"


def finite_curves(spark, d):
    return panel(spark, d).select("sid", "day", F.transform("daily_curve", X.zero_if_not_finite).alias("curve"))


@query("panel_d", f"""SELECT sid, day, round(min(sqrt(list_sum(list_transform(list_zip(z, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))), 6) AS distance FROM (
    SELECT sid, day, {_Z.format('w')} AS z, {_Z.format('q')} AS m FROM (SELECT sid, day, c[i : i + 11] AS w, {MOTIF}::DOUBLE[] AS q FROM (
        SELECT sid, day, c, CAST(unnest(range(1, len(c) - 10)) AS INT) AS i FROM (SELECT sid, day, list_transform(daily_curve, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END) AS c FROM panel_d)))) GROUP BY sid, day""")  # fmt: skip
def motif_euclid_min(spark, d):
    return finite_curves(spark, d).select("sid", "day", F.round(M.euclidean_least(F.col("curve"), MOTIF), 6).alias("distance"))


SQL_BAND_1 = SQL["motif_euclid_min"]


@query()
def dtw_min_subseq(spark, d):
    return finite_curves(spark, d).select("sid", "day", F.round(M.subsequence_distance(F.col("curve"), MOTIF, 3, 1e9), 6).alias("distance"))


@query()
def dtw_band_1(spark, d):
    return finite_curves(spark, d).select("sid", "day", F.round(M.subsequence_distance(F.col("curve"), MOTIF, 1, 1e9), 6).alias("distance"))


SQL["dtw_band_1"] = SQL_BAND_1


@query()
def matrix_profile(spark, d):
    profile = M.matrix_profile(finite_curves(spark, d), ["sid", "day"], "curve", 12)
    # A series is named sid|day.
    return profile.select(F.regexp_replace("series", r"\|[^|]*$", "").alias("sid"), "series", "pos", *r6("distance"))


@query()
def motif_topk(spark, d):
    picks = M.top_motifs(finite_curves(spark, d), ["sid", "day"], "curve", 12)
    return spark.createDataFrame([(a, b, round(x, 6)) for a, b, x in picks], "series string, pos int, distance double")


# Residuals


def _residual(signal):
    def run(spark, d):
        return RS.residuals(skeleton(spark, d), signal).select("sid", "day", "minute_idx", F.round("residual", 6).alias("residual"), F.round("cum", 6).alias("cum"))

    return run


_PRICE = {"close": "close", "vwap": "CASE WHEN volume > 0 THEN amount / volume ELSE close END", "vpt": "close"}
for _s, _p in _PRICE.items():
    QUERIES[f"residual_{_s}"] = _residual(_s)
    _w = "* CASE WHEN avg(volume) OVER (PARTITION BY sid, day) > 0 THEN volume / avg(volume) OVER (PARTITION BY sid, day) ELSE 1 END" if _s == "vpt" else ""
    SQL[f"residual_{_s}"] = _with("skeleton", f"SELECT sid, day, minute_idx, round(residual, 6) AS residual, round(sum(residual) OVER (PARTITION BY sid ORDER BY day, minute_idx ROWS UNBOUNDED PRECEDING), 6) AS cum FROM (SELECT sid, day, minute_idx, (ret - quantile_cont(ret, 0.5) OVER (PARTITION BY day, minute_idx)) {_w} AS residual FROM (SELECT *, coalesce(ln(CASE WHEN p > 0 THEN p END) - lag(ln(CASE WHEN p > 0 THEN p END)) OVER (PARTITION BY sid ORDER BY day, minute_idx), 0) AS ret FROM (SELECT *, {_p} AS p FROM skeleton)))")


_CUM = SQL["residual_close"].replace("round(residual, 6) AS residual, round(", "residual, close, (").replace("ROWS UNBOUNDED PRECEDING), 6) AS cum", "ROWS UNBOUNDED PRECEDING)) AS cum").replace("SELECT sid, day, minute_idx, (ret -", "SELECT sid, day, minute_idx, close, (ret -")


@query("", f"SELECT sid, day, CAST(i - 1 AS BIGINT) AS pos, round(c[i], 5) AS v FROM (SELECT sid, day, c, unnest(range(1, 13)) AS i FROM (SELECT *, array_agg(v) OVER (PARTITION BY sid ORDER BY day, bucket ROWS 11 PRECEDING) AS c, stddev_pop(p) OVER (PARTITION BY sid ORDER BY day, bucket ROWS 2 PRECEDING) AS sd, row_number() OVER (PARTITION BY sid, day ORDER BY bucket DESC) AS back FROM (SELECT sid, day, CAST(ceil(minute_idx / 5) AS INT) AS bucket, max(minute_idx) AS newest, arg_max(cum, minute_idx) * 1000 AS v, arg_max(close, minute_idx) AS p FROM ({_CUM}) WHERE minute_idx <= 235 GROUP BY 1, 2, 3)) WHERE back = 1 AND len(c) = 12 AND newest >= 225 AND sd >= 1e-5)")
def eod_feature_window(spark, d):
    sk = skeleton(spark, d)
    return points(RS.eod_features(RS.residuals(sk).select("sid", "day", "minute_idx", "cum"), sk), "curve", ["sid", "day"], 5)


# Reports and relational pieces


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
MOST_METRICS = 1000


def metric_names(log: DataFrame, name: str) -> list[str]:
    """The metrics of a log, which become columns; more than MOST_METRICS are refused."""
    found = sorted(r[0] for r in log.select(name).where(F.col(name).isNotNull()).distinct().limit(MOST_METRICS + 1).collect())
    if len(found) > MOST_METRICS:
        raise ValueError("too many metrics for columns")
    return found


@query("", "SELECT date_trunc('hour', ts) AS hour, " + ", ".join(f"round(max(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in EVENT_TYPES) + " FROM events GROUP BY 1")
def pivot_metric_max(spark, d):
    rows = read(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return rows.groupBy("hour").pivot("event_type", metric_names(rows, "event_type")).agg(F.round(F.max("value"), 6))


@query("", "SELECT user_id, hour, " + ", ".join(f"round(last_value({t} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) AS {t}" for t in EVENT_TYPES) + " FROM (SELECT user_id, date_trunc('hour', ts) AS hour, " + ", ".join(f"(max({{'a': ts, 'b': event_id, 'v': value}}) FILTER (event_type = '{t}')).v AS {t}" for t in EVENT_TYPES) + " FROM events WHERE value IS NOT NULL GROUP BY 1, 2)")
def pivot_metric_log(spark, d):
    e = read(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    names = metric_names(e, "event_type")
    return TS.wide_metrics(e, ["user_id", "hour"], "event_type", "value", ["ts", "event_id"], names).select("user_id", "hour", *r6(*names))


@query("ticks", "SELECT b.datetime, round(b.close, 6) AS close, coalesce(f.buy, 0) AS buy, coalesce(f.sell, 0) AS sell FROM (SELECT day AS datetime, max({'a': s, 'v': close}).v AS close FROM ticks WHERE sid = 'QA0000000' GROUP BY day) b LEFT JOIN (SELECT day AS datetime, sum(CASE WHEN close >= open THEN volume END) AS buy, sum(CASE WHEN close < open THEN volume END) AS sell FROM ticks WHERE sid = 'QA0000000' AND open IS NOT NULL GROUP BY day) f USING (datetime)")
def orders_dashboard_sql(spark, d):
    t = ticks(spark, d)
    b = t.groupBy("sid", F.col("day").alias("datetime")).agg(F.max(F.struct("at", "close")).alias("c")).select(F.lit("bar").alias("table_type"), "sid", "datetime", F.round("c.close", 6).alias("close"))
    o = t.where("open is not null").select(F.lit("fill").alias("table_type"), "sid", F.col("day").alias("datetime"), F.when(F.col("close") >= F.col("open"), "BUY").otherwise("SELL").alias("direction"), F.col("volume").alias("size"))
    return R.dashboard(io.union_all([b, o]), "QA0000000", "bar", "fill").select("datetime", "close", "buy", "sell")


@query("", "SELECT event_id, (SELECT min(o_orderdate) FROM (SELECT DISTINCT o_orderdate FROM orders) o WHERE o.o_orderdate >= e.ts) AS clock_ts FROM events e")
def asof_align(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("ts"))
    clock = read(spark, d, "orders").select(F.col("o_orderdate").cast(dict(e.dtypes)["ts"]).alias("ts"))
    return TS.asof_index(e, clock, "ts").select("event_id", "clock_ts")


@query("panel_d", "SELECT coalesce(a.day, b.day) AS day, a.n_panel, b.n_scores FROM (SELECT day, count(*) AS n_panel FROM panel_d GROUP BY day) a FULL OUTER JOIN (SELECT day, count(*) AS n_scores FROM (SELECT DISTINCT * FROM scores) WHERE day IS NOT NULL GROUP BY day) b ON a.day = b.day")
def outer_merge(spark, d):
    a = panel(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n_panel"))
    b = read(spark, d, "scores").distinct().where("day is not null").groupBy("day").agg(F.count(F.lit(1)).alias("n_scores"))
    return TS.outer_merge([a, b], ["day"])


@query("daily_f", "SELECT sid, count(*) AS n FROM daily_f WHERE sid IN (SELECT sid FROM panel) GROUP BY sid")
def semi_membership(spark, d):
    return daily_f(spark, d).join(read(spark, d, "panel").select("sid"), "sid", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("", "SELECT s.score_id, max(u.month_id) AS month_id FROM (SELECT DISTINCT score_id, sid, day FROM scores WHERE sid IS NOT NULL AND day IS NOT NULL) s LEFT JOIN universe_month u ON u.sid = s.sid AND u.month_id <= CAST(strftime(s.day, '%Y%m') AS INT) GROUP BY s.score_id")
def latest_le_lookup(spark, d):
    s = read(spark, d, "scores").where("sid is not null and day is not null").select("score_id", "sid", "day").distinct().withColumn("at", F.date_format("day", "yyyyMM").cast("int")).drop("day")
    u = read(spark, d, "universe_month").where("sid is not null").select("sid", F.col("month_id").alias("at")).distinct()
    # A sid's months are one short list, so a hot sid's scores are parted as in any join with a row per key.
    months = u.groupBy("sid").agg(F.sort_array(F.collect_set("at")).alias("months"))
    joined = spread_join(s, months, ["sid"], how="left")
    return joined.groupBy("score_id").agg(F.max(F.array_max(F.filter("months", lambda m: m <= F.col("at")))).alias("month_id"))


@query("daily_f", f"SELECT sid, day, {s6('body_top', 'body_bottom', 'upper_wick', 'lower_wick')}, close >= open AS up, open < close AS rises FROM (SELECT *, greatest(open, close) AS body_top, least(open, close) AS body_bottom, high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick FROM daily_f WHERE open IS NOT NULL AND close IS NOT NULL)")
def candle_shapes(spark, d):
    return R.candle_shapes(daily_f(spark, d).where("open is not null and close is not null")).select("sid", "day", *r6("body_top", "body_bottom", "upper_wick", "lower_wick"), "up", "rises")


@query("priced", "SELECT sid, day, round(lo + volume / v * (hi - lo) * 0.15, 4) AS volume_y FROM priced JOIN (SELECT sid, min(low) AS lo, max(high) AS hi, max(volume) AS v FROM priced GROUP BY sid) s USING (sid) WHERE v > 0 AND volume IS NOT NULL")
def volume_scale(spark, d):
    return R.volume_overlay(priced(spark, d), ["sid"]).where("volume is not null").select("sid", "day", F.round("volume_y", 4).alias("volume_y"))


@query("daily_f", "SELECT sid, day, CASE WHEN volume > 1.2 * v THEN '' ELSE CAST(CAST(trunc(volume / 1000.0 ** k) AS BIGINT) AS VARCHAR) || ['', 'K', 'M', 'G', 'T', 'P'][k + 1] END AS volume_label FROM (SELECT *, CASE WHEN v < 1e3 THEN 0 WHEN v < 1e6 THEN 1 WHEN v < 1e9 THEN 2 WHEN v < 1e12 THEN 3 WHEN v < 1e15 THEN 4 ELSE 5 END AS k FROM daily_f JOIN (SELECT sid, max(volume) / 2 AS v FROM daily_f GROUP BY sid) s USING (sid) WHERE volume IS NOT NULL)")
def volume_labels(spark, d):
    rows = daily_f(spark, d)
    # An axis that ends at half the greatest volume, so that some labels are blank.
    v = rows.groupBy("sid").agg((F.max("volume") / 2).alias("v"))
    return rows.where("volume is not null").join(v, "sid").select("sid", "day", X.volume_label(F.col("volume"), F.col("v")).alias("volume_label"))


@query("daily_f", "SELECT sid, day, i AS index, CAST(least(floor(i / greatest(floor(n / 7), 1)), 6) AS INT) AS page FROM (SELECT sid, day, row_number() OVER (ORDER BY day, sid) - 1 AS i, count(*) OVER () AS n FROM daily_f)")
def page_ranges(spark, d):
    return R.paged(daily_f(spark, d).select("sid", "day"), ["day", "sid"], 7)


@query("", "SELECT sid, count(*) AS n FROM (SELECT sid FROM daily UNION ALL SELECT sid FROM tick UNION ALL SELECT sid FROM panel UNION ALL SELECT sid FROM instrument) GROUP BY sid")
def union_sids(spark, d):
    return io.union_all([read(spark, d, t).select("sid") for t in ("daily", "tick", "panel", "instrument")]).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("", "SELECT DISTINCT sid FROM (SELECT sid FROM daily UNION ALL SELECT sid FROM tick)")
def union_distinct_sids(spark, d):
    return io.union_all([read(spark, d, t).select("sid") for t in ("daily", "tick")]).distinct()


@query("", "SELECT 'any' AS how, sid, day, recv_at FROM daily WHERE open IS NOT NULL AND close IS NOT NULL AND NOT isnan(close) UNION ALL SELECT 'all', sid, day, recv_at FROM daily WHERE open IS NOT NULL OR (close IS NOT NULL AND NOT isnan(close))")
def dropna_variants(spark, d):
    rows = read(spark, d, "daily").select("sid", "day", F.col("recv_at").cast("timestamp_ntz").alias("recv_at"), "open", "close")
    return io.union_all([rows.dropna(how=how, subset=["open", "close"]).select(F.lit(how).alias("how"), "sid", "day", "recv_at") for how in ("any", "all")])


@query("priced", "SELECT sid, day, round(coalesce(c, 0), 6) AS close, round(coalesce(v, 0), 6) AS volume FROM (SELECT sid, day, lag(close) OVER (PARTITION BY sid ORDER BY day) AS c, lag(volume) OVER (PARTITION BY sid ORDER BY day) AS v FROM priced) WHERE c IS NOT NULL OR v IS NOT NULL")
def shift_columns(spark, d):
    return TS.shifted(priced(spark, d), ["sid"], ["day"], ["close", "volume"]).select("sid", "day", *r6("close", "volume"))


@query("priced panel_d", "SELECT sid, day, round(coalesce(v, 0), 6) AS vol_20d FROM (SELECT sid, date AS day FROM priced) LEFT JOIN (SELECT sid, day, max(CASE WHEN isnan(vol_20d) THEN NULL ELSE vol_20d END) AS v FROM panel_d GROUP BY sid, day) USING (sid, day)")
def aligned_indicator(spark, d):
    axis = priced(spark, d).select(F.struct("sid", F.col("date").alias("day")).alias("k"))
    line = panel(spark, d).select(F.struct("sid", "day").alias("k"), "vol_20d")
    return R.aligned_indicator(axis, line, "k", "vol_20d").select("k.sid", "k.day", *r6("vol_20d"))


@query("daily_f", "SELECT sid, day, high > close AS above, high < close AS below FROM daily_f WHERE high IS NOT NULL AND close IS NOT NULL")
def fill_masks(spark, d):
    return R.fill_masks(daily_f(spark, d).where("high is not null and close is not null"), "high", "close").select("sid", "day", "above", "below")


@query("", "SELECT event_type, CAST(i // 6 AS INT) AS tab, CAST(i % 6 AS INT) AS place, CAST(i % 10 AS INT) AS colour FROM (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM events))")
def tabbed_names(spark, d):
    return R.tabbed(read(spark, d, "events"), "event_type")


@query("", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND 1 PRECEDING) AS recent FROM events")
def recent_events(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return e.select("event_id", F.count(F.lit(1)).over(W.partitionBy("user_id").orderBy("us").rangeBetween(-60_000_000, -1)).alias("recent"))


@query("", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_field(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("", "SELECT 'suppliers' AS file, CAST(row_number() OVER (ORDER BY s_suppkey) + 1 AS INT) AS line_no, CAST(s_suppkey AS VARCHAR) AS id, b AS block, CASE b WHEN 'x' THEN s_name ELSE 'n' || s_nationkey END AS at, f AS field, round(CASE WHEN b = 'x' AND f = 'bal' THEN s_acctbal WHEN b = 'x' THEN s_nationkey WHEN s_suppkey % 2 = 0 THEN s_suppkey END, 2) AS value FROM supplier, (VALUES ('x', 'bal'), ('x', 'nation'), ('y', 'even')) v(b, f) UNION ALL SELECT 'regions', CAST(row_number() OVER (ORDER BY r_regionkey) + 1 AS INT), CAST(r_regionkey AS VARCHAR), 'z', r_name, 'key', r_regionkey FROM region".replace("row_number() OVER (ORDER BY s_suppkey)", "dense_rank() OVER (ORDER BY s_suppkey)"))
def block_split(spark, d):
    def file(name, table, key, header, row):
        rows = global_index(read(spark, d, table), [F.col(key)], "i").select((F.col("i") + 2).cast("int").alias("line_no"), row.alias("value"))
        head = spark.createDataFrame([(0, "a title"), (1, header)], "line_no int, value string")
        return head.unionByName(rows).withColumn("file", F.lit(name))

    text = lambda c: F.col(c).cast("string")
    suppliers = file("suppliers", "supplier", "s_suppkey", "id;x;bal,nation;y;even", F.concat_ws(";", text("s_suppkey"), "s_name", F.concat_ws(",", text("s_acctbal"), text("s_nationkey")), F.concat(F.lit("n"), text("s_nationkey")), F.when(F.col("s_suppkey") % 2 == 0, text("s_suppkey")).otherwise("")))
    regions = file("regions", "region", "r_regionkey", "id;z;key", F.concat_ws(";", text("r_regionkey"), "r_name", text("r_regionkey")))
    return io.block_rows(suppliers.unionByName(regions), file="file").withColumn("value", F.round("value", 2))


# Scans, curves and side-by-side tables


@query("", "SELECT DISTINCT sid, first_trading, delist FROM instrument WHERE delist > 20050101")
def instrument_live(spark, d):
    return io.live_instruments(read(spark, d, "instrument"), 20050101)


@query("daily_f", "SELECT sid, day, day < 20050101 AS warm_up FROM daily_f WHERE day BETWEEN 20040101 AND 20050630")
def warm_range_scan(spark, d):
    return io.warm_range(daily_f(spark, d), "day", 20050101, 20050630).select("sid", "day", "warm_up")


@query("", "SELECT r_name, n_name FROM (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) FULL OUTER JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) USING (i)")
def positional_concat(spark, d):
    a, b = read(spark, d, "region").select("r_name", "r_regionkey"), read(spark, d, "nation").select("n_name", "n_nationkey")
    return TS.positional_concat(a, b, ["r_regionkey"], ["n_nationkey"]).select("r_name", "n_name")


@query("panel_d", f"SELECT sid, day, CAST(i - 1 AS BIGINT) AS pos, round(z[i], 5) AS v FROM (SELECT sid, day, z, unnest(range(1, len(z) + 1)) AS i FROM (SELECT sid, day, {_Z.format('c')} AS z FROM (SELECT sid, day, {_CLEAN.format('daily_curve')} AS c FROM panel_d)))")
def curve_znorm(spark, d):
    return points(finite_curves(spark, d).select("sid", "day", X.znorm(F.col("curve")).alias("z")), "z", ["sid", "day"], 5)


@query("", "WITH e AS (SELECT CAST(user_id % 3 AS INT) AS s, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS b FROM events WHERE value IS NOT NULL) SELECT i.r AS from_state, j.r AS to_state, (SELECT count(*) FROM e WHERE e.s = i.r AND e.b = j.r) AS n FROM (SELECT CAST(unnest(range(3)) AS INT) AS r) i, (SELECT CAST(unnest(range(4)) AS INT) AS r) j")
def digitize_posterior(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 3).cast("int").alias("state"), X.digitize(F.col("value"), F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0))).alias("bin"))
    return ST.posterior(rows, "state", "bin", 3, 4).select("from_state", "to_state", "n")


@query("daily_f", "SELECT round(quantile_cont(close, 1 / 3.0), 4) AS linear_low, round(quantile_cont(close, 2 / 3.0), 4) AS linear_high, any_value(n.lo) AS near_low, any_value(n.hi) AS near_high FROM daily_f, (SELECT round(v[1 + CAST(round((len(v) - 1) / 3.0) AS INT)], 4) AS lo, round(v[1 + CAST(round((len(v) - 1) * 2 / 3.0) AS INT)], 4) AS hi FROM (SELECT list_sort(list(m)) AS v FROM (SELECT day, avg(close) AS m FROM daily_f GROUP BY day))) n")
def quantile_modes(spark, d):
    rows = daily_f(spark, d)
    linear = exact_quantiles(rows, [], "close", {"linear_low": 1 / 3, "linear_high": 2 / 3}).select(*[F.round(c, 4).alias(c) for c in ("linear_low", "linear_high")])
    lo, hi = ST.tercile_bounds(rows.groupBy("day").agg(F.avg("close").alias("m")), "m")
    return linear.withColumn("near_low", F.round(F.lit(lo), 4)).withColumn("near_high", F.round(F.lit(hi), 4))


@query("flow_bars panel_d", "SELECT sid, date_part('year', day) * 10000 + date_part('month', day) * 100 + date_part('day', day) AS day, round(c.total, 6) AS total, round(fwd_ret_1, 6) AS fwd_ret_1 FROM (SELECT sid, DATE '1970-01-01' + day AS day, sum(ofi_ratio) AS total FROM flow_bars GROUP BY sid, day) c JOIN panel_d USING (sid, day)")
def curve_panel_join(spark, d):
    curves = TS.daily_curves(TS.flow_ratio_bars(skeleton(spark, d)), length=48).withColumn("day", F.date_from_unix_date("day"))
    rows = curves.select("sid", "day", F.round(X.array_sum(F.col("daily_curve")), 6).alias("total")).join(panel(spark, d).select("sid", "day", *r6("fwd_ret_1")), ["sid", "day"])
    return rows.withColumn("day", F.date_format("day", "yyyyMMdd").cast("bigint"))


@query("panel_d priced", f"SELECT l.sid, l.day, CAST(i - 1 AS BIGINT) AS pos, round(a[i], 6) AS lag_0, round(b[i], 6) AS lag_1, l.curve_len, {s6('vol_20d', 'fwd_ret_1', 'fwd_ret_2', 'fwd_ret_3')} FROM (SELECT sid, day, a, b, curve_len, unnest(range(1, len(a) + 1)) AS i FROM (SELECT sid, day, {_CLEAN.format('daily_curve')} AS a, {_CLEAN.format('lag(daily_curve) OVER (PARTITION BY sid ORDER BY day)')} AS b, curve_len FROM panel_d) WHERE b IS NOT NULL) l JOIN ({_RETURNS}) r ON l.sid = r.sid AND l.day = r.date")
def research_panel(spark, d):
    curves = panel(spark, d).select("sid", "day", F.transform("daily_curve", X.zero_if_not_finite).alias("daily_curve"), "curve_len")
    daily = priced(spark, d).select("sid", F.col("date").alias("day"), "close")
    out = P.research_panel(curves, daily, 2)
    both = out.select("sid", "day", "curve_len", *r6("vol_20d", "fwd_ret_1", "fwd_ret_2", "fwd_ret_3"), F.posexplode(F.arrays_zip("lag_0", "lag_1")).alias("pos", "p"))
    return both.select("sid", "day", F.col("pos").cast("bigint").alias("pos"), F.round("p.lag_0", 6).alias("lag_0"), F.round("p.lag_1", 6).alias("lag_1"), "curve_len", "vol_20d", "fwd_ret_1", "fwd_ret_2", "fwd_ret_3")


# Streams, drained over what is there


def _events(spark, d):
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


@query("", "WITH e AS (SELECT CAST(user_id % 3 AS INT) AS s, CASE WHEN value < 10 THEN 0 WHEN value < 50 THEN 1 WHEN value < 100 THEN 2 ELSE 3 END AS b FROM events WHERE value IS NOT NULL) SELECT i.r AS state, j.r AS bin, (SELECT count(*) FROM e WHERE e.s = i.r AND e.b = j.r) + 1 AS n FROM (SELECT CAST(unnest(range(3)) AS INT) AS r) i, (SELECT CAST(unnest(range(4)) AS INT) AS r) j")
def stream_event_posterior(spark, d):
    bin_ = X.digitize(F.col("value"), F.array(F.lit(10.0), F.lit(50.0), F.lit(100.0)))
    rows = _events(spark, d).select((F.col("user_id") % 3).cast("int").alias("state"), bin_.alias("bin"))
    out = online.latest(online.drain(online.posterior_counts(rows, "state", "bin", 4), new_path(spark, "stream"), "update"), ["state"])
    return out.select("state", F.posexplode("counts").alias("bin", "n"))


@query("", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_tumbling(spark, d):
    out = online.drain(online.tumbling(_events(spark, d), "ts", ["event_type"], "value"), new_path(spark, "stream"))
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, g HAVING max(ts) + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_sessions(spark, d):
    out = online.drain(online.sessions(_events(spark, d), "ts", "user_id"), new_path(spark, "stream"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("", """WITH RECURSIVE o AS (SELECT event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i FROM events),
    w AS (SELECT event_type, i, us, [us] AS recent, true AS accepted FROM o WHERE i = 1 UNION ALL
        SELECT o.event_type, o.i, o.us, CASE WHEN len(list_filter(w.recent, lambda x: x > o.us - 60000000)) < 1 THEN list_append(list_filter(w.recent, lambda x: x > o.us - 60000000), o.us) ELSE list_filter(w.recent, lambda x: x > o.us - 60000000) END,
            len(list_filter(w.recent, lambda x: x > o.us - 60000000)) < 1 FROM w JOIN o ON o.event_type = w.event_type AND o.i = w.i + 1)
    SELECT event_type, us, accepted FROM w""")
def stream_rate_limit(spark, d):
    """At most one event of a type a minute."""
    out = online.drain(online.rate_limited(_events(spark, d), "ts", "event_type", 1), new_path(spark, "stream"))
    return out.select("event_type", F.unix_micros("ts").alias("us"), "accepted")
