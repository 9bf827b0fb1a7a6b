"""Queries of the general data problems: implausible readings, regular grid, trailing periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.inforce import date_yyyymmdd, in_force, yyyymmdd_date, yyyymmdd_position
from tidemark.operators.regrid import epoch_seconds, regular_grid, session_minute
from tidemark.operators.spikes import implausible_readings
from tidemark.operators.trailing import daily_totals, trailing

PRICES = ["open", "high", "low", "close", "volume", "amount"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _daily(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    return in_force(_read(spark, sf_dir, "daily"), ["sid", "day"], "recv_at", columns)


def p1_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implausible readings of the daily rows in force, with value and reason."""
    return implausible_readings(_daily(spark, sf_dir, PRICES), "sid", "day", yyyymmdd_position(F.col("day")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_readings(spark, sf_dir).select("sid", "day", "field")


def p2_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per session minute of each (sid, day) with a usable reading: close, volume, whether it was filled."""
    ticks = _read(spark, sf_dir, "tick").where("tick is not null and close > 0 and not isnan(close) and not isnan(tick)")
    seconds = epoch_seconds(F.col("tick"))
    # Exact duplicates are found by what the grid needs and a hash of the whole row, so nothing else is shuffled.
    narrow = ticks.select("sid", seconds.alias("at"), "close", F.col("volume").cast("double").alias("volume"), F.xxhash64(*ticks.columns).alias("row_hash")).where(session_minute(F.col("at")).isNotNull())
    readings = narrow.distinct().select(
        F.col("sid").alias("source"), F.floor(F.col("at") / 86400).cast("int").alias("day"), session_minute(F.col("at")).alias("slot"), "at", F.ln("close").alias("y"), "volume"
    )
    return regular_grid(readings).select(
        F.col("source").alias("sid"), date_yyyymmdd(F.date_from_unix_date("day")).alias("day"), F.col("slot").alias("minute_idx"),
        F.exp("value").alias("close"), "volume", "n_readings", "filled",
    )


def p2_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid without predicted values: the close of minutes that have a reading, volume and readings of all."""
    return p2_grid(spark, sf_dir).select("sid", "day", "minute_idx", F.when(~F.col("filled"), F.round("close", 6)).alias("close"), F.round("volume", 3).alias("volume"), "n_readings", "filled")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_grid(spark, sf_dir).where("filled and close > 0").select("sid", "day", "minute_idx")


def _amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _daily(spark, sf_dir, ["close", "volume", "amount"])
    traded = F.col("volume") * F.col("close")
    amount = F.coalesce(F.col("amount"), F.when(~F.isnan(traded), traded), F.lit(0.0))
    return daily_totals(daily, "sid", F.unix_date(yyyymmdd_date(F.col("day"))), {"amount": amount, "close": F.col("close")})


def _vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _read(spark, sf_dir, "panel").select("sid", "day", "vol_20d").distinct()
    return daily_totals(panel, "sid", F.unix_date("day"), {"vol_20d": F.col("vol_20d")})


def _numbered(out: DataFrame) -> DataFrame:
    return out.withColumnRenamed("entity", "sid").withColumn("day", date_yyyymmdd(F.date_from_unix_date("day")))


def _trailing_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(trailing(_amounts(spark, sf_dir), ["amount", "close"]))


def _trailing_vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(trailing(_vols(spark, sf_dir), ["vol_20d"]))


def _rounded(out: DataFrame, measures: dict[str, int]) -> DataFrame:
    """Sums run in any order, so totals and averages are given to a number of digits."""
    columns = [c for m, digits in measures.items() for p in (7, 30) for c in (F.round(f"{m}_total_{p}", digits).alias(f"{m}_total_{p}"), F.col(f"{m}_n_{p}"), F.round(f"{m}_avg_{p}", digits).alias(f"{m}_avg_{p}"))]
    return out.select("sid", "day", *columns)


def p5_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of amount and close over 7 and 30 calendar days, for each sid and calendar day."""
    return _rounded(_trailing_amounts(spark, sf_dir), {"amount": 1, "close": 7})


def p5_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of vol_20d over 7 and 30 calendar days."""
    return _rounded(_trailing_vols(spark, sf_dir), {"vol_20d": 10})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = _trailing_amounts(spark, sf_dir).where("amount_total_7 > 0.5 * amount_total_30").select(F.lit("amount").alias("measure"), "sid", "day")
    vol = _trailing_vols(spark, sf_dir).where("vol_20d_avg_7 > 1.3 * vol_20d_avg_30").select(F.lit("vol_20d").alias("measure"), "sid", "day")
    return amount.unionByName(vol)


QUERIES = {"p1_readings": p1_readings, "p1_found": p1_found, "p2_grid": p2_grid, "p2_slots": p2_slots, "p2_found": p2_found, "p5_daily": p5_daily, "p5_panel": p5_panel, "p5_found": p5_found}

_IN_FORCE = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, day ORDER BY recv_at DESC) AS rn FROM daily WHERE sid IS NOT NULL AND day IS NOT NULL) WHERE rn = 1"
_DAYS = "CAST(strptime(CAST(day AS VARCHAR), '%Y%m%d') AS DATE)"


def _windows(rows: str, columns: dict[str, str], pick: str, where: str = "") -> str:
    """Trailing sums over calendar days by a range frame, for rows (sid, d, columns)."""
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY cal.sid ORDER BY cal.d RANGE BETWEEN INTERVAL {p - 1} DAY PRECEDING AND CURRENT ROW) AS {n}_{p}" for n, c in columns.items() for p in (7, 30))
    return f"""WITH r AS ({rows}), span AS (SELECT sid, min(d) AS lo, max(d) AS hi FROM r GROUP BY sid),
        cal AS (SELECT sid, lo, unnest(range(lo::TIMESTAMP, hi::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS d FROM span),
        w AS (SELECT cal.sid, cal.d, lo, {sums} FROM cal LEFT JOIN r ON cal.sid = r.sid AND cal.d = r.d)
        SELECT {pick} FROM w WHERE date_diff('day', lo, d) >= 29 {where}"""


def _totals(name: str, total: str, n: str, digits: int) -> str:
    return ", ".join(f"round(coalesce({total}_{p}, 0), {digits}) AS {name}_total_{p}, CAST(coalesce({n}_{p}, 0) AS BIGINT) AS {name}_n_{p}, round({total}_{p} / {n}_{p}, {digits}) AS {name}_avg_{p}" for p in (7, 30))


_AMOUNT_ROWS = f"SELECT sid, {_DAYS} AS d, coalesce(amount, CASE WHEN isnan(volume * close) THEN NULL ELSE volume * close END, 0) AS a, 1 AS one, CASE WHEN isnan(close) THEN NULL ELSE close END AS c FROM ({_IN_FORCE})"
_VOL_ROWS = "SELECT sid, day AS d, v FROM (SELECT DISTINCT sid, day, CASE WHEN isnan(vol_20d) THEN NULL ELSE vol_20d END AS v FROM panel)"
_NUMBER = "CAST(strftime(d, '%Y%m%d') AS INT) AS day"
_AMOUNT_FOUND = _windows(_AMOUNT_ROWS, {"t": "a"}, f"'amount' AS measure, sid, {_NUMBER}", "AND coalesce(t_7, 0) > 0.5 * coalesce(t_30, 0)")
_VOL_FOUND = _windows(_VOL_ROWS, {"t": "v", "n": "CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END"}, f"'vol_20d' AS measure, sid, {_NUMBER}", "AND n_7 > 0 AND t_7 / n_7 > 1.3 * (t_30 / n_30)")

_USABLE = """WITH t AS (SELECT *, CASE WHEN abs(tick) >= 1e17 THEN tick / 1e9 WHEN abs(tick) >= 1e14 THEN tick / 1e6 WHEN abs(tick) >= 1e11 THEN tick / 1e3 ELSE tick END AS s
        FROM (SELECT DISTINCT * FROM tick WHERE tick IS NOT NULL AND close > 0 AND NOT isnan(close))),
    m AS (SELECT *, CAST(floor(s / 86400) AS INT) AS d, floor((s - floor(s / 86400) * 86400) / 60) AS mm FROM t),
    u AS (SELECT sid, d, CAST(CASE WHEN mm >= 570 AND mm < 690 THEN mm - 570 ELSE mm - 660 END AS INT) AS minute_idx, max({'a': s, 'v': close}).v AS close, sum(volume) AS volume, count(*) AS n FROM m WHERE (mm >= 570 AND mm < 690) OR (mm >= 780 AND mm < 900) GROUP BY 1, 2, 3)
    """
SQL = {
    "p2_slots": _USABLE + """SELECT sid, CAST(strftime(DATE '1970-01-01' + d, '%Y%m%d') AS INT) AS day, CAST(minute_idx AS INT) AS minute_idx, round(close, 6) AS close, CASE WHEN n IS NULL THEN 0 ELSE round(volume, 3) END AS volume, coalesce(n, 0) AS n_readings, n IS NULL AS filled
        FROM (SELECT sid, d, unnest(range(240)) AS minute_idx FROM (SELECT DISTINCT sid, d FROM u)) g LEFT JOIN u USING (sid, d, minute_idx)""",
    "p2_found": """WITH t AS (SELECT *, CASE WHEN abs(tick) >= 1e17 THEN tick / 1e9 WHEN abs(tick) >= 1e14 THEN tick / 1e6 WHEN abs(tick) >= 1e11 THEN tick / 1e3 ELSE tick END AS s
            FROM tick WHERE tick IS NOT NULL AND close > 0 AND NOT isnan(close)),
        m AS (SELECT sid, CAST(floor(s / 86400) AS INT) AS d, floor((s - floor(s / 86400) * 86400) / 60) AS mm FROM t),
        u AS (SELECT DISTINCT sid, d, CAST(CASE WHEN mm >= 570 AND mm < 690 THEN mm - 570 WHEN mm >= 780 AND mm < 900 THEN mm - 660 END AS INT) AS minute_idx FROM m),
        g AS (SELECT sid, d, unnest(range(240)) AS minute_idx FROM (SELECT DISTINCT sid, d FROM u WHERE minute_idx IS NOT NULL))
        SELECT g.sid, CAST(strftime(DATE '1970-01-01' + g.d, '%Y%m%d') AS INT) AS day, CAST(g.minute_idx AS INT) AS minute_idx FROM g ANTI JOIN u ON g.sid = u.sid AND g.d = u.d AND g.minute_idx = u.minute_idx""",
    "p5_daily": _windows(_AMOUNT_ROWS, {"t": "a", "m": "CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END", "c": "c", "n": "CASE WHEN c IS NOT NULL THEN 1 ELSE 0 END"}, f"sid, {_NUMBER}, " + _totals("amount", "t", "m", 1) + ", " + _totals("close", "c", "n", 7)),
    "p5_panel": _windows(_VOL_ROWS, {"t": "v", "n": "CASE WHEN v IS NOT NULL THEN 1 ELSE 0 END"}, f"sid, {_NUMBER}, " + _totals("vol_20d", "t", "n", 10)),
    "p5_found": f"SELECT * FROM ({_AMOUNT_FOUND}) UNION ALL SELECT * FROM ({_VOL_FOUND})",
}
