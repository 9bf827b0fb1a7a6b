"""Queries of readers and writers, models and the walk-forward run, each with its SQL."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import motif as M
from tidemark.operators import reports as R
from tidemark.operators import search as SE
from tidemark.operators import states as ST
from tidemark.operators import timeseries as TS
from tidemark.operators import universe as U
from tidemark.plans.reference import MOTIF, PARTS, SQL, _CLEAN, _Z, bars, daily_f, finite_curves, labelled, listed, panel, priced, query, r6, read, s6
from tidemark.session import new_path
from tidemark.sources import io

LIMIT = (2 * 12 * (1 - 0.85)) ** 0.5
CONFIG = SE.SearchConfig(downsample=5, cross_days=1, motif_minutes=60, threshold_r=0.85, dtw_share=0.1, z_bound=1.0)

_WINDOWS = f"""SELECT sid, day, i, {_Z.format('w')} AS z, {_Z.format('q')} AS m FROM (SELECT sid, day, i, c[i : i + 11] AS w, {MOTIF}::DOUBLE[] AS q FROM (
    SELECT sid, day, c, CAST(unnest(range(1, len(c) - 10)) AS INT) AS i FROM (SELECT sid, day, {_CLEAN.format('daily_curve')} AS c FROM panel_d)))"""
# Scores of macro states from chain cells (step, from_state, to_state, p), which a query provides as {0}.
_SCORES = "SELECT macro_state, sum(s) AS fsm_score FROM (" + " UNION ALL ".join([
    "SELECT a.from_state AS macro_state, 0.5 * a.p * [-1, -0.5, 0.5, 1][a.to_state + 1] AS s FROM {0} a WHERE a.step = 'macro_state->bin_1'",
    "SELECT a.from_state, 0.3 * a.p * b.p * [-1, -0.5, 0.5, 1][b.to_state + 1] FROM {0} a JOIN {0} b ON a.step = 'macro_state->bin_1' AND b.step = 'bin_1->bin_2' AND a.to_state = b.from_state",
    "SELECT a.from_state, 0.2 * a.p * b.p * c.p * [-1, -0.5, 0.5, 1][c.to_state + 1] FROM {0} a JOIN {0} b ON a.step = 'macro_state->bin_1' AND b.step = 'bin_1->bin_2' AND a.to_state = b.from_state JOIN {0} c ON c.step = 'bin_2->bin_3' AND b.to_state = c.from_state",
]) + ") GROUP BY macro_state"


def _cells(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}->{b}' AS step, i.r AS from_state, j.r AS to_state, (SELECT count(*) FROM {rows} l WHERE l.{a} = i.r AND l.{b} = j.r) AS n FROM (SELECT CAST(unnest(range({na})) AS INT) AS r) i, (SELECT CAST(unnest(range(4)) AS INT) AS r) j" for a, na, b in (("macro_state", 3, "bin_1"), ("bin_1", 4, "bin_2"), ("bin_2", 4, "bin_3")))


_P = "SELECT step, from_state, to_state, n, (n + 1) / (sum(n) OVER (PARTITION BY step, from_state) + 4) AS p FROM {0}"
PARTS["dist"] = f"SELECT sid, day, min(sqrt(list_sum(list_transform(list_zip(z, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))) AS distance FROM ({_WINDOWS}) GROUP BY sid, day"
# The walk: learned on 2004, applied to 2005.
_STATE = "CASE WHEN flow <= lo THEN 0 WHEN flow <= hi THEN 1 ELSE 2 END"
_WALK = f"""WITH panel_d AS ({PARTS['panel_d']}), dist AS ({PARTS['dist']}), flows AS ({PARTS['flows']}), binned AS ({PARTS['binned']}),
    bounds AS (SELECT v[1 + CAST(round((len(v) - 1) / 3.0) AS INT)] AS lo, v[1 + CAST(round((len(v) - 1) * 2 / 3.0) AS INT)] AS hi FROM (SELECT list_sort(list(flow)) AS v FROM flows WHERE year(day) = 2004)),
    macro AS (SELECT day, {_STATE} AS macro_state FROM flows, bounds),
    rows AS (SELECT b.*, m.macro_state, d.distance, p.fwd_ret_1 AS ret FROM binned b JOIN macro m USING (day) JOIN dist d USING (sid, day) JOIN panel_d p USING (sid, day)),
    hit AS (SELECT * FROM rows WHERE year(day) = 2004 AND distance <= {LIMIT} AND bin_1 IS NOT NULL AND bin_2 IS NOT NULL AND bin_3 IS NOT NULL),
    cells AS ({_cells('hit')}), chain AS ({_P.format('cells')}), scores AS ({_SCORES.format('chain')})"""


def _model(spark, d, rows=None):
    """The model of one motif, learned on a panel."""
    p = with_lag(panel(spark, d)) if rows is None else rows
    return SE.discover(p, CONFIG, [MOTIF])


def with_lag(rows):
    return rows.withColumn("lag_0", F.col("daily_curve"))


def year_panel(spark, d):
    """Panel of a year by (year, config)."""
    return lambda year, config: with_lag(panel(spark, d).where(F.year("day") == year))


# Models


@query("panel_d dist macro labelled", f"SELECT l.step, l.from_state, l.to_state, l.n, round(l.p, 6) AS p, t.triggers, round(t.mean, 8) AS mean FROM ({_P.format('(' + _cells('hits') + ')')}) l, (SELECT count(fwd_ret_1) AS triggers, avg(fwd_ret_1) AS mean FROM hits JOIN panel_d USING (sid, day)) t".replace("hits", f"(SELECT l.* FROM labelled l JOIN dist d USING (sid, day) WHERE d.distance <= {LIMIT})"))
def fsm_model(spark, d):
    """Chain of a motif's triggers with their number and mean return, whatever its significance."""
    p = with_lag(panel(spark, d))
    bounds = ST.tercile_bounds(ST.daily_flow(p), "flow")
    model = SE.evaluate(SE.with_states(p, CONFIG, bounds), MOTIF, CONFIG, bounds=bounds)
    chain = [(r["step"], r["from_state"], r["to_state"], r["n"], r["p"], model["triggers"], model["mean"]) for r in model["network"]]
    return spark.createDataFrame(chain, "step string, from_state int, to_state int, n long, p double, triggers long, mean double").withColumns({"p": F.round("p", 6), "mean": F.round("mean", 8)})


@query("panel_d dist macro chain", f"SELECT d.day, d.sid, round(d.distance, 6) AS distance, m.macro_state, round(s.fsm_score, 6) AS fsm_score FROM dist d JOIN macro m USING (day) JOIN ({_SCORES.format('chain')}) s USING (macro_state) WHERE d.distance <= {LIMIT}")
def fsm_predict(spark, d):
    p = with_lag(panel(spark, d))
    bounds = ST.tercile_bounds(ST.daily_flow(p), "flow")
    network = [r.asDict() for r in ST.transitions(labelled(spark, d), SE.CHAIN).collect()]  # 44 cells
    out = SE.predict(p, {"config": asdict(CONFIG), "motif": MOTIF, "network": network, "bounds": bounds})
    return out.select("day", "sid", *r6("distance"), "macro_state", *r6("fsm_score"))


@query("", _WALK + f"""SELECT day, sid, round(distance, 6) AS distance, macro_state, round(fsm_score, 6) AS fsm_score FROM rows JOIN scores USING (macro_state) WHERE year(day) = 2005 AND distance <= {LIMIT}""")
def walk_forward_scores(spark, d):
    """Scores of 2005 by a model of one motif learned on 2004 alone, read back from the run's yearly tables."""
    path = new_path(spark, "walk")
    years = SE.walk_forward([2005], year_panel(spark, d), 1, path=path, configs=[CONFIG], motifs=[MOTIF], gate=False)
    schema = "day date, sid string, distance double, macro_state int, fsm_score double"
    out = io.read_existing(spark, [f"{path}/scores/year={y}" for y, _, _ in years], T.StructType.fromDDL(schema))
    return out.select("day", "sid", *r6("distance"), "macro_state", *r6("fsm_score"))


_Z_OF_YEAR = """(SELECT (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) FROM (SELECT sum(a) AS n1, sum(b) AS n2, sum(a * rank) AS r1, sum(t * t * t - t) AS ties FROM (
        SELECT a, b, t, sum(t) OVER (ORDER BY v) - t + (t + 1) / 2 AS rank FROM (SELECT v, CAST(count(*) FILTER (f) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT f) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS t FROM (
            SELECT ret AS v, true AS f FROM hit WHERE year(day) = {0} UNION ALL SELECT fwd_ret_1, false FROM panel_d WHERE year(day) = {0}) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY v))))"""


@query("panel_d dist binned", "SELECT * FROM (WITH hit AS (SELECT b.day, p.fwd_ret_1 AS ret FROM binned b JOIN dist d USING (sid, day) JOIN panel_d p USING (sid, day) WHERE d.distance <= " + str(LIMIT) + " AND bin_1 IS NOT NULL AND bin_2 IS NOT NULL AND bin_3 IS NOT NULL) " + " UNION ALL ".join(f"SELECT {y} AS year, (SELECT count(ret) FROM hit WHERE year(day) = {y}) AS triggers, round((SELECT avg(ret) FROM hit WHERE year(day) = {y}), 8) AS mean, (SELECT count(ret) FROM hit WHERE year(day) = {y}) >= 5 AND {_Z_OF_YEAR.format(y)} >= 1.2815515655446 AS keeps" for y in (2004, 2005)) + ")")
def decay_check(spark, d):
    """Whether a motif's triggers are enough and their returns significantly higher in each year: the gates of a model."""
    rows = []
    for year in (2004, 2005):
        p = year_panel(spark, d)(year, CONFIG)
        found = SE.evaluate(SE.with_states(p, CONFIG), MOTIF, CONFIG)
        rows.append((year, found["triggers"], None if found["mean"] is None else round(found["mean"], 8), found["score"] > 0))
    return spark.createDataFrame(rows, "year int, triggers long, mean double, keeps boolean")


@query("binned macro", "SELECT step, from_state, to_state, n FROM (" + " UNION ALL ".join(f"SELECT '{a}->{b}' AS step, i.r AS from_state, j.r AS to_state, (SELECT count(*) FROM (SELECT b.*, m.macro_state FROM binned b JOIN macro m USING (day) WHERE bin_1 IS NOT NULL AND bin_2 IS NOT NULL) l WHERE l.{a} = i.r AND l.{b} = j.r) AS n FROM (SELECT CAST(unnest(range({na})) AS INT) AS r) i, (SELECT CAST(unnest(range(4)) AS INT) AS r) j" for a, na, b in (("macro_state", 3, "bin_1"), ("bin_1", 4, "bin_2"))) + ")")
def two_horizon_chain(spark, d):
    """The chain of a panel without its third forward return: that horizon is skipped."""
    p = with_lag(panel(spark, d)).drop("fwd_ret_3")
    return ST.transitions(SE.with_states(p, CONFIG), SE.chain_of(p)).drop("p")


_CONFIGS = [(1, 1, 30, 0.7, 0.05), (1, 1, 60, 0.85, 0.1), (1, 2, 360, 0.85, 0.2), (3, 1, 60, 0.9, 0.2), (5, 1, 30, 0.8, 0.1), (5, 1, 360, 0.8, 0.1), (5, 2, 240, 0.75, 0.2), (5, 3, 60, 0.7, 0.9)]


@query("", "SELECT *, round(sqrt(2 * m * (1 - r)), 6) AS limit_d, greatest(1, least(greatest(1, CAST(floor(m * share) AS INT)), 120 // downsample)) AS band, m >= 6 AND m <= cross_days * 240 // downsample AND m BETWEEN 8 AND 60 AS allowed FROM (SELECT *, motif_minutes // downsample AS m FROM (VALUES " + ", ".join(map(str, _CONFIGS)) + ") v(downsample, cross_days, motif_minutes, r, share))")
def config_table(spark, d):
    """What follows from a configuration: points, distance limit, band, and whether the guard lets it be tried."""
    configs = [SE.SearchConfig(downsample=a, cross_days=b, motif_minutes=c, threshold_r=r, dtw_share=s) for a, b, c, r, s in _CONFIGS]
    rows = [(*given, c.m, round(c.limit, 6), c.band, SE.guard(c)[0]) for given, c in zip(_CONFIGS, configs, strict=True)]
    return spark.createDataFrame(rows, "downsample int, cross_days int, motif_minutes int, r double, share double, m int, limit_d double, band int, allowed boolean")


@query("", "SELECT w AS wanted, m AS model_year, m / 10.0 AS score FROM (VALUES (2003), (2004), (2005), (2009)) v(w) LEFT JOIN (VALUES (2004), (2006)) u(m) ON m = (SELECT max(x) FROM (VALUES (2004), (2006)) t(x) WHERE x <= w)")
def model_latest(spark, d):
    """The newest model up to each year, from a store of two years, one of them saved twice."""
    path = new_path(spark, "models")
    for year, score in ((2004, 1.0), (2006, 200.6), (2004, 200.4)):
        io.save_model(spark, path, year, {"m": 12}, MOTIF, [], score, [0.1, 0.2])
    found = {y: io.latest_model(spark, path, y) for y in (2003, 2004, 2005, 2009)}
    return spark.createDataFrame([(y, m and m["model_year"], m and m["score"]) for y, m in found.items()], "wanted int, model_year int, score double")


@query("", "SELECT arg_max(n, s) AS motif_minutes, max(s) AS metrics_score, count(*) AS trials FROM (VALUES (30, 0.0), (60, 100.0), (120, 10.0)) v(n, s)")
def trials_best(spark, d):
    path = new_path(spark, "trials")
    for minutes, score in ((30, 0.0), (60, 100.0), (120, 10.0)):
        io.append_trials(spark, path, [({"motif_minutes": minutes}, score)])
    t = spark.read.parquet(path).withColumn("motif_minutes", F.get_json_object("config", "$.motif_minutes").cast("int"))
    return t.agg(F.max_by("motif_minutes", "metrics_score").alias("motif_minutes"), F.max("metrics_score").alias("metrics_score"), F.count(F.lit(1)).alias("trials"))


# Motifs


@query("panel_d", "SELECT sid, day, count(*) AS windows FROM (SELECT sid, day, daily_curve AS c, unnest(range(1, len(daily_curve) - 10)) AS i FROM panel_d) WHERE list_bool_and(list_transform(c[i : i + 11], lambda x: x IS NOT NULL AND NOT isnan(x))) GROUP BY sid, day")
def series_window_counts(spark, d):
    """Windows of a curve without a missing point; none crosses two curves."""
    return M.series_windows(panel(spark, d), ["sid", "day"], "daily_curve", 12).groupBy("sid", "day").agg(F.count(F.lit(1)).alias("windows"))


_WHOLE = [round(0.3 * i / 47 - 0.1 * (i % 7), 4) for i in range(48)]


@query("panel_d", f"SELECT sid, day, round(sqrt(list_sum(list_transform(list_zip(z, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 6) AS distance FROM (SELECT sid, day, {_Z.format('c')} AS z, {_Z.format('q')} AS m FROM (SELECT sid, day, {_CLEAN.format('daily_curve')} AS c, {_WHOLE}::DOUBLE[] AS q FROM panel_d))")
def whole_curve_distance(spark, d):
    return finite_curves(spark, d).select("sid", "day", F.round(M.subsequence_distance(F.col("curve"), _WHOLE, 1, 1e9), 6).alias("distance"))


# Rows i + j = k of the warping table at a time; cell i of a row needs the two rows before it.
SQL["dtw_min_subseq"] = f"""WITH RECURSIVE panel_d AS ({PARTS['panel_d']}), win AS (SELECT *, row_number() OVER () AS id FROM ({_WINDOWS})),
    t AS (SELECT id, 0 AS k, list_transform(range(1, 13), lambda i: CASE WHEN i = 1 THEN (z[1] - m[1]) ** 2 ELSE 'infinity'::DOUBLE END) AS cur, list_transform(range(1, 13), lambda i: 'infinity'::DOUBLE) AS prev FROM win
        UNION ALL SELECT t.id, k + 1, list_transform(range(1, 13), lambda i: CASE WHEN k + 2 - i BETWEEN 0 AND 11 AND abs(k + 3 - 2 * i) < 3
            THEN (w.z[i] - w.m[k + 3 - i]) ** 2 + least(cur[i], CASE WHEN i > 1 THEN cur[i - 1] ELSE 'infinity'::DOUBLE END, CASE WHEN i > 1 THEN prev[i - 1] ELSE 'infinity'::DOUBLE END) ELSE 'infinity'::DOUBLE END), cur
        FROM t JOIN win w ON w.id = t.id WHERE k < 22)
    SELECT sid, day, round(min(sqrt(cur[12])), 6) AS distance FROM t JOIN win USING (id) WHERE k = 22 GROUP BY sid, day"""


# All pairs of windows; the table's windows are few thousand at the scale of the check.
_PROFILE = f"""SELECT l.series, l.pos, min(array_distance(l.z, r.z)) AS distance FROM w l JOIN w r ON l.series <> r.series OR abs(l.pos - r.pos) > 3 GROUP BY l.series, l.pos"""
_POINTS = f"w AS MATERIALIZED (SELECT sid || '|' || CAST(day AS VARCHAR) AS series, CAST(i - 1 AS INT) AS pos, CAST(z AS DOUBLE[12]) AS z FROM ({_WINDOWS}))"
SQL["matrix_profile"] = f"WITH panel_d AS ({PARTS['panel_d']}), {_POINTS} SELECT regexp_replace(series, '[|].*', '') AS sid, series, pos, round(distance, 6) AS distance FROM ({_PROFILE})"
_PICKS = ", ".join(
    f"p{i} AS (SELECT * FROM p WHERE distance > 1e-5 AND distance <= {LIMIT} " + " ".join(f"AND NOT EXISTS (SELECT 1 FROM p{j} q WHERE q.series = p.series AND abs(q.pos - p.pos) <= 12)" for j in range(i)) + " ORDER BY distance, series, pos LIMIT 1)" for i in range(5)
)
SQL["motif_topk"] = f"WITH panel_d AS ({PARTS['panel_d']}), {_POINTS}, p AS MATERIALIZED ({_PROFILE}), {_PICKS} SELECT series, pos, round(distance, 6) AS distance FROM (" + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(5)) + ")"

# Tail bins: the likelihood over a grid of parameters, then between the neighbours of the best; x is (key, x).
_GPD = """n AS (SELECT key, list_sort(list(x)) AS v, count(*) AS n FROM x GROUP BY key HAVING count(*) >= 50),
    e AS (SELECT key, list_transform([0.05, 0.25, 0.75, 0.95], lambda q: v[CAST(greatest(1, ceil(q * n)) AS INT)]) AS edges FROM n),
    b AS (SELECT key, x, edges, CAST((x >= edges[1])::INT + (x >= edges[2])::INT + (x >= edges[3])::INT + (x >= edges[4])::INT AS INT) AS bin FROM x JOIN e USING (key)),
    m AS (SELECT key, bin, avg(x) AS mean FROM b GROUP BY ALL),
    t AS (SELECT key, side, x FROM (SELECT key, CASE bin WHEN 0 THEN -1 ELSE 1 END AS side, CASE bin WHEN 0 THEN edges[1] - x ELSE x - edges[4] END AS x FROM b WHERE bin IN (0, 4)) WHERE x > 0),
    z AS (SELECT key, side, avg(x) AS mean, max(x) AS top FROM t GROUP BY ALL HAVING count(*) > 10),
    g AS (SELECT key, side, list_concat(list_transform(range(61), lambda i: -exp(ln(20 / mean) + ln(1e-5 / 20) * i / 60)), [0.0::DOUBLE], list_transform(range(61), lambda i: 1e-6 / top + ((1 - 1e-6) / top - 1e-6 / top) * i / 60)) AS grid FROM z),
    l AS ({0}), f AS (SELECT key, side, list_transform(range(61), lambda i: below + (above - below) * i / 60) AS grid FROM l), h AS ({1}),
    c AS (SELECT key, edges, bin, CASE WHEN bin IN (0, 4) THEN coalesce(CASE WHEN bin = 0 THEN edges[1] ELSE edges[4] END + beyond, mean, CASE WHEN bin = 0 THEN edges[1] ELSE edges[4] END) ELSE coalesce(mean, (edges[bin] + edges[bin + 1]) / 2) END AS centre
        FROM (SELECT key, edges, CAST(unnest(range(5)) AS INT) AS bin FROM e) LEFT JOIN m USING (key, bin) LEFT JOIN (SELECT key, CASE WHEN side < 0 THEN 0 ELSE 4 END AS bin, side * sigma / (1 - xi) AS beyond FROM h WHERE xi < 1) USING (key, bin))"""


def _likelihood(grid: str) -> str:
    return f"""SELECT key, side, r.theta, r.xi, r.sigma, grid[greatest(r.i - 1, 1)] AS below, grid[least(r.i + 1, len(grid))] AS above FROM (SELECT key, side, arg_min({{'i': i, 'theta': theta, 'xi': xi, 'sigma': sigma}}, {{'l': ln(sigma) + xi + 1, 'i': i}}) AS r FROM (
        SELECT key, side, i, theta, CASE WHEN flat THEN 0 ELSE xi END AS xi, CASE WHEN flat THEN mean ELSE -xi / theta END AS sigma, least FROM (SELECT *, abs(theta) * mean < 1e-9 AS flat FROM (
            SELECT key, side, i, theta, avg(CASE WHEN 1 - theta * x > 0 THEN ln(1 - theta * x) END) AS xi, min(1 - theta * x) AS least, avg(x) AS mean FROM (SELECT key, side, x, unnest(range(1, len(grid) + 1)) AS i, unnest(grid) AS theta FROM t JOIN {grid} USING (key, side)) GROUP BY ALL))
        ) WHERE least > 0 AND sigma > 0 GROUP BY key, side) JOIN {grid} USING (key, side)"""


_GPD = _GPD.replace("{0}", _likelihood("g")).replace("{1}", _likelihood("f"))
SQL["gpd_tail_bins"] = f"WITH x AS (SELECT event_type AS key, value AS x FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL), {_GPD} SELECT key AS event_type, bin, round(edges[bin], 5) AS edge, round(centre, 4) AS centre FROM c"
SQL["rolling_gpd_bins"] = f"""WITH r AS (SELECT day, fwd_ret_1 AS ret FROM (SELECT DISTINCT * FROM panel) WHERE fwd_ret_1 IS NOT NULL AND NOT isnan(fwd_ret_1)),
    cal AS (SELECT day, row_number() OVER (ORDER BY day) AS i, row_number() OVER (PARTITION BY (year(day) * 12 + month(day)) // 3 ORDER BY day) = 1 AS refit FROM (SELECT DISTINCT day FROM r)),
    x AS (SELECT f.day AS key, r.ret AS x FROM cal f JOIN cal d ON d.i BETWEEN f.i - 59 AND f.i JOIN r ON r.day = d.day WHERE f.refit), {_GPD},
    k AS (SELECT day, last_value(key IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS key FROM (SELECT cal.day, e.key FROM cal LEFT JOIN e ON e.key = cal.day))
    SELECT k.day, bin, round(edges[bin], 7) AS edge, round(centre, 6) AS centre FROM k JOIN c USING (key)"""


# Tables


@query("", " UNION ALL ".join(f"SELECT '{k}' AS kind, n_nationkey, n_name, n_regionkey FROM nation" for k in ("csv", "jsonl", "parquet")) + " UNION ALL SELECT 'many', n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 'sql', n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def io_roundtrip(spark, d):
    """A table written and read again in each format, over many files of which some are missing, and by SQL over the files."""
    nation = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = new_path(spark, "io")
    nation.write.option("header", True).csv(f"{path}/csv")
    nation.write.json(f"{path}/jsonl")
    io.write_by(nation, f"{path}/parquet", ["n_regionkey"])
    kinds = [io.read_table(spark, f"{path}/{k}", k, nation.schema).select(F.lit(k).alias("kind"), *nation.columns) for k in ("csv", "jsonl", "parquet")]
    for r in range(2):
        io.write_by(nation.where(F.col("n_nationkey") % 2 == r), f"{path}/many-{r}")
    many = io.read_existing(spark, [f"{path}/many-{r}" for r in range(4)], nation.schema).select(F.lit("many").alias("kind"), "*")
    none = io.read_existing(spark, [f"{path}/nothing"], nation.schema).select(F.lit("none").alias("kind"), "*")
    by_sql = io.scan_sql(spark, "SELECT 'sql' AS kind, n_nationkey, n_name, n_regionkey FROM {t} WHERE n_regionkey = :r", {"t": f"{path}/parquet"}, {"r": 2})
    return io.union_all([*kinds, many, none, by_sql])


@query("kept", "SELECT CAST(year(date) AS INT) AS year, sid, day, round(p.close, 6) AS close FROM (SELECT *, CAST(strftime(date, '%Y%m') AS INT) AS m FROM priced) p WHERE volume > 0 AND high > low AND EXISTS (SELECT 1 FROM kept k WHERE k.rank <= 0.8 * k.n AND k.sid = p.sid AND k.trade_month_id = p.m)")
def universe_node(spark, d):
    """The universe as the walk-forward run writes it, by year, and only sids of its own sid table."""
    at = SE.prepare_universe(priced(spark, d).select("sid", "day", "date", "high", "low", "close", "volume", "amount"), listed(spark, d), new_path(spark, "universe"))
    return spark.read.parquet(at["dret_path"]).join(spark.read.parquet(at["universe_sids"]), "sid", "left_semi").select("year", "sid", "day", *r6("close"))


@query("flow_bars", f"SELECT use, of_year, sid, day, bar_idx, {s6('close', 'ofi_ratio')} FROM (SELECT *, CAST(year(DATE '1970-01-01' + day) AS INT) AS y FROM flow_bars) JOIN (VALUES ('oos', 2004, 2004), ('oos', 2005, 2005), ('train', 2004, 2003), ('train', 2005, 2004)) v(use, of_year, y) USING (y)")
def yearly_bars_node(spark, d):
    """Bars of the training years and of the years themselves, from the tables that the run keeps by year."""
    years = [2004, 2005]
    flow = lambda lo, hi: TS.flow_ratio_bars(TS.minute_skeleton(bars(spark, d).where(F.date_format(F.date_from_unix_date("day"), "yyyyMMdd").cast("int").between(lo, hi))))
    at = SE.yearly_bars(flow, years, new_path(spark, "bars"))
    return io.union_all([spark.read.parquet(p).select(F.lit(use).alias("use"), F.lit(y).alias("of_year"), "sid", "day", "bar_idx", *r6("close", "ofi_ratio")) for use in ("train", "oos") for y, p in at[use].items()])


_ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("", "SELECT sid, day, round(o.p, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(c.p, 6) AS close, volume, round(amount, 2) AS amount FROM (SELECT l_suppkey AS sid, CAST(l_shipdate AS DATE) AS day, min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'p': l_extendedprice / l_quantity}) AS o, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, max({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'p': l_extendedprice / l_quantity}) AS c, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1, 2)")
def daily_bars(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("sid"), F.col("l_shipdate").cast("date").alias("day"), *_ORDER, (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"))
    return TS.daily_bars(rows, _ORDER).select("sid", "day", *r6("open", "high", "low", "close"), "volume", F.round("amount", 2).alias("amount"))


@query("daily_f", "SELECT count(*) AS sids, layer, CAST(greatest(floor(count(*) * 0.2), 1) AS BIGINT) AS drawn FROM (SELECT CAST(least(i // greatest(k // 5, 1), 4) AS INT) AS layer FROM (SELECT row_number() OVER (ORDER BY t DESC, sid) - 1 AS i, CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS k FROM (SELECT sid, avg(coalesce(amount, volume * close, 0)) AS t FROM daily_f GROUP BY sid) WHERE t IS NOT NULL) WHERE i < k) GROUP BY layer")
def stratified_layers(spark, d):
    """How many sids of each layer there are and are drawn; all drawn ones lie in their layer's range of turnover."""
    t = daily_f(spark, d).groupBy("sid").agg(F.avg(F.coalesce("amount", F.col("volume") * F.col("close"), F.lit(0.0))).alias("turnover"))
    whole = U.stratified_sample(t, rate=1.0).groupBy("layer").agg(F.count(F.lit(1)).alias("sids"), F.min("turnover").alias("lo"), F.max("turnover").alias("hi"))
    drawn = U.stratified_sample(t).join(whole, "layer").where(F.col("turnover").between(F.col("lo"), F.col("hi")))
    return drawn.groupBy("layer", "sids").agg(F.count(F.lit(1)).alias("drawn"))


# Reports


@query("daily_f", "SELECT sid, day FROM (SELECT sid, day, row_number() OVER (ORDER BY day, sid) - 1 AS i, count(*) OVER () AS n FROM daily_f) WHERE i >= 100 AND i < n - 50")
def row_slice(spark, d):
    return R.row_slice(daily_f(spark, d).select("sid", "day"), ["day", "sid"], 100, -50)


@query("", "SELECT o_orderpriority AS name, o_custkey % 7 AS timeframe, o_orderkey % 11 AS compression FROM orders ORDER BY timeframe, compression, name, o_orderkey LIMIT 1")
def finest_clock(spark, d):
    clocks = read(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), (F.col("o_custkey") % 7).alias("timeframe"), (F.col("o_orderkey") % 11).alias("compression"))
    return R.finest_clock(clocks)


@query("priced", "SELECT tick, CAST(date AS VARCHAR) AS label FROM (VALUES (-3.0), (0.0), (2.4), (7.6), (1e9)) v(tick), (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM priced)) r WHERE i = greatest(0, least(n - 1, CAST(round(tick) AS BIGINT)))")
def index_labels(spark, d):
    """Date labels of positions on a gap-free axis, held at its ends."""
    ticks_at = spark.createDataFrame([(x,) for x in (-3.0, 0.0, 2.4, 7.6, 1e9)], "tick double")
    return R.index_labels(priced(spark, d).select("date").distinct(), ["date"], ticks_at, F.col("date").cast("string"))


@query("", "SELECT role, name, CAST(place AS INT) AS place FROM (VALUES ('feed', 'open', 0), ('feed', 'high', 1), ('feed', 'low', 2), ('feed', 'close', 3), ('feed', 'volume', 4), ('indicator', 'ind_vol', 0), ('analyzer', 'sid', 0), ('analyzer', 'day', 1), ('analyzer', 'amount', 2), ('analyzer', 'recv_at', 3)) v(role, name, place)")
def column_roles(spark, d):
    wide = read(spark, d, "daily").withColumn("ind_vol", F.col("volume"))
    return spark.createDataFrame([(role, c, i) for role, names in R.column_roles(wide.columns).items() for i, c in enumerate(names)], "role string, name string, place int")
