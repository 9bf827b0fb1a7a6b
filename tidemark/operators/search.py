"""Pattern discovery, decay check and walk-forward search over a panel.

A model carries all it learned: its configuration, motif, chain and the tercile bounds of its training panel, so a test
year is scored without a look at that year's own distribution.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import motif_threshold, zero_if_not_finite
from tidemark.kernels.dtw import band
from tidemark.operators.motif import candidate_motifs, matrix_profile, series_windows, triggers
from tidemark.operators.states import daily_flow, macro_terciles, posterior, rank_bins, return_bin, state_scores, tercile_bounds, transitions
from tidemark.operators.stats import ks_p, ks_statistic, ladder, mann_whitney, normal_tail
from tidemark.operators.timeseries import joined_lags
from tidemark.operators.universe import universe
from tidemark.session import written
from tidemark.sources import io

# Least and most points of a motif that may be tried, and the score of one that may not.
LEAST_POINTS, MOST_POINTS, REFUSED = 8, 60, -9999.0
HORIZONS = (1, 2, 3)
CHAIN = [("macro_state", 3), ("bin_1", 4), ("bin_2", 4), ("bin_3", 4)]


@dataclass(frozen=True)
class SearchConfig:
    """downsample: minutes per bar; cross_days: days per curve; motif_minutes: length of a motif; threshold_r: least
    correlation of a match; dtw_share: band as a share of the motif; z_bound: edge of the outer return bins;
    min_triggers: fewest matches of a model; candidates: motifs tried per configuration.
    """

    downsample: int = 5
    cross_days: int = 1
    motif_minutes: int = 60
    threshold_r: float = 0.85
    dtw_share: float = 0.1
    z_bound: float = 1.0
    min_triggers: int = 5
    candidates: int = 5

    @property
    def m(self) -> int:
        return self.motif_minutes // self.downsample

    @property
    def limit(self) -> float:
        return motif_threshold(self.m, self.threshold_r)

    @property
    def band(self) -> int:
        return band(self.m, self.dtw_share, self.downsample)

    def problem(self) -> str | None:
        """Why a configuration can't run, or None."""
        points = self.cross_days * 240 // self.downsample
        if not 6 <= self.m <= points:
            return f"a motif of {self.m} points doesn't fit a curve of {points}"
        return None


def horizons_of(panel: DataFrame) -> list[int]:
    """The horizons whose forward return the panel has; others are skipped throughout."""
    return [k for k in HORIZONS if f"fwd_ret_{k}" in panel.columns]


def chain_of(panel: DataFrame) -> list[tuple[str, int]]:
    return [("macro_state", 3), *[(f"bin_{k}", 4) for k in horizons_of(panel)]]


def with_states(panel: DataFrame, config: SearchConfig, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Panel with its curve, macro state and a return bin per horizon it has. ``panel``: day, sid, daily_curve, lag_*, vol_20d,
    fwd_ret_*. ``bounds`` are the terciles of a training panel; without them the panel's own are taken."""
    macro = macro_terciles(panel, bounds).select("day", "macro_state")
    curve = F.transform(joined_lags(config.cross_days), zero_if_not_finite)
    known = horizons_of(panel)
    bins = [return_bin(F.col(f"fwd_ret_{k}"), F.col("vol_20d"), k, config.z_bound).alias(f"bin_{k}") for k in known]
    return panel.join(macro, "day", "left").select("sid", "day", "macro_state", curve.alias("curve"), *[f"fwd_ret_{k}" for k in known], *bins)


def evaluate(states: DataFrame, motif: list[float], config: SearchConfig, horizon: int = 1, bounds: tuple[float, float] | None = None) -> dict:
    """Model of a motif: chain of its triggers, rank test of triggered against all forward returns, score.

    Fails (score 0) with fewer than min_triggers triggers, returns without spread, or no significance. The rank test
    runs over distinct values in Spark; only sums come back. ``bounds``, those that ``states`` were made with, are kept.
    """
    ret, chain = f"fwd_ret_{horizon}", chain_of(states)
    hit = written(triggers(states, F.col("curve"), motif, config.band, config.limit).dropna(subset=[c for c, _ in chain]), "triggers")
    stats = hit.agg(F.count(ret).alias("n"), F.stddev_pop(ret).alias("sd"), F.avg(ret).alias("mean")).first()
    out = {"config": asdict(config), "motif": [float(x) for x in motif], "bounds": list(bounds) if bounds else None, "triggers": stats["n"], "mean": stats["mean"], "p": 1.0, "score": 0.0, "network": []}
    if stats["n"] < config.min_triggers or (stats["sd"] or 0.0) < 1e-8:
        return out
    # The second sample holds all returns, those of triggers too, so ties are the rule.
    both = hit.select(F.col(ret).alias("v"), F.lit(True).alias("first")).unionByName(states.select(F.col(ret).alias("v"), F.lit(False).alias("first")))
    test = mann_whitney(both, "v", F.col("first")).first()
    out["p"] = normal_tail(test["z"])
    out["score"] = ladder(out["p"])
    out["network"] = [r.asDict() for r in transitions(hit, chain).collect()]
    return out


def discover(panel: DataFrame, config: SearchConfig, motifs: list[list[float]] | None = None) -> dict | None:
    """The best model over the candidate motifs of a panel, or over ``motifs`` where given, the first one among equals;
    None if nothing can be tried."""
    if config.problem():
        return None
    bounds = tercile_bounds(daily_flow(panel), "flow")
    if bounds[0] is None:
        return None
    states = written(with_states(panel, config, bounds), "states")
    if motifs is None:
        curves = states.withColumn("series", F.concat_ws("|", "sid", F.col("day").cast("string")))
        profile = written(matrix_profile(curves, ["series"], "curve", config.m), "profile")
        picks = candidate_motifs(profile, config.m, config.threshold_r, config.candidates)
        windows = series_windows(curves, ["series"], "curve", config.m)
        motifs = [list(windows.where((F.col("series") == series) & (F.col("pos") == pos)).first()["window"]) for series, pos, _ in picks]
    best = None
    for motif in motifs:
        found = evaluate(states, motif, config, bounds=bounds)
        if best is None or found["score"] > best["score"]:
            best = found
    return best


def predict(panel: DataFrame, model: dict, mode: str = "trained") -> DataFrame:
    """(day, sid, distance, macro_state, fsm_score) of a panel's triggers under a model, by day and falling score; an unknown
    state scores 0.

    ``mode`` is ``trained`` (states by the bounds the model learned) or ``triggers`` (by terciles of the triggers' own days,
    a look ahead over the whole panel, for comparison).
    """
    if mode not in ("trained", "triggers"):
        raise ValueError(f"unknown mode {mode}")
    spark = panel.sparkSession
    config = SearchConfig(**model["config"])
    known = chain_of(panel)
    if mode == "trained":
        if not model.get("bounds"):
            raise ValueError("the model holds no bounds")
        hit = triggers(with_states(panel, config, tuple(model["bounds"])), F.col("curve"), model["motif"], config.band, config.limit)
    else:
        curve = F.transform(joined_lags(config.cross_days), zero_if_not_finite)
        near = written(triggers(panel.withColumn("curve", curve), F.col("curve"), model["motif"], config.band, config.limit), "triggered")
        hit = near.join(macro_terciles(near).select("day", "macro_state"), "day", "left")
    chain = spark.createDataFrame([(r["step"], r["from_state"], r["to_state"], r["n"], r["p"]) for r in model["network"]], "step string, from_state int, to_state int, n long, p double")
    scores = state_scores(chain, [c for c, _ in known])
    out = hit.join(F.broadcast(scores), "macro_state", "left").select("day", "sid", "distance", "macro_state", F.coalesce("fsm_score", F.lit(0.0)).alias("fsm_score"))  # three states
    return out.orderBy("day", F.col("fsm_score").desc(), "sid")


def draw_configs(n: int, seed: int, start: SearchConfig | None = None) -> list[SearchConfig]:
    """Seeded random configurations that can run, after the warm start if there is one."""
    rng = np.random.default_rng(seed)
    out = [start] if start else []
    while len(out) < n:
        c = SearchConfig(
            downsample=int(rng.choice([1, 3, 5])), cross_days=int(rng.choice([1, 2, 3])), motif_minutes=int(rng.choice([30, 60, 120, 240, 360])),
            threshold_r=float(rng.uniform(0.7, 0.9)), dtw_share=float(rng.uniform(0.05, 0.2)), z_bound=float(rng.uniform(0.8, 1.5)),
        )
        if c.problem() is None:
            out.append(c)
    return out


def guard(config: SearchConfig, least: int = LEAST_POINTS, most: int = MOST_POINTS) -> tuple[bool, float]:
    """Whether a configuration may be tried, and the score that stands for a refusal."""
    ok = config.problem() is None and least <= config.m <= most
    return ok, 0.0 if ok else REFUSED


def search(panel_of, configs: list[SearchConfig], at_once: int = 2, motifs: list[list[float]] | None = None, pool: str | None = None, tried: Callable[[SearchConfig, float], None] | None = None) -> dict | None:
    """The best model over configurations, the earliest one among equals. ``panel_of(config)`` gives its panel, which is
    made once for each (downsample, cross_days). Trials run as concurrent Spark jobs from a few driver threads, in the
    scheduler's ``pool`` if one is named. A configuration that the guard refuses isn't tried. ``tried`` is told every
    configuration and its score."""
    panels: dict[tuple[int, int], DataFrame] = {}
    lock = threading.Lock()

    def trial(config: SearchConfig) -> dict | None:
        ok, score = guard(config)
        found = None
        if ok:
            key = (config.downsample, config.cross_days)
            with lock:
                if key not in panels:
                    panels[key] = written(panel_of(config), "search-panel")
            if pool:
                panels[key].sparkSession.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
            found = discover(panels[key], config, motifs)
            score = found["score"] if found else 0.0
        if tried:
            tried(config, score)
        return found

    with ThreadPoolExecutor(at_once) as workers:
        found = [r for r in workers.map(trial, configs) if r]
    return max(found, key=lambda r: r["score"], default=None)


def still_good(model: dict, panel: DataFrame) -> bool:
    """Whether a model's motif is still significant on another panel, a training one, whose own states are taken."""
    config = SearchConfig(**model["config"])
    return evaluate(with_states(panel, config), model["motif"], config)["score"] > 0


def walk_forward(
    years: list[int], panel_of, trials: int, seed: int = 0, downsample: int | None = None, path: str | None = None, configs: list[SearchConfig] | None = None, motifs: list[list[float]] | None = None, gate: bool = True
) -> list[tuple[int, dict, DataFrame]]:
    """(year, model, scores) per year: keep last year's model while it holds on the training year, else search anew.

    ``panel_of(year, config)`` gives the panel of a year, trimmed to it. The model of year y, its tercile bounds too, is
    learned on year y - 1 alone. A year without a significant model is skipped, unless ``gate`` is off, which scores by the best
    one whatever its test says. ``configs`` and ``motifs`` take the place of drawn and
    discovered ones. Under ``path`` models, trials and scores are kept as tables by year; what is returned reads from them.
    """
    out, model = [], None
    for y in years:
        if model is None or not still_good(model, panel_of(y - 1, SearchConfig(**model["config"]))):
            start = SearchConfig(**model["config"]) if model else None
            drawn = configs or draw_configs(trials, seed + y, start)
            drawn = [replace(c, downsample=downsample) for c in drawn] if downsample else drawn
            told: list[tuple[dict, float]] = []
            model = search(lambda c, y=y: panel_of(y - 1, c), drawn, motifs=motifs, tried=lambda c, score, t=told: t.append((asdict(c), score)))
            if path:
                # At once, as trials run side by side and two writers to one table would meet.
                io.append_trials(panel_of(y - 1, drawn[0]).sparkSession, f"{path}/trials", told)
        if model is None or not model["network"] or (gate and model["score"] <= 0):
            model = None
            continue
        scores = predict(panel_of(y, SearchConfig(**model["config"])), model)
        if path:
            io.save_model(scores.sparkSession, f"{path}/models", y, model["config"], model["motif"], model["network"], model["score"], model["bounds"])
            # One ordered table a year, replaced when the year is run again.
            scores.write.mode("overwrite").parquet(f"{path}/scores/year={y}")
            scores = scores.sparkSession.read.schema(scores.schema).parquet(f"{path}/scores/year={y}")
        out.append((y, model, scores))
    return out


def prepare_universe(daily: DataFrame, ipo: DataFrame, path: str) -> dict:
    """Write the point-in-time universe once; ``dret_path`` is its table, partitioned by the year of trading, and
    ``universe_sids`` the table of its sids (a table, as they grow with the market)."""
    rows = universe(daily, ipo)
    io.write_by(rows.withColumn("year", F.year("date")), f"{path}/global_daily", ["year"])
    kept = rows.sparkSession.read.parquet(f"{path}/global_daily")
    kept.select("sid").distinct().write.mode("overwrite").parquet(f"{path}/universe_sids")
    return {"dret_path": f"{path}/global_daily", "universe_sids": f"{path}/universe_sids"}


def yearly_bars(bars_of, years: list[int], path: str) -> dict:
    """Write the bars of each year's training year and of the year itself, each year once, partitioned by ``year``.

    ``bars_of(first, last)`` gives bars with a YYYYMMDD ``day`` between both. ``train`` and ``oos`` map a year to a path."""
    wanted = sorted({*years, *(y - 1 for y in years)})
    for y in wanted:
        bars_of(y * 10000 + 101, y * 10000 + 1231).write.mode("overwrite").parquet(f"{path}/bars/year={y}")
    at = {y: f"{path}/bars/year={y}" for y in wanted}
    return {"train": {y: at[y - 1] for y in years}, "oos": {y: at[y] for y in years}}


def direction_score(p_greater: float, p_less: float, difference: float, m: int, penalty_m: int = 24) -> float:
    """Second-generation score: the one-sided p on the side of the mean difference, 100 to .05 and 10 to .15, halved for
    motifs shorter than ``penalty_m``."""
    return ladder(p_greater if difference > 0 else p_less, strict=False) * (0.5 if m < penalty_m else 1.0)


def evaluate_whole_curves(panel: DataFrame, motif: list[float], w: int, limit: float, horizons: tuple[int, ...] = (1, 2, 3), bins: int = 5, penalty_m: int = 24) -> dict:
    """Second-generation model of a motif over whole curves of its length: the best horizon's score, its test values, and
    the (macro state, return bin) counts of the triggers with one prior count.

    ``panel``: day, sid, daily_curve, fwd_ret_<k>. Bins are equal-frequency per day. Fewer than five triggers score 0.
    """
    macro = macro_terciles(panel).select("day", "macro_state")
    rows = written(panel.select("sid", "day", F.transform("daily_curve", zero_if_not_finite).alias("curve"), *[f"fwd_ret_{k}" for k in horizons]).join(macro, "day", "left"), "whole-curves")
    best: dict = {"score": 0.0, "horizon": None, "triggers": 0}
    for k in horizons:
        ret = f"fwd_ret_{k}"
        known = rank_bins(rows, "day", ret, bins, "sid")
        hit = written(triggers(known, F.col("curve"), motif, w, limit, strict=True), "whole-triggers")
        stats = hit.agg(F.count(ret).alias("n"), F.avg(ret).alias("mean")).first()
        if stats["n"] < 5:
            continue
        both = hit.select(F.col(ret).alias("v"), F.lit(True).alias("first")).unionByName(known.select(F.col(ret).alias("v"), F.lit(False).alias("first")))
        up = normal_tail(mann_whitney(both, "v", F.col("first")).first()["z"])
        down = normal_tail(mann_whitney(both.withColumn("v", -F.col("v")), "v", F.col("first")).first()["z"])
        ks = ks_statistic(both, "v", F.col("first")).first()
        difference = stats["mean"] - known.agg(F.avg(ret)).first()[0]
        score = direction_score(up, down, difference, len(motif), penalty_m)
        if score > best["score"]:
            counts = posterior(hit, "macro_state", "bin", 3, bins)
            best = {"score": score, "horizon": k, "triggers": stats["n"], "p": min(up, down), "ks_p": ks_p(ks["d"], ks["n1"], ks["n2"]), "difference": difference, "counts": [r.asDict() for r in counts.collect()]}
    return best
