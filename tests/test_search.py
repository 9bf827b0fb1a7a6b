import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search as S
from tidemark.sources import io


@pytest.fixture(scope="module")
def planted(spark):
    """A panel where days whose curve holds one shape are followed by a rise."""
    rng = np.random.default_rng(0)
    shape = np.sin(np.linspace(0, 3 * np.pi, 12)) * 0.5
    out = []
    for s in range(4):
        for d in range(25):
            curve, hit = rng.normal(0, 0.05, 48), rng.random() < 0.4
            if hit:
                at = int(rng.integers(0, 36))
                curve[at : at + 12] += shape
            r = [float(rng.normal(0.05 if hit else -0.01, 0.01)) for _ in range(3)]
            out.append((f"s{s}", d, curve.tolist(), curve.tolist(), 0.02, *r))
    df = spark.createDataFrame(out, "sid string, n int, daily_curve array<double>, lag_0 array<double>, vol_20d double, fwd_ret_1 double, fwd_ret_2 double, fwd_ret_3 double")
    return df.withColumn("day", F.date_add(F.lit("2004-01-01"), F.col("n"))).drop("n").cache()


def test_discovery_finds_the_shape_and_predicts(spark, planted, tmp_path):
    config = S.SearchConfig(candidates=2, threshold_r=0.9)
    model = S.discover(planted, config)
    assert model["score"] == 100.0 and model["triggers"] >= 5 and len(model["motif"]) == 12
    scores = S.predict(planted, model)
    assert scores.count() >= model["triggers"] and scores.where("abs(fsm_score) > 1").count() == 0
    io.save_model(spark, str(tmp_path / "m"), 2004, model["config"], model["motif"], model["network"], model["score"])
    assert io.latest_model(spark, str(tmp_path / "m"), 2003) is None and io.latest_model(spark, str(tmp_path / "m"), 2009)["motif"] == pytest.approx(model["motif"])
    assert scores.collect() == sorted(scores.collect(), key=lambda r: (r.day, -r.fsm_score, r.sid))
    assert S.still_good(model, planted)
    again = S.search(lambda c: planted, [config])
    assert again["motif"] == pytest.approx(model["motif"])


def test_configurations():
    assert S.SearchConfig(downsample=1, motif_minutes=360).problem() and S.SearchConfig().problem() is None
    assert S.draw_configs(5, 1) == S.draw_configs(5, 1) and all(c.problem() is None for c in S.draw_configs(20, 3))


def test_second_generation(planted):
    shape = (np.sin(np.linspace(0, 3 * np.pi, 12)) * 0.5).tolist()
    cut = planted.withColumn("daily_curve", F.slice("daily_curve", 1, 12))
    found = S.evaluate_whole_curves(cut, shape, 2, 3.0)
    assert found["score"] in (0.0, 5.0, 50.0) and S.direction_score(0.01, 0.99, 1.0, 30) == 100 and S.direction_score(0.01, 0.12, -1.0, 12) == 5
    assert S.guard(S.SearchConfig()) == (True, 0.0) and S.guard(S.SearchConfig(motif_minutes=30))[1] == -9999.0


def test_profile_queries_compare_all_sids(spark, data, planted, monkeypatch):
    from tidemark.plans import reference as R

    few = planted.where("day < '2004-01-04'")
    monkeypatch.setattr(R, "panel", lambda spark, d: few)
    z = lambda w: (w - w.mean()) / (w.std() + 1e-8)
    wins = [(f"{r.sid}|{r.day}", i, z(np.array(r.daily_curve[i : i + 12]))) for r in few.collect() for i in range(37)]
    all_w = np.stack([w for *_, w in wins])
    least = {}
    for s, i, w in wins:
        d = np.sqrt(((all_w - w) ** 2).sum(1))
        least[s, i] = min(x for x, (t, j, _) in zip(d, wins) if t != s or abs(i - j) > 3)
    got = R.matrix_profile(spark, data).collect()
    assert len(got) == len(wins) and all(r.distance == pytest.approx(least[r.series, r.pos], abs=1e-6) and r.sid == r.series.split("|")[0] for r in got)
    top = R.motif_topk(spark, data).orderBy("distance").first()
    assert top.distance == pytest.approx(min(least.values()), abs=1e-6)


def test_a_test_year_s_own_distribution_plays_no_part(spark, planted):
    """States of the test year come from the training year's terciles: shifting all flows of the test year shifts its states."""
    first = planted.where("day < '2004-01-16'")
    later = planted.where("day >= '2004-01-16'").withColumn("daily_curve", F.transform("daily_curve", lambda x: x + 5.0))
    panel_of = lambda y, c: first if y == 2004 else later
    shape = (np.sin(np.linspace(0, 3 * np.pi, 12)) * 0.5).tolist()
    [(year, model, scores)] = S.walk_forward([2005], panel_of, 1, configs=[S.SearchConfig(threshold_r=0.9)], motifs=[shape], gate=False)
    assert year == 2005 and model["bounds"] is not None
    rows = scores.collect()
    assert rows and {r.macro_state for r in rows} == {2}
    assert {r.macro_state for r in S.predict(later, model, mode="triggers").collect()} == {0, 1, 2}


def test_walk_forward_over_years(spark, planted, tmp_path):
    calls = []

    def panel_of(y, c):
        calls.append((y, c.downsample, c.cross_days))
        return planted

    shape = (np.sin(np.linspace(0, 3 * np.pi, 12)) * 0.5).tolist()
    configs = [S.SearchConfig(threshold_r=0.9), S.SearchConfig(threshold_r=0.95), S.SearchConfig(motif_minutes=360)]
    out = S.walk_forward([2005, 2006], panel_of, 3, path=str(tmp_path), configs=configs, motifs=[shape])
    assert [y for y, *_ in out] == [2005, 2006] and out[0][1] is out[1][1]  # held on the next training year
    # One panel for all configurations of the search, one for its session, then one to score, one to check the model and one to score.
    assert [y for y, *_ in calls].count(2004) == 2 and len(calls) == 5
    trials = sorted(r.metrics_score for r in spark.read.parquet(str(tmp_path / "trials")).collect())
    assert trials[0] == -9999.0 and len(trials) == 3
    assert io.latest_model(spark, str(tmp_path / "models"), 2006)["bounds"] == pytest.approx(out[0][1]["bounds"])
    assert spark.read.parquet(str(tmp_path / "scores")).groupBy("year").count().count() == 2
    noise = planted.withColumns({f"fwd_ret_{k}": F.lit(0.01) for k in (1, 2, 3)})
    assert S.walk_forward([2005], lambda y, c: noise, 1, configs=configs[:1], motifs=[shape]) == []


def test_missing_horizons_are_skipped(planted):
    two = planted.drop("fwd_ret_3")
    model = S.discover(two, S.SearchConfig(threshold_r=0.9), [(np.sin(np.linspace(0, 3 * np.pi, 12)) * 0.5).tolist()])
    assert {r["step"] for r in model["network"]} == {"macro_state->bin_1", "bin_1->bin_2"} and S.predict(two, model).count() > 0
    assert S.discover(planted.where("false"), S.SearchConfig()) is None


def test_top_motifs_store_only_what_they_pick_from(spark, data, monkeypatch):
    """Of the profile the names of nearest windows aren't kept, and of the windows no pairs."""
    import os

    from tidemark.plans import reference as R
    from tidemark.session import shared_folder

    def size():
        folder = shared_folder(spark).removeprefix("file:").replace("//", "/")
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files)

    curves = np.random.default_rng(9).normal(size=(150, 60))
    rows = spark.createDataFrame([(f"s{s}", "2004-01-02", c.tolist()) for s, c in enumerate(curves)], "sid string, day string, curve array<double>")
    monkeypatch.setattr(R, "finite_curves", lambda spark, d: rows)
    whole = R.M.matrix_profile
    monkeypatch.setattr(R.M, "matrix_profile", lambda *a: whole(*a, block=512))
    before = size()
    top = R.motif_topk(spark, data)
    assert top.columns == ["series", "pos", "distance"] and size() - before < 2 * 150 * 49 * 12 * 8


@pytest.mark.parametrize("copies", [0, 40])
def test_top_motifs_are_those_of_the_whole_profile(spark, copies):
    """Also where what blocks find alone is trivial once all windows are known."""
    from tidemark.operators import motif as M

    rng = np.random.default_rng(12)
    curves = rng.normal(size=(120, 40)).cumsum(axis=1).round(1)
    curves = np.vstack([curves, curves[:copies], curves[40 : 40 + copies] + rng.normal(size=(copies, 40)) * 1e-3])
    df = spark.createDataFrame([(s % 118, c.tolist()) for s, c in enumerate(curves)], "s int, c array<double>")
    whole = M.candidate_motifs(M.matrix_profile(df, ["s"], "c", 12).cache(), 12)
    assert len(whole) == 5
    for block in (64, 16384):
        got = M.top_motifs(df, ["s"], "c", 12, block=block)
        assert [x[:2] for x in got] == [x[:2] for x in whole] and [x[2] for x in got] == pytest.approx([x[2] for x in whole], abs=1e-9)
