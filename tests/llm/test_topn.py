import random

import pytest

from tidemark.llm.topn import band_bounds, top_n

SCHEMA = "g string, id long, score double, day int, _band int, place string"


def top(spark, rows, n=3, bands=4):
    out = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "score", ["day", "id"], ["id"], n, bands)
    return sorted((r.g, r.place, r.id) for r in out.collect())


def brute(rows, n=3):
    best = {}
    for g, i, s, d, *_ in rows:
        if None in (g, i, s, d) or s != s:
            continue
        best.setdefault(g, {})
        best[g][i] = min(best[g].get(i, (1e9,)), (-s, d, i))
    return sorted((g, k + 1, i) for g, items in best.items() for k, (i, _) in enumerate(sorted(items.items(), key=lambda x: x[1])[:n]))


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_against_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(40)}", i, rng.randrange(levels) / 7 - 1, rng.randrange(5), 1, "x") for i in range(900)]
    rows += rng.sample(rows, 200)
    assert top(spark, rows) == brute(rows)


def test_nulls_ties_and_empty(spark):
    assert top(spark, []) == []
    rows = [(None, 1, 1.0, 1, 0, ""), ("a", None, 1.0, 1, 0, ""), ("a", 2, None, 1, 0, ""), ("a", 3, float("nan"), 1, 0, ""), ("a", 4, 1.0, None, 0, ""), ("a", 5, 1.0, 2, 0, ""), ("a", 6, 1.0, 1, 0, ""), ("a", 6, 1.0, 1, 9, "")]
    assert top(spark, rows) == [("a", 1, 6), ("a", 2, 5)]


def test_few_distinct_scores_give_few_bands(spark):
    df = spark.createDataFrame([("a", i, float(i % 2), 1, 0, "") for i in range(50)], SCHEMA)
    assert len(band_bounds(df, "score", 6)) <= 2 and band_bounds(df.where("false"), "score", 6) == []


def test_heavy_groups_are_split(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", i, rng.randrange(30) / 7, rng.randrange(5), 1, "x") for i in range(2000)]
    out = top_n(spark.createDataFrame(rows, SCHEMA), ["g"], "score", ["day", "id"], ["id"], 40, 4, split=50)
    assert sorted((r.g, r.place, r.id) for r in out.collect()) == brute(rows, 40)
    assert out.columns == ["g", "id", "score", "day", "place"]
