import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.cutoff import CountTree, codes, keep_above, scores
from tidemark.session import new_path

SCHEMA = "month int, id int, amount double, _salt int, _cutoff int, cutoff string"


def test_codes_keep_order_and_values():
    x = np.array([-np.inf, -1e300, -1.5, -1e-310, 0.0, 1e-310, 1.0, 1.0000000000000002, 7.5, np.inf])
    c = codes(x).view(np.uint64)
    assert (c[:-1] > c[1:]).all() and np.array_equal(scores(codes(x)), x) and codes(np.array([-0.0])) == codes(np.array([0.0]))


def kept(spark, batches, fraction=0.8, ties="average", compact=None):
    tree = CountTree(spark, new_path(spark, "tree"), ["month"])
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    for i, f in enumerate(frames):
        tree.add(f, "amount", i)
        tree.add(f, "amount", i)  # run again: counts once
        if compact == i:
            tree.compact()
            tree.add(f, "amount", i)  # counts already
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    cut = tree.cutoffs(every.groupBy("month").agg(F.count(F.lit(1)).alias("records")), fraction, ties)
    rows = keep_above(every, "amount", cut, ["month"])
    assert set(rows.columns) == set(every.columns)
    sizes = {r.month: r.kept for r in cut.collect()}
    got = [(r.month, r.id) for r in rows.collect()]
    assert sizes == {m: sum(1 for k in got if k[0] == m) for m in sizes}
    return set(got)


def brute(batches, fraction=0.8, ties="average"):
    rows = [r for b in batches for r in b if r[0] is not None]
    out = set()
    for m in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == m]
        scored = [r for r in own if r[2] is not None and r[2] == r[2]]
        for r in scored:
            above, equal = sum(x[2] > r[2] for x in scored), sum(x[2] == r[2] for x in scored)
            rank = {"average": above + (equal + 1) / 2, "all": above + 1, "none": above + equal}[ties]
            if rank <= fraction * len(own):
                out.add((m, r[1]))
    return out


@pytest.mark.parametrize("ties", ["average", "all", "none"])
def test_against_brute_force(spark, ties):
    rng = random.Random(1)
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, 5.0, round(rng.gauss(0, 3), 1), rng.gauss(1e6, 1e-6), rng.gauss(0, 1e9)])
    batches = [[(rng.choice([1, 1, 1, 2, 3, None]), 1000 * b + i, value(), 1, 1, "x") for i in range(150)] for b in range(3)]
    assert kept(spark, batches, ties=ties) == brute(batches, ties=ties)
    if ties == "average":
        assert kept(spark, batches, compact=1) == kept(spark, batches, compact=2) == brute(batches)


def test_edges(spark):
    one = [[(1, 1, 5.0, 0, 0, ""), (1, 1, 5.0, 0, 0, "")], [(2, 2, None, 0, 0, "")]]
    assert kept(spark, one) == {(1, 1)} and kept(spark, one, 0.1) == set() and kept(spark, one, 1.0) == {(1, 1)}
    tree = CountTree(spark, new_path(spark, "tree"), ["month"])
    empty = spark.createDataFrame([], SCHEMA)
    tree.add(empty, "amount", 0)
    assert tree.cutoffs(empty.groupBy("month").agg(F.count(F.lit(1)).alias("records")), 0.5).count() == 0


def test_a_replaced_batch_counts_by_its_last_run(spark):
    tree = CountTree(spark, new_path(spark, "tree"), ["month"])
    tree.add(spark.createDataFrame([(1, 1, 9.0, 0, 0, "")] * 5, SCHEMA), "amount", 0)
    tree.add(spark.createDataFrame([(1, 1, 3.0, 0, 0, ""), (1, 2, 2.0, 0, 0, "")], SCHEMA), "amount", 0)
    ranks = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "month int, rank int")
    assert sorted((r.score, r.above, r.ties) for r in tree.ranked(ranks.where("rank = 2")).collect()) == [(2.0, 1, 1)] and tree.ranked(ranks.where("rank = 3")).count() == 0
