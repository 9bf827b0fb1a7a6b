import random

import numpy as np
import pytest

from tidemark.llm.mixing import MixConfig, drawn, mix, permuted, quotas, split_down

DOCS = "doc_id long, source string, tokens long, plan string, uses int"
PLAN = "plan string, source string, target_share double, max_repeats int, tokens int"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(n):
    a, b = (permuted(np.arange(n), np.full(n, n), np.full(n, k)) for k in (5, 6))
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 10 or (a != b).any()


def test_quotas_and_draws():
    q = quotas(np.array([0.5, 0.3, 0.2]), np.array([1000, 1000, 100]), np.ones(3))
    assert q.tolist() == [250, 150, 100]
    assert quotas(np.array([0.5, 0.5]), np.array([0, 10]), np.ones(2)).tolist() == [0, 10] and quotas(np.zeros(2), np.zeros(2, int), np.ones(2)).sum() == 0
    root = (0, 8, 500, np.zeros(3, np.int64), q)
    shards = list(split_down(root, [1, 2], 64))
    counts = np.array([s[4] for s in shards])
    assert [s[:2] for s in shards] == [(i, i + 1) for i in range(8)]
    assert counts.sum(0).tolist() == q.tolist() and (counts.sum(1)[:-1] == 64).all() and len(np.unique(counts[:, 0])) > 1
    assert [s[3].tolist() for s in shards] == (np.cumsum(counts, axis=0) - counts).tolist()
    # A tree that is split in two goes gives the same shards.
    again = [x for node in split_down(root, [1, 2], 64, 2) for x in split_down(node, [1, 2], 64)]
    assert [(s[0], s[4].tolist()) for s in again] == [(s[0], s[4].tolist()) for s in shards]


@pytest.mark.parametrize("owed", [[3, 0, 5], [10**10, 3 * 10**10, 2], [0, 0, 7]])
def test_draws_keep_the_totals(owed):
    owed = np.array(owed, np.int64)
    for take in (0, 1, int(owed.sum()) // 2, int(owed.sum())):
        got = drawn(owed, take, np.random.default_rng(take))
        assert got.sum() == take and (got >= 0).all() and (got <= owed).all()


def test_slots_hold_what_uses_say(spark):
    rng = random.Random(1)
    docs = [(i, "big" if i % 3 else "small", rng.randrange(20, 900), "x", 1) for i in range(300)]
    plan = [("p", "big", 0.5, 1, 0), ("p", "small", 0.5, 3, 0), ("q", "big", 1.0, 2, 0)]
    out = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), MixConfig(block=64, shard=100))
    slots = out.slots.toPandas()
    held = slots.drop_duplicates(["plan", "shard", "slot"]).groupby(["plan", "shard"]).slot.agg(["min", "max", "count"])
    assert (held["min"] == 0).all() and (held["max"] == held["count"] - 1).all() and (held["count"].groupby("plan").apply(lambda n: (n.iloc[:-1] == 100).all())).all()
    assert (slots.groupby(["plan", "shard", "slot"]).tokens.sum() <= 64).all() and slots.groupby(["plan", "shard", "slot"])[["source", "block"]].nunique().max().max() == 1
    uses = out.uses.toPandas()
    used = slots.groupby(["plan", "source", "doc_id"]).tokens.sum()
    told = uses[uses.used_tokens > 0].set_index(["plan", "source", "doc_id"]).used_tokens
    assert used.sort_index().to_dict() == told.sort_index().to_dict()
    for (_, _, d), g in slots[slots["plan"] == "p"].groupby(["plan", "source", "doc_id"]):
        assert (g.start + g.tokens <= dict((i, t) for i, _, t, *_ in docs)[d]).all()


def test_shares_caps_and_uses(spark):
    rng = random.Random(0)
    docs = [(i, "big" if i % 3 else "small", rng.randrange(20, 900), "x", 1) for i in range(600)] + [(9000, "other", 50, "x", 1), (9001, None, 50, "x", 1), (9002, "big", None, "x", 1), (9003, "big", 0, "x", 1)]
    plan = [("p", "big", 0.5, 1, 0), ("p", "small", 0.5, 3, 0), ("q", "big", 0.7, 2, 0), ("q", "gone", 0.3, 2, 0)]
    uses, shares, _ = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), MixConfig(block=64, shard=100))
    got = {(r.plan, r.doc_id): r for r in uses.collect()}
    assert set(got) == {("p", i) for i in range(600)} | {("q", i) for i in range(600) if i % 3}
    assert all(r.uses <= {("p", "big"): 1, ("p", "small"): 3, ("q", "big"): 2}[r.plan, r.source] and r.used_tokens <= r.uses * r.tokens for r in got.values())
    s = {(r.plan, r.source): r for r in shares.collect()}
    assert len(s) == 4 and abs(s["p", "big"].actual_share - 0.5) < 0.01 and s["q", "gone"].actual_share == 0 and s["q", "big"].actual_share == 1
    assert s["p", "big"].used_tokens == sum(r.used_tokens for (p, _), r in got.items() if p == "p" and r.source == "big")
    again = mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), MixConfig(block=64, shard=100))[0]
    assert {(r.plan, r.doc_id): r.used_tokens for r in again.collect()} == {k: r.used_tokens for k, r in got.items()}


def test_tiny_sources_keep_their_share(spark):
    docs = [(i, "a", 1000, "", 0) for i in range(50)] + [(100, "b", 70, "", 0)]
    plan = [("p", "a", 0.98, 1, 0), ("p", "b", 0.02, 8, 0)]
    s = {r.source: r for r in mix(spark.createDataFrame(docs, DOCS), spark.createDataFrame(plan, PLAN), MixConfig(block=64))[1].collect()}
    assert abs(s["b"].actual_share - 0.02) < 0.003 and s["b"].most_uses <= 8


def test_empty_and_repeats(spark):
    empty_docs, empty_plan = spark.createDataFrame([], DOCS), spark.createDataFrame([], PLAN)
    plan = spark.createDataFrame([("p", "a", 1.0, 2, 0), ("n", "a", None, None, 0)], PLAN)
    assert mix(empty_docs, plan)[0].count() == 0 and mix(empty_docs, plan)[1].count() == 2 and mix(empty_docs, empty_plan)[1].count() == 0
    uses = mix(spark.createDataFrame([(1, "a", 100, "", 0), (1, "a", 100, "", 0)], DOCS), plan)[0].where("plan = 'p'").collect()
    assert len(uses) == 2 and all(r.used_tokens == 200 for r in uses)
