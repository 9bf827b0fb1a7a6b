import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import fill, pack, packed, shortest_pack_first

SCHEMA = "doc_id long, tokens long, piece string, container int"


def check_runs(lengths, capacity):
    used, at = defaultdict(int), defaultdict(set)
    spans = defaultdict(list)
    for length, rank, count, first, offset, place in shortest_pack_first(lengths, capacity):
        ranks = set(range(rank, rank + count))
        assert not ranks & at[length]
        at[length] |= ranks
        for c in range(first, first + count):
            spans[c].append((offset, offset + length, place))
            used[c] += length
    assert all(at[k] == set(range(n)) for k, n in lengths.items())
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(s, s[1:])) and [x[2] for x in s] == list(range(len(s)))
    return used


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_runs_cover_every_rank_once(lengths):
    used = check_runs(lengths, 50)
    assert set(used) == set(range(len(used)))
    # Any-fit: no two containers are half empty together.
    assert sum(2 * u <= 50 for u in used.values()) <= 1


def test_documents_are_placed_once_and_split_only_when_too_large(spark):
    rng = random.Random(0)
    docs = [(i, rng.choice([7, 7, 7, rng.randrange(1, 60), 100, 250]), "x", 1) for i in range(400)] + [(900, 0, "x", 1), (901, None, "x", 1), (None, 5, "x", 1)]
    out = pack(spark.createDataFrame(docs, SCHEMA), 100).collect()
    by_doc, by_container = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        if r.container is not None:
            by_container[r.container].append((r.offset, r.offset + r.tokens, r.place))
    assert set(by_doc) == {d[0] for d in docs}
    for d, n, *_ in docs:
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert sum(r.tokens for r in pieces) == (n or 0) and [r.start for r in pieces] == [100 * i for i in range(len(pieces))]
        assert len(pieces) == (1 if (n or 0) <= 100 else -(-n // 100))
    for spans in by_container.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 100 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and [s[2] for s in spans] == list(range(len(spans)))
    assert by_doc[900][0].container is None


def test_repeats_empty_and_capacities(spark):
    twice = pack(spark.createDataFrame([(1, 5, "", 0), (1, 5, "", 0)], SCHEMA), 8).collect()
    assert len(twice) == 2 and len({(r.container, r.offset) for r in twice}) == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert pack(empty, 8).count() == 0 and packed(empty, []).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        pack(empty, 0)
    both = fill(packed(spark.createDataFrame([(i, 3, "", 0) for i in range(10)], SCHEMA), [(1, 3), (2, 9)])).collect()
    assert {r.pack_id: (r.containers, r.used) for r in both} == {1: (10, 1.0), 2: (4, 30 / 36)}
