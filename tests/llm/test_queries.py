"""Queries with SQL against DuckDB on the smallest tables; the others must run and hold their invariants."""

import os

import duckdb
import pytest

from tests.test_queries import canonical
from tidemark.llm import queries
from tidemark.llm.tokens import VOCABULARY, token_count


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("universe_month", "scores", "documents"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    assert canonical(queries.QUERIES[name](spark, data).toPandas()) == canonical(con.execute(queries.SQL[name]).fetchdf())


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= (0 if name == "p8_limits" else 1)  # too few texts for a limit


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_token_counts(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(None,), ("",), ("hello world",), ("a" * 100_000,), ("<|endoftext|>",)], "t string")
    got = [r.n for r in rows.select(token_count(F.col("t")).alias("n")).collect()]
    assert got[:3] == [0, 0, 2] and got[3] > 1000 and got[4] > 1


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_every_document_is_packed_whole_or_in_full_pieces(spark, data):
    sizes = queries._sizes(spark, data).toPandas().set_index("doc_id").tokens
    packs = queries.p6_packed(spark, data).toPandas()
    fill = queries.p6_fill(spark, data).toPandas().set_index("pack_id")
    for pack, rows in packs.groupby("pack_id"):
        capacity = rows.capacity_tokens.iloc[0]
        assert rows.groupby("doc_id").tokens.sum().to_dict() == sizes.to_dict()
        held = rows.dropna(subset=["container"])
        assert (held.groupby("container").tokens.sum() <= capacity).all()
        pieces = held.groupby("doc_id").piece.count()
        assert (pieces[sizes[pieces.index] <= capacity] == 1).all() and (pieces == -(-sizes[pieces.index] // capacity)).all()
        # Places lie one after another, without overlap.
        ordered = held.sort_values(["container", "offset"])
        ends = (ordered.offset + ordered.tokens).groupby(ordered.container).shift(1).fillna(0)
        assert (ordered.offset >= ends).all() and not ordered.duplicated(["container", "place"]).any()
        floor = -(-int(held.tokens.sum()) // capacity)
        assert floor <= fill.containers[pack] == held.container.nunique() and fill.containers[pack] <= floor + 1 + 0.1 * floor


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_mixed_shares_caps_and_slots(spark):
    """Over all documents of the middle scale, so that sources are large enough for their shares."""
    data = os.path.join(os.path.dirname(os.environ.get("TIDEMARK_TESTDATA", "/root/testdata/sf0.001")), "sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    out = queries._mixed(spark, data)
    shares, uses = out.shares.toPandas(), out.uses.toPandas()
    there = shares[shares.documents > 0]
    target = there.target_share / there.groupby("plan").target_share.transform("sum")
    # To 0.005, and to a block, which is what a slot holds: the rarest source of a plan can make it a few blocks in all.
    block = 256 / there.groupby("plan").used_tokens.transform("sum")
    assert ((there.actual_share - target).abs() < 0.005 + block).all() and (shares.most_uses <= shares.max_repeats).all()
    assert (uses.merge(shares, on=["plan", "source"]).eval("uses <= max_repeats")).all()
    # No larger plan keeps the caps: some source of each is used up.
    assert (there.assign(left=there.used_tokens / (there.available_tokens * there.max_repeats)).groupby("plan").left.max() > 0.97).all()
    slots = out.slots.groupBy("plan", "source", "doc_id").sum("tokens").toPandas().set_index(["plan", "source", "doc_id"])["sum(tokens)"]
    used = uses[uses.used_tokens > 0].set_index(["plan", "source", "doc_id"]).used_tokens
    assert slots.sort_index().to_dict() == used.sort_index().to_dict()


def test_source_shares_add_up_to_the_judged_texts(spark, data):
    judged = queries.p8_judged(spark, data).toPandas()
    shares = queries.p8_sources(spark, data).toPandas()
    assert shares["documents"].sum() == len(judged) and shares["cut"].sum() == judged["cut"].sum() == queries.p8_found(spark, data).count()
    assert (shares["cut"] == shares[["cut_by_length", "cut_by_omission", "cut_by_ending"]].sum(axis=1)).all()
