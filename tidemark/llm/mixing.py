"""Records of several sources mixed to target shares of all tokens, small sources repeated up to a cap.

The texts of a source are laid end to end and cut into blocks of a fixed number of tokens. A plan's size is the
largest at which no source is needed more often than its cap allows. Its slots, one block each, are dealt to output
shards: each shard draws its source counts from a multinomial over the sources' shares, given the plan's totals, which are
kept to the block. Draws given a total can be made from the top: the totals are parted between the two halves of the shards,
and again, each node with its own seed. The first levels are drawn on the driver, at most NODES nodes a plan; tasks go on from
there. Slot j of a source with n blocks is pass j div n, and a pseudorandom permutation of the source's block indexes,
another one each pass, tells which block it takes; so no block comes twice before all came once, and none more often than
the cap. Blocks are joined to slots by index: uses are added up by document, and the slots list what a mixed shard holds.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.prefix import positions
from tidemark.session import written

MAX_PLAN_ROWS = 100_000
NODES = 256
# Slots that one task unrolls.
UNROLL = 100_000


@dataclass(frozen=True)
class MixConfig:
    """block: tokens per block; shard: slots per output shard, the last one of a plan may hold fewer."""

    block: int = 256
    shard: int = 4096
    seed: int = 20


class Mix(NamedTuple):
    """What comes of a mix: uses of every document, shares reached, and the content of every shard."""

    uses: DataFrame
    shares: DataFrame
    slots: DataFrame


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser by xor-shifts and odd multipliers (public splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 6) -> np.ndarray:
    """For each index below size, its place under the permutation of 0..size-1 that ``key`` draws.

    A Feistel network over a grid of at least ``size`` cells, walked on while it leads outside the range; equal keys
    and sizes are one permutation.
    """
    index, size, key = (np.asarray(a).astype(np.uint64) for a in (index, size, key))
    rows = np.maximum(np.ceil(np.sqrt(size.astype(np.float64))), 1).astype(np.uint64)
    columns = (size + rows - np.uint64(1)) // rows
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = rows[todo], columns[todo]
        x, k = out[todo], key[todo]
        left, right = x // b, x % b
        for r in range(rounds):
            with np.errstate(over="ignore"):
                salt = _mix(k + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15))
                if r % 2 == 0:
                    left = (left + _mix(right ^ salt) % a) % a
                else:
                    right = (right + _mix(left ^ salt) % b) % b
        out[todo] = left * b + right
        todo = todo[out[todo] >= size[todo]]
    return out.astype(np.int64)


def quotas(shares: np.ndarray, limits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whole slots per source: the largest plan that keeps the shares of tokens within the limits.

    ``tokens`` is what a slot of a source holds on average: the last block of a small source may hold few.
    """
    have = (shares > 0) & (limits > 0)
    if not have.any():
        return np.zeros(len(shares), np.int64)
    p = np.where(have, shares, 0) / shares[have].sum()
    size = (limits[have] * tokens[have] / p[have]).min()
    return np.minimum(np.floor(np.where(have, p * size / np.where(have, tokens, 1), 0) + 0.5).astype(np.int64), limits)


def drawn(owed: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``take`` slots each source gets, dealt without replacement from ``owed``: what multinomial draws give
    once the totals are known. Beyond a thousand million slots by the normal law, which is the same to a slot in 30,000."""
    out, left, rest = np.zeros(len(owed), np.int64), int(take), int(owed.sum())
    for i, have in enumerate(int(x) for x in owed):
        others = rest - have
        low, high = max(0, left - others), min(have, left)
        if low == high:
            got = low
        elif rest < 1_000_000_000:
            got = int(rng.hypergeometric(have, others, left))
        else:
            share = have / rest
            got = min(max(round(rng.normal(left * share, math.sqrt(left * share * (1 - share) * (rest - left) / (rest - 1)))), low), high)
        out[i] = got
        left, rest = left - got, others
    return out


def split_node(node: tuple, seed: list[int], shard: int) -> list[tuple]:
    """The two halves of a node (first shard, end shard, slots, starts, owed); the same whoever splits it."""
    lo, hi, slots, starts, owed = node
    mid = lo + (1 << (hi - lo - 1).bit_length() - 1)
    take = min((mid - lo) * shard, slots)
    first = drawn(owed, take, np.random.default_rng([*seed, lo, hi]))
    return [(lo, mid, take, starts, first), (mid, hi, slots - take, starts + first, owed - first)]


def split_down(root: tuple, seed: list[int], shard: int, most: int | None = None) -> Iterator[tuple]:
    """Nodes of at most ``most`` levels below the root, or of one shard each, in order of their shards."""
    stack = [(root, 0)]
    while stack:
        node, level = stack.pop()
        if node[1] - node[0] <= 1 or level == most:
            yield node
        else:
            stack += [(half, level + 1) for half in reversed(split_node(node, seed, shard))]


def mix(sizes: DataFrame, plan: DataFrame, config: MixConfig = MixConfig()) -> Mix:
    """Uses of every document, the shares reached, and what each shard holds.

    ``sizes``: doc_id, source, tokens. ``plan``: plan, source, target_share, max_repeats; a configuration table of at
    most MAX_PLAN_ROWS rows, or it is refused. Sources are compared as they are. ``uses``: plan, source, doc_id,
    tokens, uses (how often its most used block comes, at most max_repeats), used_tokens; a row for each document of
    each plan's sources, unused ones with 0; documents without tokens or source are left out. ``shares``: plan,
    source, target_share, actual_share, max_repeats, most_uses, documents, available_tokens, used_tokens. A source
    without documents gets an actual share of 0 and the others share what it leaves, in proportion. ``slots``: plan,
    shard, slot (place in the shard, from 0), source, block, and the documents in it: doc_id, start (its first token there),
    tokens; a row per document of a slot's block. A doc_id that comes twice is laid twice.
    """
    c = config
    spark = sizes.sparkSession
    rows = plan.select("plan", "source", "target_share", "max_repeats").limit(MAX_PLAN_ROWS + 1).collect()
    if len(rows) > MAX_PLAN_ROWS:
        raise ValueError("the plan table is too large")
    wanted = sorted({r["source"] for r in rows if r["source"] is not None})
    docs = written(sizes.select("doc_id", "source", F.col("tokens").cast("long").alias("tokens")).where((F.col("tokens") > 0) & F.col("source").isin(wanted)), "mix-sizes")
    held = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()}  # one row per source of the plan
    blocks = {s: -(-held[s]["tokens"] // c.block) for s in held}

    nodes, total = [], 0
    for name in sorted({r["plan"] for r in rows}, key=str):
        own = sorted((r for r in rows if r["plan"] == name), key=lambda r: str(r["source"]))
        limits = np.array([blocks.get(r["source"], 0) * max(int(r["max_repeats"] or 0), 0) for r in own], np.int64)
        mean = np.array([held[r["source"]]["tokens"] / blocks[r["source"]] if r["source"] in held else 0.0 for r in own])
        owed = quotas(np.array([max(r["target_share"] or 0.0, 0.0) for r in own]), limits, mean)
        slots, draw = int(owed.sum()), zlib.crc32(str(name).encode())
        total += slots
        if slots:
            names, keys = [r["source"] for r in own], [zlib.crc32(f"{c.seed}/{name}/{r['source']}".encode()) for r in own]
            root = (0, -(-slots // c.shard), slots, np.zeros(len(own), np.int64), owed)
            nodes += [
                (name, draw, lo, hi, n, starts.tolist(), part.tolist(), names, [blocks.get(x, 0) for x in names], keys)
                for lo, hi, n, starts, part in split_down(root, [c.seed, draw], c.shard, NODES.bit_length() - 1)
            ]
    tree = spark.createDataFrame(nodes, "plan string, draw long, lo long, hi long, slots long, starts array<long>, owed array<long>, names array<string>, blocks array<long>, keys array<long>").repartition(max(1, min(len(nodes), -(-total // UNROLL))))

    def shards_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["plan", "shard", "size", "key", "source", "start", "count", "offset", "blocks", "draw"]
        for f in frames:
            for r in f.itertuples():
                out = []
                for lo, _, n, starts, owed in split_down((r.lo, r.hi, r.slots, np.array(r.starts), np.array(r.owed)), [c.seed, r.draw], c.shard):
                    offset = np.cumsum(owed) - owed
                    out += [(r.plan, lo, n, r.keys[i], r.names[i], starts[i], owed[i], offset[i], r.blocks[i], r.draw) for i in np.flatnonzero(owed)]
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=columns)
                        out = []
                yield pd.DataFrame(out, columns=columns)

    shards = tree.mapInPandas(shards_of, "plan string, shard long, size long, key long, source string, start long, count long, offset long, blocks long, draw long")
    # A row is at most a shard's slots; the number of tasks comes from the slots there are.
    shards = shards.repartition(max(8, -(-total // UNROLL)), "plan", "shard", "source")

    @F.pandas_udf(T.LongType())
    def permutation(index: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), size.to_numpy(), key.to_numpy()))

    unrolled = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i")).withColumn("j", F.col("start") + F.col("i"))
    block_of = permutation(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("key") + F.shiftleft(F.floor(F.col("j") / F.col("blocks")), 32))
    used_blocks = unrolled.select("plan", "source", block_of.alias("block")).groupBy("plan", "source", "block").agg(F.count(F.lit(1)).alias("uses"))
    place = permutation(F.col("offset") + F.col("i"), F.col("size"), F.col("draw") + F.shiftleft(F.col("shard"), 32))
    dealt = unrolled.select("plan", "shard", place.alias("slot"), "source", block_of.alias("block"))

    most = max((r["docs"] for r in held.values()), default=0)
    laid = positions(docs, ["source"], ["doc_id"], F.col("tokens"), max(8, math.ceil(most / 50_000)))
    first, last = F.floor(F.col("_before") / c.block), F.floor((F.col("_before") + F.col("tokens") - 1) / c.block)
    parts = laid.select("source", "doc_id", "tokens", "_before", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("_before"), F.col("block") * c.block)
    inside = F.least(F.col("_before") + F.col("tokens"), (F.col("block") + 1) * c.block) - begin
    # Slots unroll from a small table of shards, so their size is misjudged: as many rows as blocks, never broadcast.
    spans = parts.select("source", "block", "doc_id", (begin - F.col("_before")).alias("start"), inside.alias("tokens"))
    slots = dealt.join(spans.hint("merge"), ["source", "block"]).select("plan", "shard", "slot", "source", "block", "doc_id", "start", "tokens")

    plans = {s: sorted({r["plan"] for r in rows if r["source"] == s}, key=str) for s in wanted}
    if plans:
        by_source = F.create_map(*[x for s, names in plans.items() for x in (F.lit(s), F.array(*[F.lit(n) for n in names]))])
        planned = parts.withColumn("plan", F.explode(by_source[F.col("source")]))
    else:
        planned = parts.where("false").withColumn("plan", F.lit(""))
    used = planned.join(used_blocks.hint("merge"), ["plan", "source", "block"], "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    by_doc = used.groupBy("plan", "source", "doc_id", "tokens", "_before").agg(F.max("uses").alias("uses"), F.sum(F.col("uses") * inside).alias("used_tokens")).drop("_before")

    config_rows = spark.createDataFrame([(r["plan"], r["source"], r["target_share"], r["max_repeats"]) for r in rows], "plan string, source string, target_share double, max_repeats int")
    sums = by_doc.groupBy("plan", "source").agg(F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available_tokens"), F.sum("used_tokens").alias("used_tokens"))
    totals = sums.groupBy("plan").agg(F.sum("used_tokens").alias("_all"))
    shares = config_rows.join(sums, ["plan", "source"], "left").join(totals, "plan", "left").select(
        "plan", "source", "target_share", F.coalesce(F.try_divide("used_tokens", "_all"), F.lit(0.0)).alias("actual_share"), "max_repeats",
        *[F.coalesce(x, F.lit(0)).alias(x) for x in ("most_uses", "documents", "available_tokens", "used_tokens")],
    )
    return Mix(by_doc, shares, slots)
