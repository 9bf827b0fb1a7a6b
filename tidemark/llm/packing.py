"""Documents of varying length into containers of fixed capacity, by shortest-pack-first over the length histogram.

Only the histogram of piece lengths, at most ``capacity`` counts, comes to the driver. There lengths are placed
longest first, each into the packs that are emptiest so far, and a new pack is opened only when none has room. Packs
with one history are one group with a count, so the work depends on the capacity and not on the number of
documents. What comes out are runs: so many pieces of one length, by rank, into so many containers from a first
one on. Runs are unrolled to slots and joined to the documents by (length, rank).
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix import positions
from tidemark.session import written

CHUNK = 50_000


def shortest_pack_first(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first container, offset, place) for a histogram of lengths from 1 to capacity.

    Every rank from 0 to count - 1 of each length lies in exactly one run; a container's runs don't overlap and end
    within the capacity. Containers are numbered from 0.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    groups: list[tuple[int, int, int, int]] = []  # (filled, first container, containers, pieces), emptiest first
    opened = 0
    for length in sorted(lengths, reverse=True):
        rank, count = 0, lengths[length]
        while rank < count:
            left = count - rank
            if groups and groups[0][0] + length <= capacity:
                filled, first, many, pieces = heapq.heappop(groups)
                now = min(left, many)
                runs.append((length, rank, now, first, filled, pieces))
                heapq.heappush(groups, (filled + length, first, now, pieces + 1))
                if now < many:
                    heapq.heappush(groups, (filled, first + now, many - now, pieces))
                rank += now
                continue
            each = capacity // length
            many, rest = divmod(left, each)
            for n, copies in ((many, each), (1, rest)):
                if n and copies:
                    for i in range(copies):
                        runs.append((length, rank, n, opened, i * length, i))
                        rank += n
                    heapq.heappush(groups, (copies * length, opened, n, copies))
                    opened += n
    return runs


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """Container and place of every document: (doc_id, piece, start, tokens, container, place, offset).

    ``sizes`` has doc_id and tokens. Only a document larger than the capacity is split: into full pieces that fill a
    container each, and a rest that is packed like any other length; ``start`` is the piece's first token in its
    document. A document without tokens takes no room: one row, piece 0, with null container, place and offset. A
    doc_id that comes twice is packed twice. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    pieces = sizes.select("doc_id", tokens.alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(tokens / capacity) - 1, F.lit(0)))).alias("piece")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.col("_all") - F.col("piece") * capacity, F.lit(capacity)).cast("int").alias("tokens")
    )
    full = pieces.where("tokens > 0")
    histogram = {r["tokens"]: r["count"] for r in full.groupBy("tokens").count().collect()}  # at most ``capacity`` rows
    empty = pieces.where("tokens = 0").select("*", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("offset"))
    if not histogram:
        return empty
    runs = pd.DataFrame(shortest_pack_first(histogram, capacity), columns=["tokens", "rank", "count", "container", "offset", "place"]).astype({"tokens": np.int32, "offset": np.int32, "place": np.int32})
    # Long runs are unrolled chunk by chunk, so that no task unrolls one alone; the number of tasks comes from the pieces. Runs
    # are read from the shared folder, so that no task carries them all.
    chunks = written(spark.createDataFrame(runs), "runs").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CHUNK).cast("long"))).alias("at")).repartition(max(8, -(-sum(histogram.values()) // (4 * CHUNK))), "tokens", "at", "container")
    slots = chunks.select("*", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + CHUNK, F.col("count")) - 1)).alias("i")).select(
        "tokens", (F.col("rank") + F.col("i")).alias("_before"), (F.col("container") + F.col("i")).alias("container"), "place", "offset"
    )
    parts = max(16, math.ceil(max(histogram.values()) / 100_000))
    ranked = positions(full, ["tokens"], ["doc_id", "piece"], F.lit(1).cast("long"), parts)
    # Slots come from a small table of runs, so their size is misjudged: as many rows as pieces, never broadcast.
    placed = ranked.join(slots.hint("merge"), ["tokens", "_before"]).select("doc_id", "piece", "start", "tokens", "container", "place", "offset")
    return placed.unionByName(empty)


def packed(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """``pack`` for each (pack_id, capacity), each by itself; ``sizes`` is written once and read for each."""
    kept = written(sizes.select("doc_id", "tokens"), "sizes")
    out = None
    for pack_id, capacity in capacities:
        one = pack(kept, capacity).select(F.lit(pack_id).alias("pack_id"), F.lit(capacity).alias("capacity_tokens"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return pack(kept, 1).where("false").select(F.lit(0).alias("pack_id"), F.lit(0).alias("capacity_tokens"), "*")
    return out


def fill(packs: DataFrame) -> DataFrame:
    """Containers, tokens and the share of space used, per pack."""
    return packs.where("container is not null").groupBy("pack_id", "capacity_tokens").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces")).withColumn(
        "used", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))
    )
