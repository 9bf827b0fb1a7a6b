"""Structured Streaming: posterior counts, tumbling bars, sessions and rate limits.

Batch and stream share their expressions; every streaming frame is checked against its batch twin in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.io import read_existing


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of parquet files; the trigger size is the source's back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, to its end, and return what it wrote: a table under ``path``, in the shared folder,
    with the checkpoint beside it. Nothing passes the driver; errors of the query are raised.

    With mode ``update`` every trigger's rows carry its number as ``_batch``, so the latest row of a key can be told; a
    trigger that runs again replaces its own rows.
    """
    spark = stream.sparkSession
    table, checkpoint = f"{path}/table", f"{path}/checkpoint"
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode(mode).format("parquet").option("path", table).start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{table}/_batch={batch}")).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    return read_existing(spark, [table], schema)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of what a drained stream wrote in mode ``update``, the last row of each key."""
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("r")).select(*keys, "r.*")


def tumbling(stream: DataFrame, ts: str, keys: list[str], value: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, sum, least and greatest of a value per key and window, emitted once the watermark has passed its end."""
    w = F.window(ts, every)
    out = stream.withWatermark(ts, late).groupBy(*keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "least", "greatest")


def posterior_counts(stream: DataFrame, state: str, bin_: str, bins: int) -> DataFrame:
    """(state, counts) after every trigger: one prior count per bin plus what came. The rows of a trigger are first counted
    per (state, bin), combined before the shuffle, so a hot state is one small group; counts add up, so replays and order
    don't matter. A bin outside 0 to bins - 1 raises an error, null states and bins don't count. For mode ``update``."""
    known = stream.where(F.col(state).isNotNull() & F.col(bin_).isNotNull()).select(F.col(state).cast("int").alias(state), F.col(bin_).cast("int").alias(bin_))
    inside = F.when(F.col(bin_).between(0, bins - 1), F.col(bin_)).otherwise(F.raise_error(F.lit("a bin outside the range")).cast("int"))
    cells = [F.count_if(inside == b).alias(f"_{b}") for b in range(bins)]
    counts = known.groupBy(state).agg(*cells)
    return counts.select(state, F.array(*[F.col(f"_{b}") + 1 for b in range(bins)]).alias("counts"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key that end after a gap without events: what idle eviction would close."""
    out = stream.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited(stream: DataFrame, ts: str, key: str, per_minute: int = 60, late: str = "1 minute") -> DataFrame:
    """(key, ts, accepted): an event is dropped when ``per_minute`` were accepted in the 60 s before it.

    State of a key is the times it accepted in the last minute, at most ``per_minute``; it ends a minute after the key's last
    accepted event by event time, so idle keys cost nothing. Events of a trigger are taken in time order; events later than
    ``late``, and those at or before the epoch, are not seen.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        if kept.hasTimedOut:
            kept.remove()
            return
        recent = list(kept.get[0]) if kept.exists else []
        out = []
        for t in sorted(x for f in frames for x in f["_us"]):
            recent = [x for x in recent if x > t - 60_000_000]
            ok = len(recent) < per_minute
            if ok:
                recent.append(t)
            out.append((k[0], t, ok))
        kept.update((recent,))
        kept.setTimeoutTimestamp(max(max(recent, default=0) // 1000 + 60_000, kept.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[key, "_us", "accepted"])

    rows = stream.withWatermark(ts, late).select(key, ts, F.unix_micros(ts).alias("_us"))
    kind = dict(rows.dtypes)[key]
    out = rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, _us long, accepted boolean", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("_us").alias(ts), "accepted")
