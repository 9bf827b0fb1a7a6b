"""Implausible readings: impossible values, spikes and stuck runs, judged against each source's own behaviour.

The series of a source is split into blocks of time with a halo on both sides. Blocks are hashed with their
source, so a hot source spreads over tasks and a group is bounded by the length of a block. One exchange and one
sort bring the rows of a block together; a NumPy kernel then works on many blocks at once, batch by batch:

* an undecimated Haar pyramid of the log level. At level j the detail of a row is its distance from the mean of
  the 2^j readings before it and of the 2^j after it (nulls skipped). A spike stands off on both sides in one
  direction, a lasting move only on one, so the smaller of two details of equal sign is thresholded. Details are
  scaled by the median absolute deviation of their level in the block. Readings found at one level are taken out before the
  next, coarser one, so that they don't blur its means;
* a series that steps away from its level and returns within some rows was false throughout: all rows between two opposite
  details of level 0 that stand off from both sides are spikes, whatever the width of a coarser level would see;
* the detail of level 0 is zero within a stuck run. A run counts when it is longer than the source's own rate of
  repeats explains;
* bounds: a price at or below zero, a negative or infinite reading, a high below its low, a close outside a sound
  range, no volume with a positive amount;
* a spike on the day of a lasting move shows in the distance from the row's own level, which such a move leaves alone;
* volume is judged through what price and amount imply: details of ln(volume) - ln(amount / level) and its distance from
  the median, against its own scale, of ln(volume) where amount is missing; a high or low that a false
  close carried along through the price that volume and amount imply.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.kernels.wavelet import excursions, group_median, neighbours, runs

FIELDS = ("high", "low", "close", "volume")


@dataclass(frozen=True)
class SpikeConfig:
    """longest: rows of the longest excursion that returns and is no lasting move; block, halo: in units of the position; the halo must hold more rows than 2^levels and the longest run a sid's rate of repeats explains.
    scale: multiples of the robust deviation that make a spike, beyond what heavy-tailed daily moves reach; jump, volume_jump: the least log distance of one;
    row_jump: the least one from the row's own level; carry_scale, carry_jump: the same for fields of a row whose close
    is a spike; lone_scale: the same for a volume that has no amount; lone_jump: the least one for a volume beside a stuck close.
    alpha: expected false runs per block.
    """

    block: int = 744
    halo: int = 93
    levels: int = 3
    longest: int = 32
    scale: float = 10.0
    jump: float = 0.06
    row_jump: float = 0.2
    carry_scale: float = 6.0
    carry_jump: float = 0.03
    volume_jump: float = 0.1
    lone_scale: float = 6.0
    lone_jump: float = 3.4
    alpha: float = 0.01


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.where((x > 0) & np.isfinite(x), x, np.nan))


def judge(group: np.ndarray, rows: dict[str, np.ndarray], c: SpikeConfig) -> dict[str, np.ndarray]:
    """For each field an array of reasons: 0 none, 1 bounds, 2 spike, 3 stuck. Rows are sorted by group and time."""
    groups = int(group[-1]) + 1 if len(group) else 0
    log = {f: _log(rows[f]) for f in (*FIELDS, "open", "amount")}
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        row_level = np.nanmedian(np.stack([log[f] for f in ("open", "high", "low", "close")]), axis=0)
        before, after = neighbours(row_level, group, 1)
        level = np.where(np.isnan(row_level + before + after), np.where(np.isnan(row_level), before, row_level), np.median(np.stack([row_level, before, after]), axis=0))
    implied = log["amount"] - log["volume"]

    spike = {}
    scale = {}
    for f in ("high", "low", "close"):
        x = log[f]
        seen, hit = x.copy(), np.zeros(len(x), bool)
        for j in range(c.levels):
            width = 2**j
            # A reading found before stays out of the means but is looked at no more.
            before, after = neighbours(seen, group, width)
            before, after = x - before, x - after
            # Every level by the spread of its own details.
            own = 1.4826 * np.nan_to_num(group_median(np.abs(before), group, groups))[group]
            scale.setdefault(f, own)
            # At the ends of a series a missing side is the distance from the price that amount and volume imply.
            before = np.where(np.isnan(before), x - implied, before)
            after = np.where(np.isnan(after), x - implied, after)
            least = np.where(np.sign(before) == np.sign(after), np.minimum(np.abs(before), np.abs(after)), 0)
            now = least > np.maximum(c.jump, c.scale * own)
            hit |= now
            seen = np.where(now, np.nan, seen)
        spike[f] = hit | excursions(seen, group, c.longest, np.maximum(c.jump, c.scale * scale[f]))

    def robust(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance from the group's median, and the scale of that distance."""
        off = np.abs(x - group_median(x, group, groups)[group])
        return off, 1.4826 * np.nan_to_num(group_median(off, group, groups))[group]

    def details(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smaller of the details of level 0 on both sides where they agree in sign, and their scale."""
        before, after = neighbours(x, group, 1)
        before, after = x - before, x - after
        size = 1.4826 * np.nan_to_num(group_median(np.abs(before), group, groups))[group]
        return np.where(np.sign(before) == np.sign(after), np.minimum(np.abs(before), np.abs(after)), 0), size

    beyond = {}  # distance from the price that amount and volume imply
    for f in ("high", "low", "close"):
        from_row, row_scale = robust(log[f] - row_level)
        beyond[f] = robust(log[f] - implied)
        off = np.fmin(from_row, beyond[f][0])
        spike[f] |= off > np.maximum(c.row_jump, c.scale * row_scale)

    # The volume that amount and price imply; the nearer of two price levels counts, as one may be false. The ratio has no
    # lasting moves, so its distance from the median finds what its details find and false volumes side by side, too.
    ratio = log["volume"] - log["amount"]
    off_level, level_scale = robust(ratio + level)
    off_volume = np.fmin(off_level, robust(ratio + row_level)[0])
    volume_detail, detail_scale = details(np.where(np.isnan(ratio), np.nan, ratio + level))
    lone_detail, usual = details(log["volume"])
    alone = np.isnan(implied) & (lone_detail > np.maximum(c.volume_jump, c.lone_scale * usual))

    h, lo, cl, v = (rows[f] for f in FIELDS)
    crossed = h < lo
    sound = (h >= lo) & (lo > 0) & ~spike["high"] & ~spike["low"]
    bounds = {
        "high": (h <= 0) | crossed | np.isinf(h),
        "low": (lo <= 0) | crossed | np.isinf(lo),
        "close": (cl <= 0) | np.isinf(cl) | (sound & ((cl > h) | (cl < lo))),
        "volume": (v < 0) | np.isinf(v) | ((v == 0) & (rows["amount"] > 0)),
    }
    out, stuck = {}, {}
    # Volume or amount 0 and the other one unknown may be a pause, whose unchanged prices are no stuck ones.
    pause = (np.isnan(v) & (rows["amount"] == 0)) | ((v == 0) & np.isnan(rows["amount"]))
    for f in FIELDS:
        length, begins, n, repeats = runs(np.where(pause, np.nan, rows[f]), group, groups)
        # Of a field that repeats at a rate, this share of all runs is longer than one. A run counts once, so a stuck
        # one doesn't excuse itself, however long; a sid without repeats is taken to have one.
        rate = np.clip(np.maximum(repeats, 1) / np.maximum(np.bincount(group[begins], minlength=groups), 1), 1e-9, 0.99)
        needed = np.maximum(np.ceil(np.log(np.maximum(n, 1) / c.alpha) / -np.log(rate)) + 1, 2)
        stuck[f] = ~begins & (length >= needed[group])
    off = (off_volume > np.maximum(c.volume_jump, c.scale * level_scale)) | ((volume_detail > np.maximum(c.volume_jump, c.scale * detail_scale)) & (off_volume > c.volume_jump))
    spike["volume"] = alone | np.where(stuck["close"], off_volume > np.maximum(c.lone_jump, c.scale * level_scale), off)
    for f in FIELDS:
        out[f] = np.where(bounds[f], 1, np.where(spike[f], 2, np.where(stuck[f], 3, 0)))
    # A close that is a spike pulls the high up or the low down to itself, beyond the open; a stuck one lies where the sid trades.
    toward = np.sign(log["close"] - implied)
    from_open = {f: np.where(np.isnan(log["open"]), np.inf, np.abs(log[f] - log["open"])) for f in ("high", "low")}
    for f, way in (("high", 1), ("low", -1)):
        off, off_scale = beyond[f]
        carried = (out["close"] == 2) & (out["volume"] == 0) & (out[f] == 0) & (toward == way) & (from_open[f] > c.carry_jump) & (off > np.maximum(c.carry_jump, c.carry_scale * off_scale))
        out[f] = np.where(carried, 2, out[f])
    return out


def implausible_readings(df: DataFrame, source: str, time: str, position: Column, config: SpikeConfig = SpikeConfig()) -> DataFrame:
    """Readings that can't be real, as rows (source, time, field, value, reason).

    ``df`` has one row per (source, time) with numeric columns open, high, low, close, volume and amount; ``position``
    maps time to a number that rises with it. Rows with volume 0 and amount 0 are pauses
    and are left out; where one of them is 0 and the other unknown, only runs leave the row out. Null and NaN readings are no cases and are skipped over by runs and details. Rows with
    a null source or time are ignored. Other columns are ignored, so their names can't clash. An empty table gives no
    rows. Reasons: ``bounds``, ``spike``, ``stuck``; a field reported for several reasons comes once, with the first.
    """
    c = config
    numbers = ("open", "high", "low", "close", "volume", "amount")
    rows = df.select(
        F.col(source).alias("_s"), F.col(time).alias("_t"), position.alias("_p"), *[F.col(x).cast("double").alias(x) for x in numbers]
    ).where("_s is not null and _t is not null and _p is not null")
    rows = rows.where(~F.coalesce((F.col("volume") == 0) & (F.col("amount") == 0), F.lit(False)))
    first, last = F.floor((F.col("_p") - c.halo) / c.block), F.floor((F.col("_p") + c.halo) / c.block)
    blocks = rows.withColumn("_b", F.explode(F.sequence(first, last))).withColumn("_own", F.floor(F.col("_p") / c.block) == F.col("_b")).drop("_p")
    types = {x.name: x.dataType for x in blocks.schema}
    schema = T.StructType([
        T.StructField(source, types["_s"]), T.StructField(time, types["_t"]),
        T.StructField("field", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("reason", T.StringType()),
    ])

    def found(table: pa.Table) -> pa.RecordBatch | None:
        ids, b = table["_s"].combine_chunks().dictionary_encode(), table["_b"].to_numpy()
        s = ids.indices.to_numpy()
        new = np.ones(len(b), bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        own = table["_own"].to_numpy(zero_copy_only=False)
        values = {x: table[x].to_numpy() for x in numbers}
        reasons = judge(np.cumsum(new) - 1, values, c)
        parts = [(np.flatnonzero(own & (reasons[f] > 0)), f) for f in FIELDS]
        at = np.concatenate([x for x, _ in parts])
        if not len(at):
            return None
        why = np.concatenate([reasons[f][x] for x, f in parts])
        return pa.record_batch(
            [
                table["_s"].combine_chunks().take(pa.array(at)), table["_t"].combine_chunks().take(pa.array(at)),
                pa.array(np.repeat(FIELDS, [len(x) for x, _ in parts]).tolist(), pa.string()),
                pa.array(np.concatenate([values[f][x] for x, f in parts])),
                pa.array(np.array(["", "bounds", "spike", "stuck"])[why].tolist(), pa.string()),
            ],
            names=schema.names,
        )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            if not table.num_rows:
                continue
            # The last block may go on in the next batch; a block is bounded, so the rest is small.
            s, b = table["_s"], table["_b"].to_numpy()
            last = table.num_rows - 1
            end = pa.compute.equal(s, s[last]).to_numpy() & (b == b[last])
            cut = int(np.flatnonzero(end)[0])
            rest = table.slice(cut)
            if cut and (out := found(table.slice(0, cut))) is not None:
                yield out
        if rest is not None and rest.num_rows and (out := found(rest)) is not None:
            yield out

    return blocks.repartition("_s", "_b").sortWithinPartitions("_s", "_b", "_t").mapInArrow(kernel, schema)
