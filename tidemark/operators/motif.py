"""Matrix profiles, candidate motifs and warped distances of curves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import motif_threshold, windows_of
from tidemark.kernels import dtw as K
from tidemark.kernels.mprofile import SLACK, Block, blocks_reached, cell_of, fit_tree, leaf_order, meet, meet_own, windows_of_flat
from tidemark.operators.globalrank import exact_quantiles
from tidemark.operators.salting import spread_join
from tidemark.session import written


def subsequence_distance(curve: Column, motif: list[float], w: int, limit: float) -> Column:
    """Least banded distance of any z-normalised window of a curve to the z-normalised motif; inf above ``limit``.

    Null curves give null; null points count as NaN. One Arrow batch is warped at once.
    """
    target = K.znorm(np.asarray(motif, float))

    @F.pandas_udf(T.DoubleType())
    def distance(curves: pd.Series) -> pd.Series:
        known = curves.notna()
        out = np.full(len(curves), np.nan)
        out[known.to_numpy()] = K.least_distance([np.asarray(c, dtype=float) for c in curves[known]], target, w, limit)
        return pd.Series(out).where(known.to_numpy(), None)

    return distance(curve)


def euclidean_least(curve: Column, motif: list[float]) -> Column:
    """The same without warping: a band of 1 is the z-normalised Euclidean distance."""
    return subsequence_distance(curve, motif, 1, float("inf"))


def triggers(panel: DataFrame, curve: Column, motif: list[float], w: int, limit: float, strict: bool = False) -> DataFrame:
    """Panel rows whose curve comes within ``limit`` of the motif, with the distance."""
    near = panel.withColumn("distance", subsequence_distance(curve, motif, w, limit))
    return near.where((F.col("distance") < limit) if strict else (F.col("distance") <= limit))


def series_windows(curves: DataFrame, series: list[str], curve: str, m: int) -> DataFrame:
    """(series, pos, window) of every window of finite values; none crosses two curves, so no separators are needed."""
    rows = curves.select(*series, F.posexplode(windows_of(F.col(curve), m)).alias("pos", "window"))
    return rows.where(~F.exists("window", lambda x: x.isNull() | F.isnan(x)))


# Curves that the tree is fitted on, and levels of the tree: bounds of what the driver holds.
SAMPLE_CURVES, MOST_LEVELS = 4096, 12
# Windows that a task is about, all at a time; fewer where cores would be idle.
WINDOWS_A_TASK = 1 << 17


def matrix_profile(curves: DataFrame, series: list[str], curve: str, m: int, exclusion: int | None = None, block: int = 16384) -> DataFrame:
    """(series, pos, distance, nn_series, nn_pos): of each window the nearest other one, z-normalised, exactly.

    Windows of one series within ``exclusion`` (a quarter of m, rounded up) of each other don't match. Windows with nulls or
    NaN are left out; a single window gives no row, an empty table none. Among windows at one distance, one is named.

    A tree fitted on at most SAMPLE_CURVES curves parts the space into at most 2^MOST_LEVELS cells; every window is put into
    its cell, and a cell of more than ``block`` windows is cut into blocks by a hash. A block is one file of the shared folder,
    with its windows as they are in the curves. A task takes a few blocks that lie next to each other; the windows of each
    first meet each other, which bounds their distances; then it reads, once for all its windows, only the blocks whose
    bounding box comes nearer than that to one of them. So windows far from each other never meet, equal windows (constant
    stretches, copies) are done within their block, and the result is that of comparing all pairs. Only windows are stored,
    once, and no pairs of them. A task holds blocks of WINDOWS_A_TASK windows in all, one more, and the boxes of all. PyArrow must be
    able to read the shared folder.
    """
    search, unnamed = _searched(curves, series, curve, m, exclusion, block)
    return _one_a_window(search(), unnamed)


def _one_a_window(found: DataFrame, unnamed: bool) -> DataFrame:
    """Of curves of one name the nearest of their windows at a position."""
    if not unnamed:
        return found
    best = F.min(F.struct(F.round("distance", 9).alias("r"), "nn_series", "nn_pos", "distance")).alias("m")
    return found.groupBy("series", "pos").agg(best).select("series", "pos", "m.distance", "m.nn_series", "m.nn_pos")


def top_motifs(curves: DataFrame, series: list[str], curve: str, m: int, r: float = 0.85, k: int = 5, trivial: float = 1e-5, exclusion: int | None = None, block: int = 16384) -> list[tuple[str, int, float]]:
    """``candidate_motifs`` of the matrix profile, without the rows of it that can't be picked.

    What the nearest windows of each block alone would give bounds the distance of the last pick; then every window is looked
    up to that distance only. Rows within it are those of the profile, so k picks among them are its picks; if they are fewer,
    windows are looked up to the threshold, past which none is picked.
    """
    search, unnamed = _searched(curves, series, curve, m, exclusion, block)
    limit = motif_threshold(m, r)
    first = candidate_motifs(written(search(limit, least_of_own=(16 * k, trivial)), "nearest"), m, r, k, trivial)
    for within in ([first[-1][2]] if len(first) == k else []) + [limit]:
        profile = _one_a_window(search(within), unnamed).select("series", "pos", "distance")
        picks = candidate_motifs(written(profile, "profile"), m, r, k, trivial)
        if len(picks) == k:
            break
    return picks


def _searched(curves: DataFrame, series: list[str], curve: str, m: int, exclusion: int | None, block: int) -> tuple[Callable[..., DataFrame], bool]:
    """Stores the windows; the search over them, and whether some curves have one name.

    The search gives the rows of the profile up to ``within``. ``least_of_own``: (n, trivial), only what a block's windows find
    among themselves, of each block the n least distances above ``trivial``.
    """
    exclusion = -(-m // 4) if exclusion is None else exclusion
    spark = curves.sparkSession
    named = written(curves.select(F.concat_ws("|", *series).alias("series"), F.col(curve).alias("curve")).where(F.size("curve") >= m), "curves")
    # Names are compared by their numbers.
    ids = written(named.select("series").distinct().withColumn("id", F.monotonically_increasing_id()), "series")
    total = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("curve") - (m - 1)), F.lit(0)).alias("windows")).first()
    parts = max(1, -(-total["n"] // SAMPLE_CURVES))
    sample = named.where(F.pmod(F.xxhash64("series", "curve"), F.lit(parts)) == 0).limit(SAMPLE_CURVES).select("curve").toPandas()["curve"]
    # Cells differ in size; at three quarters of a block most aren't cut.
    depth = min(max(int(np.ceil(np.log2(max(total["windows"], 1) / (block * 0.75)))), 0), MOST_LEVELS)

    drawn = [np.asarray(c, float) for c in sample]
    basis, dims, cuts = fit_tree(K.znorm(windows_of_flat(np.concatenate([np.zeros(0), *drawn]), np.array([len(c) for c in drawn]), m)[2]), depth)

    def in_cells(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, position, points as they are, and cell of the windows of a batch's curves."""
        c = part.column("curve")
        rows, at, points = windows_of_flat(c.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False), c.value_lengths().to_numpy(), m)
        return rows, at, points, cell_of(K.znorm(points) @ basis, dims, cuts)

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                yield batch.slice(start, 2048)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches_of(batches):
            cell, n = np.unique(in_cells(part)[3], return_counts=True)
            yield pa.record_batch([pa.array(cell, pa.int32()), pa.array(n, pa.int64())], names=["cell", "n"])

    # A row per cell, at most 2^MOST_LEVELS. Blocks are numbered along the cells, so that near ones follow each other.
    sizes = {r["cell"]: r["n"] for r in named.select("curve").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    blocks_of = np.zeros(2**depth, np.int64)
    for cell, n in sizes.items():
        blocks_of[cell] = -(-n // block)
    first_block = np.cumsum(blocks_of) - blocks_of

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per block and batch, with lists of the windows."""
        for part in batches_of(batches):
            rows, at, points, cell = in_cells(part)
            # A window that the last digits put into an empty cell goes to the one beside it.
            many = np.maximum(blocks_of[cell], 1)
            id_ = part.column("id").to_numpy()[rows]
            to = np.minimum(first_block[cell] + (id_ % 1_000_003 * 31 + at) % many, max(int(blocks_of.sum()) - 1, 0))
            order = np.argsort(to, kind="stable")
            number, n = np.unique(to, return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(n)], pa.int32())
            lists = [part.column("series").take(pa.array(rows[order])), pa.array(id_[order]), pa.array(at[order], pa.int32())]
            yield pa.record_batch([pa.array(number, pa.int32()), *[pa.ListArray.from_arrays(ends, x) for x in lists], pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)] * m, pa.int32()), pa.array(points[order].ravel()))], names=["block", "series", "id", "pos", "x"])

    def gather(table: pa.Table) -> pa.Table:
        """A block as one row: its windows in the order of their leaves, and its box."""
        names, id_, pos, x = (table[c].combine_chunks().flatten() for c in ("series", "id", "pos", "x"))
        x = x.to_numpy().reshape(-1, m)
        points = K.znorm(x) @ basis
        order = leaf_order(points)
        row = {"block": table["block"][0].as_py(), "low": points.min(axis=0) - SLACK, "high": points.max(axis=0) + SLACK, "series": names.take(pa.array(order)), "id": id_.to_numpy()[order], "pos": pos.to_numpy()[order], "x": x[order].ravel()}
        return pa.table([pa.array([v], f.type) if f.name == "block" else pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for f, v in zip(_BLOCK, row.values())], names=_BLOCK.names)

    chunks = named.join(ids, "series").mapInArrow(assign, "block int, series array<string>, id array<long>, pos array<int>, x array<double>")
    # A file per block, as its rows are one.
    tasks = max(-(-int(blocks_of.sum()) // 8), 1)
    stored = written(chunks.repartition(tasks, "block").groupBy("block").applyInArrow(gather, "block int, low array<double>, high array<double>, series array<string>, id array<long>, pos array<int>, x array<double>").withColumn("file", F.col("block")), "blocks", ("file",))
    boxes = stored.select("block", "low", "high", F.col("_metadata.file_path").alias("path")).orderBy("block").collect()
    low, high = (np.array([r[k] for r in boxes], float).reshape(len(boxes), m) for k in ("low", "high"))
    paths = [r["path"] for r in boxes]

    def columns_of(i: int, *columns: str) -> list[pa.Array]:
        system, path = FileSystem.from_uri(paths[i])
        with system.open_input_file(path) as f:
            table = pq.read_table(f, columns=list(columns))
        return [table[c].combine_chunks().flatten() for c in columns]

    def load(i: int) -> Block:
        id_, pos, x = (c.to_numpy() for c in columns_of(i, "id", "pos", "x"))
        return Block(K.znorm(x.reshape(-1, m)) @ basis, pos, id_)

    def least(batches: Iterator[pa.RecordBatch], within: float, n: int, trivial: float) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                b = load(i)
                best, who = meet_own(b, exclusion, within)
                rows = np.flatnonzero((who >= 0) & (best > trivial**2))
                rows = rows[np.argsort(best[rows], kind="stable")[:n]]
                names = columns_of(i, "series")[0]
                yield pa.record_batch([names.take(pa.array(rows)), pa.array(b.pos[rows], pa.int32()), pa.array(np.sqrt(best[rows])), names.take(pa.array(who[rows])), pa.array(b.pos[who[rows]], pa.int32())], names=["series", "pos", "distance", "nn_series", "nn_pos"])

    def nearest(batches: Iterator[pa.RecordBatch], within: float) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            blocks = [load(i) for i in own]
            sizes = [len(b.pos) for b in blocks]
            ends = np.cumsum(sizes)
            best, who = (np.concatenate(x) for x in zip(*(meet_own(b, exclusion, within) for b in blocks)))
            guests = Block(*(np.concatenate([getattr(b, c) for b in blocks]) for c in ("points", "pos", "series")), sizes)
            # Of what is found: its block, its row there and its position.
            home = np.repeat(own, sizes)
            at = np.where(who >= 0, home, -1)
            nn_pos = guests.pos[np.repeat(ends - sizes, sizes) + np.maximum(who, 0)]
            for j, rows in blocks_reached(guests, best, low, high, home):
                hosts = blocks[own.index(j)] if j in own else load(j)
                found = np.full(len(best), -1)
                meet(guests, rows, hosts, best, found, exclusion)
                rows = rows[found[rows] >= 0]
                at[rows], who[rows], nn_pos[rows] = j, found[rows], hosts.pos[found[rows]]
            del blocks
            # Their names come last, block by block.
            known = np.flatnonzero(at >= 0)
            known = known[np.argsort(at[known], kind="stable")]
            names, back = [pa.array([], pa.string())], np.empty(len(best), np.int64)
            back[known] = np.arange(len(known))
            for j, first, many in zip(*np.unique(at[known], return_index=True, return_counts=True)):
                names.append(columns_of(j, "series")[0].take(pa.array(who[known[first : first + many]])))
            nn_series = pa.chunked_array(names, pa.string()).combine_chunks()
            for i, end, size in zip(own, ends, sizes):
                rows = end - size + np.flatnonzero(at[end - size : end] >= 0)
                yield pa.record_batch([columns_of(i, "series")[0].take(pa.array(rows - end + size)), pa.array(guests.pos[rows], pa.int32()), pa.array(np.sqrt(best[rows])), nn_series.take(pa.array(back[rows])), pa.array(nn_pos[rows], pa.int32())], names=["series", "pos", "distance", "nn_series", "nn_pos"])

    a_task = max(min(len(boxes) // (2 * spark.sparkContext.defaultParallelism), WINDOWS_A_TASK * len(boxes) // max(total["windows"], 1)), 1)

    def search(within: float = np.inf, least_of_own: tuple[int, float] | None = None) -> DataFrame:
        numbers = spark.range(0, len(boxes), 1, max(-(-len(boxes) // a_task), 1))
        return numbers.mapInArrow((lambda x: least(x, within, *least_of_own)) if least_of_own else (lambda x: nearest(x, within)), "series string, pos int, distance double, nn_series string, nn_pos int")

    return search, total["n"] != ids.count()


_BLOCK = pa.schema([("block", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("series", pa.list_(pa.string())), ("id", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])


def candidate_motifs(profile: DataFrame, m: int, r: float = 0.85, k: int = 5, trivial: float = 1e-5) -> list[tuple[str, int, float]]:
    """Up to k best rows of a profile, each at least m positions from earlier picks of its series, within the threshold.

    One distributed minimum per pick; only picks come to the driver.
    """
    left = profile.where((F.col("distance") > trivial) & (F.col("distance") <= motif_threshold(m, r)))
    picks: list[tuple[str, int, float]] = []
    for _ in range(k):
        row = left.agg(F.min(F.struct("distance", "series", "pos")).alias("m")).first()["m"]
        if row is None:
            break
        picks.append((row["series"], row["pos"], row["distance"]))
        left = left.where(~((F.col("series") == row["series"]) & (F.abs(F.col("pos") - row["pos"]) <= m)))
    return picks


def anchored_chains(profile: DataFrame, anchors: DataFrame, limit: float) -> DataFrame:
    """(series, anchor, step, pos): from each anchor back along nearest windows that lie before it in its own series.

    ``anchors``: series, pos. A chain ends where the nearest window lies in another series or not before it, or is farther
    than ``limit``. A series' profile is bounded by its length, so a series is walked as one group; an anchor without a
    profile row gives nothing.
    """
    back = profile.where((F.col("nn_series") == F.col("series")) & (F.col("nn_pos") < F.col("pos")) & (F.col("distance") <= limit))
    known = profile.join(anchors.select("series", "pos").distinct(), ["series", "pos"]).select("series", "pos", F.lit(None).cast("int").alias("nn_pos"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        to = frame.dropna().set_index("pos")["nn_pos"].astype(int).to_dict()
        out = []
        for anchor in frame.loc[frame["nn_pos"].isna(), "pos"]:
            at, step = int(anchor), 0
            while at is not None:
                out.append((frame["series"].iloc[0], int(anchor), step, at))
                at, step = to.get(at), step + 1
        return pd.DataFrame(out, columns=["series", "anchor", "step", "pos"])

    return back.select("series", "pos", "nn_pos").unionByName(known).groupBy("series").applyInPandas(walk, "series string, anchor int, step int, pos int")


def mad_znormed(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``robust_z``: (x - median) / (1.4826 * median absolute deviation + 1e-8) of its key. Exact medians from
    counts of distinct values, and no task holds a key."""
    med = exact_quantiles(df, keys, value, {"_med": 0.5})
    off = spread_join(df, med, keys)
    mad = exact_quantiles(off.withColumn("_off", F.abs(F.col(value) - F.col("_med"))), keys, "_off", {"_mad": 0.5})
    return spread_join(off, mad, keys).withColumn("robust_z", (F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad") + 1e-8)).drop("_med", "_mad")
