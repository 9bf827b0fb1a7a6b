"""Score cutoffs that keep a target fraction of each source's records, from a persistent dyadic count tree.

Scores are coded as 64-bit integers in their own order. The tree counts, for each source, the records under the dyadic
prefixes of 8, 16, 24 and 32 bits of the code; the last are its leaves, of a relative width of 2^-20, and levels between
them are not stored, as a walk takes 8 of them at once. A batch adds its node counts as one more part of the tree, and a
batch that comes again replaces its part; a manifest, put in place by a rename, says which parts count, so readers see a
batch wholly or not at all. Parts can be compacted into one. A target rank is found by walking down: among the at most 2^8
descendants of a source's current node that are stored next, the one that holds the rank is the next node. The leaf
reached is then refined over the distinct scores of its own records, 16 bits at a time, so equal scores are one count.
Distinct scores are stored by their first 12 bits (sign and exponent), so only the bands that hold a cutoff are read.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.operators.salting import fresh, spread_join
from tidemark.session import written

STEP, BAND, LEAF, REFINE, DEPTH = 8, 12, 32, 16, 64


def codes(scores: np.ndarray) -> np.ndarray:
    """Integers whose unsigned order is that of falling scores. Minus zero is coded as zero."""
    bits = (np.asarray(scores, np.float64) + 0.0).view(np.int64)
    rising = np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
    return ~(rising ^ np.int64(-(2**63)))


def scores(code: np.ndarray) -> np.ndarray:
    """The scores of codes."""
    rising = ~np.asarray(code, np.int64) ^ np.int64(-(2**63))
    return np.where(rising >= 0, rising, rising ^ np.int64(0x7FFFFFFFFFFFFFFF)).view(np.float64)


@F.pandas_udf(T.LongType())
def code_of(score: pd.Series) -> pd.Series:
    return pd.Series(codes(score.to_numpy()))


@F.pandas_udf(T.DoubleType())
def score_of(code: pd.Series) -> pd.Series:
    return pd.Series(scores(code.to_numpy()))


def _prefix(code: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(code), DEPTH - bits) if bits < DEPTH else F.col(code)


class CountTree:
    """A count tree kept under ``path``; ``source`` names the key columns of its records. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, source: list[str]):
        self.spark, self.path, self.source = spark, path, source

    def _files(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> tuple[int, dict]:
        """Version and content of the manifest in force: ``parts`` maps batch ids to folders, ``compacted`` lists the batch
        ids that the folder ``base`` holds, ``source`` is the type of the key columns."""
        path, fs = self._files()
        folder = path(f"{self.path}/manifest")
        versions = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []
        if not versions:
            return 0, {"parts": {}, "base": None, "compacted": [], "source": None}
        source = fs.open(path(f"{self.path}/manifest/{versions[-1]}"))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return versions[-1], json.loads(text)

    def _publish(self, version: int, content: dict, gone: list[str]) -> None:
        path, fs = self._files()
        draft = path(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if not fs.rename(draft, path(f"{self.path}/manifest/{version + 1}")):
            raise RuntimeError("another writer changed the tree")
        for folder in gone:  # no longer counted, whether or not they can be deleted
            fs.delete(path(f"{self.path}/{folder}"), True)

    def _write(self, coded: DataFrame, folder: str) -> None:
        """``coded``: (source, code, n), a row per distinct score of a source."""
        scores_at = f"{self.path}/{folder}/scores"
        # Rebalanced: few files per band, and a band with most of the scores is split.
        coded.select("*", _prefix("code", BAND).cast("int").alias("band"), _prefix("code", LEAF).alias("leaf")).hint("rebalance", "band").write.partitionBy("band").parquet(scores_at)
        levels = list(range(STEP, LEAF + 1, STEP))
        nodes = (
            self._table(coded.select(*self.source).schema, "scores", folder)
            .select(*self.source, "n", F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.shiftrightunsigned("leaf", LEAF - b).alias("prefix")) for b in levels])).alias("at"))
            .groupBy(*self.source, F.col("at.bits").alias("bits"), F.col("at.prefix").alias("prefix"))
            .agg(F.sum("n").alias("n"))
        )
        nodes.hint("rebalance", "bits").write.partitionBy("bits").parquet(f"{self.path}/{folder}/nodes")

    def add(self, batch: DataFrame, score: str, batch_id: int) -> None:
        """Add the records of a batch. Null and NaN scores and null sources aren't counted; a ``batch_id`` seen
        before is replaced, so a batch that is run again counts once; if it was compacted since, it counts already and
        nothing is done. An empty batch adds nothing."""
        version, manifest = self._manifest()
        if batch_id in manifest["compacted"]:
            return
        rows = batch.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        for c in self.source:
            rows = rows.where(F.col(c).isNotNull())
        # Equal scores are one count from here on: no hot score or source is shuffled row by row. Minus zero and zero meet as codes.
        distinct = rows.groupBy(*self.source, F.col(score).cast("double").alias("_score")).agg(F.count(F.lit(1)).alias("n"))
        coded = distinct.select(*self.source, code_of("_score").alias("code"), "n").groupBy(*self.source, "code").agg(F.sum("n").alias("n"))
        folder = f"part-{uuid.uuid4().hex}"
        self._write(coded, folder)
        old = manifest["parts"].get(str(batch_id))
        self._publish(version, manifest | {"parts": manifest["parts"] | {str(batch_id): folder}, "source": coded.select(*self.source).schema.json()}, [old] if old else [])

    def compact(self) -> None:
        """Make one part of all; what the tree counts stays the same. Readers of the former parts must be done."""
        version, manifest = self._manifest()
        if not manifest["parts"]:
            return
        folder = f"base-{uuid.uuid4().hex}"
        self._write(self._read("scores").groupBy(*self.source, "code").agg(F.sum("n").alias("n")), folder)
        former = [*manifest["parts"].values(), *([manifest["base"]] if manifest["base"] else [])]
        self._publish(version, {"source": manifest["source"], "parts": {}, "base": folder, "compacted": sorted({*manifest["compacted"], *map(int, manifest["parts"])})}, former)

    def _table(self, source: T.StructType, table: str, folder: str) -> DataFrame:
        longs = {"nodes": ["prefix", "n"], "scores": ["code", "n", "leaf"]}[table]
        schema = T.StructType([*source.fields, *[T.StructField(c, T.LongType()) for c in longs], T.StructField({"nodes": "bits", "scores": "band"}[table], T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{table}")

    def _read(self, table: str) -> DataFrame | None:
        """Nodes or distinct scores of all parts that count, None if there is none; levels and bands are pruned by folder."""
        manifest = self._manifest()[1]
        folders = [*manifest["parts"].values(), *([manifest["base"]] if manifest["base"] else [])]
        frames = [self._table(T.StructType.fromJson(json.loads(manifest["source"])), table, f) for f in folders]
        return reduce(DataFrame.unionByName, frames) if frames else None

    def _step(self, at: DataFrame, children: DataFrame, step: int) -> DataFrame:
        """``at``: (source, prefix, rank, above). ``children``: (source, prefix of the node, child, n). The child that holds the rank."""
        falling = W.partitionBy(*self.source).orderBy(F.col("child").bitwiseAND(2**step - 1))
        both = at.join(children, [*self.source, "prefix"]).withColumn("_to", F.sum("n").over(falling.rowsBetween(W.unboundedPreceding, 0)))
        return both.where((F.col("_to") >= F.col("rank")) & (F.col("_to") - F.col("n") < F.col("rank"))).select(
            *self.source, F.col("child").alias("prefix"), (F.col("rank") - (F.col("_to") - F.col("n"))).alias("rank"), (F.col("above") + F.col("_to") - F.col("n")).alias("above"), F.col("n").alias("ties")
        )

    def ranked(self, ranks: DataFrame) -> DataFrame:
        """For (source, rank) with rank from 1, highest score first: the score there, how many are above it, how many
        equal it. Ranks beyond a source's records or below 1, and sources without records, give no row."""
        nodes, kept = self._read("nodes"), self._read("scores")
        at = ranks.select(*self.source, F.col("rank").cast("long").alias("rank"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("above")).where("rank >= 1")
        if nodes is None:
            return at.where("false").select(*self.source, F.lit(0.0).alias("score"), "above", F.col("above").alias("ties"))
        for bits in range(STEP, LEAF + 1, STEP):
            children = nodes.where(F.col("bits") == bits).groupBy(*self.source, F.col("prefix").alias("child")).agg(F.sum("n").alias("n"))
            at = self._step(at, children.withColumn("prefix", F.shiftrightunsigned("child", STEP)), STEP).drop("ties")
        at = written(at, "leaves")
        # Only records of the leaves reached are looked at from here on, in the at most 2^12 bands that hold one.
        bands = [r["band"] for r in at.select(F.shiftrightunsigned("prefix", LEAF - BAND).cast("int").alias("band")).distinct().collect()]
        leaves = at.select(*self.source, F.col("prefix").alias("leaf"))
        refined = kept.where(F.col("band").isin(bands)).join(leaves, [*self.source, "leaf"]).groupBy(*self.source, "code").agg(F.sum("n").alias("n"))
        for bits in range(LEAF + REFINE, DEPTH + 1, REFINE):
            children = refined.groupBy(*self.source, _prefix("code", bits).alias("child")).agg(F.sum("n").alias("n"))
            at = self._step(at, children.withColumn("prefix", F.shiftrightunsigned("child", REFINE)), REFINE)
            if bits < DEPTH:
                at = at.drop("ties")
        return at.select(*self.source, score_of("prefix").alias("score"), "above", "ties")

    def cutoffs(self, sizes: DataFrame, fraction: float, ties: str = "average") -> DataFrame:
        """Cutoff and kept size per source. ``sizes``: (source, records), the number that the fraction is of.

        Columns: source, records, cutoff, inclusive, kept: records with a score above the cutoff are kept, those equal
        to it if ``inclusive``. ``ties`` settles the scores around the target: ``average`` keeps equal scores if their
        average rank is within fraction * records, ``all`` if their first is, ``none`` if their last is. A source
        whose target holds no record has a null cutoff and keeps none.
        """
        target = F.lit(fraction) * F.col("records")
        nodes = self._read("nodes")
        nodes = sizes.select(*self.source, F.lit(STEP).alias("bits"), F.lit(0).cast("long").alias("n")).where("false") if nodes is None else nodes
        counted = nodes.where(F.col("bits") == STEP).groupBy(*self.source).agg(F.sum("n").alias("_scored"))
        wanted = sizes.join(counted, self.source).select(*self.source, F.least(F.floor(target), F.col("_scored")).alias("rank"))
        out = sizes.join(self.ranked(wanted), self.source, "left")
        last = {"average": F.col("above") + (F.col("ties") + 1) / 2, "all": F.col("above") + 1, "none": F.col("above") + F.col("ties")}[ties]
        inclusive = F.coalesce(last <= target, F.lit(False))
        out = out.select(
            *self.source, "records", F.col("score").alias("cutoff"), inclusive.alias("inclusive"),
            F.coalesce(F.col("above") + F.when(inclusive, F.col("ties")).otherwise(0), F.lit(0)).alias("kept"),
        )
        return written(out, "cutoffs")


def keep_above(df: DataFrame, score: str, cutoffs: DataFrame, source: list[str]) -> DataFrame:
    """The rows of ``df`` that their source's cutoff keeps, with all their columns; a hot source is spread over tasks.

    Rows with a null or NaN score or a null source are not kept, repeated rows are kept as often as they come.
    """
    value, inclusive = fresh("_cutoff", df), fresh("_inclusive", df)
    per = cutoffs.where("cutoff is not null").select(*source, F.col("cutoff").alias(value), F.col("inclusive").alias(inclusive))
    kept = spread_join(df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))), per, source)
    return kept.where((F.col(score) > F.col(value)) | (F.col(inclusive) & (F.col(score) == F.col(value)))).drop(value, inclusive)
