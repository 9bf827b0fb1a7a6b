"""The N best items of every group, exactly, for millions of groups of any size.

Scores are range-partitioned into bands, the top ones narrow. One aggregate with a map-side combine counts each group's
items per band. Bands are processed from the top: groups that are already filled are anti-joined away from the band's
groups, and the band is read once and meets what is left of these. A group whose count reaches N there has found its
boundary band; only rows of a boundary band need the whole tie rule, and a per-task limit drops all but N of a group before
they are shuffled. A band below which no group is open isn't read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.session import written

# Rows of a group in a band that are joined in one task at least; heavier groups are split. At most HEAVY splits in a band.
SPLIT, HEAVY = 100_000, 10_000


def band_bounds(df: DataFrame, score: str, bands: int) -> list[float]:
    """Lower bounds of the bands, highest first: approximate quantiles that leave the top 1/2, 1/4, ... of the rows above them.

    A quantile sketch of bounded size; its error moves work between bands but no result.
    """
    at = [1.0 - 0.5**k for k in range(bands - 1, 0, -1)]
    found = df.agg(F.percentile_approx(score, F.array(*[F.lit(x) for x in at]), F.lit(1000)).alias("q")).first()["q"] or []
    return sorted(set(found), reverse=True)


def _meet(rows: DataFrame, marks: DataFrame, group: list[str], identity: list[str], most: int, split: int) -> DataFrame:
    """Inner join of ``rows`` with one mark per group; the rows of groups over ``split`` rows are parted by identity."""
    if most <= split:
        return rows.join(marks, group)
    parted = marks.withColumn("_parts", F.ceil(F.col("_new") / split).cast("int"))
    # Groups over ``split`` rows of a band: at most HEAVY of them, by the choice of ``split``.
    heavy = parted.where("_parts > 1").select(*group, "_parts")
    salted = rows.join(F.broadcast(heavy), group, "left").withColumn("_salt", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64(*identity), F.col("_parts"))).otherwise(0).cast("int")).drop("_parts")
    copies = parted.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return salted.join(copies, [*group, "_salt"]).drop("_salt")


def top_n(df: DataFrame, group: list[str], score: str, ties: list[Column | str], identity: list[str], n: int, bands: int = 6, split: int = SPLIT) -> DataFrame:
    """The rows of the first ``n`` items of each group by ``score`` falling, then ``ties``, with ``place`` 1 to n.

    ``ties`` are column names (rising) or ordering expressions; they should settle every tie between items of
    different ``identity``. Rows of a group with equal ``identity`` are one item, ranked by its best row. Rows with
    a null or NaN score, or a null in group, ties given by name or identity, don't count. A group with fewer than n
    items gives all of them; an empty table gives no rows. Further columns are dropped, so names can't clash.
    """
    names = [t for t in ties if isinstance(t, str)]
    columns = list(dict.fromkeys([*group, *identity, score, *names]))
    counted = df.select(*columns)
    for c in columns:
        counted = counted.where(F.col(c).isNotNull())
    counted = counted.where(~F.isnan(F.col(score).cast("double")))
    order = [F.col(score).desc(), *[F.col(t).asc() if isinstance(t, str) else t for t in ties]]
    # One row per item: spread over (group, identity), so no group is ever one task's; a per-task limit drops repeated rows.
    key = list(dict.fromkeys([*group, *identity]))
    if set(columns) == set(key) | {score}:
        items = counted.groupBy(*key).agg(F.max(score).alias(score))
    else:
        items = counted.withColumn("_first", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_first = 1").drop("_first")
    bounds = band_bounds(counted, score, bands)
    band = reduce(lambda rest, k: F.when(F.col(score) >= F.lit(bounds[k]), F.lit(k)).otherwise(rest), range(len(bounds) - 1, -1, -1), F.lit(len(bounds)))
    every = range(len(bounds) + 1)
    banded = written(items.withColumn("_band", band), "score-bands", ("_band",))
    counts = written(banded.groupBy(*group).agg(*[F.count_if(F.col("_band") == k).alias(f"_in{k}") for k in every]), "band-counts")
    above = {k: sum((F.col(f"_in{j}") for j in range(k)), F.lit(0).cast("long")) for k in every}
    # Per band: rows of groups that are open there, and the most of one group.
    open_in = {k: F.when(above[k] < n, F.col(f"_in{k}")) for k in every}
    sizes = counts.agg(*[a for k in every for a in (F.coalesce(F.sum(open_in[k]), F.lit(0)).alias(f"rows{k}"), F.coalesce(F.max(open_in[k]), F.lit(0)).alias(f"most{k}"))]).first()

    kept: list[DataFrame] = []
    for k in every:
        if not sizes[f"rows{k}"]:
            continue
        filled = counts.where(above[k] >= n).select(*group)
        marks = counts.where(F.col(f"_in{k}") > 0).select(*group, above[k].alias("_above"), F.col(f"_in{k}").alias("_new"))
        marks = marks.join(filled, group, "left_anti") if k else marks
        rows = _meet(banded.where(F.col("_band") == k).drop("_band"), marks, group, identity, sizes[f"most{k}"], max(split, -(-sizes[f"rows{k}"] // HEAVY)))
        ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_rank") <= n)
        kept.append(ranked.where(F.col("_rank") <= n - F.col("_above")).withColumn("place", (F.col("_above") + F.col("_rank")).cast("int")).select(*columns, "place"))
    return reduce(DataFrame.unionByName, kept) if kept else items.where("false").select(*columns, F.lit(0).alias("place"))
