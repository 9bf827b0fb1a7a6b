"""Readers and writers: many-file scans, formats by name, block CSV, fixed-point feeds, model tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.exprs import rescaled

# Scales of the feed by field name.
SCALES = {**dict.fromkeys(("open", "high", "low", "close"), 1e-5), **dict.fromkeys(("volume", "amount", "bonus_share", "transfer", "bonus", "price", "ratio"), 1e-3)}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_existing(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """One scan over those of the paths that exist; with a schema, an empty table where none does."""
    there = [p for p in paths if exists(spark, p)]
    if there:
        return (spark.read.schema(schema) if schema else spark.read).parquet(*there)
    if schema is None:
        raise FileNotFoundError(f"none of {len(paths)} paths exists")
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, kind: str, schema: T.StructType | None = None) -> DataFrame:
    """parquet, csv (with header) or jsonl; another kind is an error."""
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.option("header", True).csv(path) if schema else reader.option("header", True).option("inferSchema", True).csv(path)
    if kind == "jsonl":
        return reader.json(path)
    raise ValueError(f"unknown kind {kind}")


def scan_sql(spark: SparkSession, query: str, files: dict[str, str], args: dict[str, object] | None = None) -> DataFrame:
    """A SQL query over parquet files: ``{name}`` in its text stands for the files of that name, ``:name`` for a bound value.
    Filters and columns reach the scan."""
    return spark.sql(query, args=args or {}, **{name: spark.read.parquet(path) for name, path in files.items()})


def write_by(df: DataFrame, path: str, partition: list[str] = ()) -> None:
    """Replace a parquet table, partitioned so that later scans prune."""
    (df.repartition(*partition).write.partitionBy(*partition) if partition else df.write).mode("overwrite").parquet(path)


def block_rows(lines: DataFrame, column: str = "value", file: str | None = None) -> DataFrame:
    """(file, line_no, id, block, at, field, value) from lines of block CSV files.

    Cells are parted by ``;``: an id, then pairs of a name and a data cell. The second line of a file is its header: a pair's
    name there names the block, its data cell lists the fields by ``,``. In a row the name cell is ``at``, the block's own
    time or label, and the data cell has the values in the fields' order. Empty and non-numeric values are null; lines before
    the header, pairs without a header and rows without an id cell give nothing. ``lines`` has the text and ``line_no`` from 0
    within its file; ``file`` names the column that tells files apart, one file without it.
    """
    named = lines.select((F.col(file) if file else F.lit("")).alias("file"), "line_no", F.split(column, ";").alias("c"))
    # One header a file, met by its own rows only.
    header = named.where("line_no = 1").select("file", F.col("c").alias("h"))
    cells = named.where("line_no > 1").join(header, "file")
    pairs = F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.floor((F.size("h") - 1) / 2).cast("int") - 1, F.lit(0))), lambda i: i * 2 + 2 < F.size("h")))
    out = cells.select("file", "line_no", "c", "h", pairs.alias("i")).select(
        "file", "line_no", F.get("c", F.lit(0)).alias("id"), F.get("h", F.col("i") * 2 + 1).alias("block"), F.get("c", F.col("i") * 2 + 1).alias("at"),
        F.split(F.get("c", F.col("i") * 2 + 2), ",").alias("v"), F.split(F.get("h", F.col("i") * 2 + 2), ",").alias("k"),
    )
    return out.where("v is not null").select("file", "line_no", "id", "block", "at", F.posexplode("k").alias("j", "field"), "v").select(
        "file", "line_no", "id", "block", "at", "field", F.expr("try_cast(nullif(trim(get(v, j)), '') as double)").alias("value")
    )


def from_wire(df: DataFrame) -> DataFrame:
    """A feed's fixed-point columns as numbers of two digits, by name; a binary name as text; other columns as they are."""
    out = [rescaled(F.col(c), SCALES[c]).alias(c) if c in SCALES else F.decode(c, "UTF-8").alias(c) if c == "name" and kind == "binary" else F.col(c) for c, kind in df.dtypes]
    return df.select(*out)


def union_all(frames: list[DataFrame], schema: T.StructType | None = None, spark: SparkSession | None = None) -> DataFrame:
    """One table of many by column name; none gives an empty table of the schema."""
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


MODEL = "model_year int, config string, motif array<double>, network string, score double, bounds array<double>"


def save_model(spark: SparkSession, path: str, year: int, config: dict, motif: list[float], network: list[dict], score: float, bounds: list[float] | None = None) -> None:
    """Keep a model as one row, with the tercile bounds it learned; a year saved again is replaced. JSON, never pickled objects."""
    row = [(year, json.dumps(config, sort_keys=True), [float(x) for x in motif], json.dumps(network), float(score), None if bounds is None else [float(x) for x in bounds])]
    spark.createDataFrame(row, MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/year={year}")


def latest_model(spark: SparkSession, path: str, year: int) -> dict | None:
    """The newest model of a year up to ``year``, or None."""
    if not exists(spark, path):
        return None
    row = spark.read.parquet(path).where(F.col("year") <= year).orderBy(F.col("year").desc()).first()
    return None if row is None else {**row.asDict(), "config": json.loads(row["config"]), "network": json.loads(row["network"])}


def live_instruments(instrument: DataFrame, start: int) -> DataFrame:
    """(sid, first_trading, delist) of instruments not delisted by ``start`` (YYYYMMDD); exact duplicates collapse, an
    instrument without a delisting date isn't known to live and is left out."""
    return instrument.where(F.col("delist") > start).select("sid", "first_trading", "delist").distinct()


def warm_range(df: DataFrame, day: str, start: int, end: int, warm: int = 10_000) -> DataFrame:
    """Rows from ``warm`` before ``start`` (10000 is a year in YYYYMMDD) to ``end``, marked ``warm_up`` before ``start``.

    Both bounds reach the scan. What is computed over the range is trimmed by ``warm_up`` afterwards."""
    return df.where(F.col(day).between(start - warm, end)).withColumn("warm_up", F.col(day) < start)


def append_trials(spark: SparkSession, path: str, trials: list[tuple[dict, float]]) -> None:
    """Add tried configurations and their scores to the trials table."""
    rows = [(json.dumps(config, sort_keys=True), float(score)) for config, score in trials]
    spark.createDataFrame(rows, "config string, metrics_score double").write.mode("append").parquet(path)
