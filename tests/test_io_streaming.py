import pytest
from pyspark.sql import functions as F

from tidemark.session import new_path, shared_folder, written
from tidemark.sources import io
from tidemark.streaming import online


def test_readers(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    io.write_by(spark.range(5), a)
    df = io.read_existing(spark, [a, b])
    assert df.count() == 5 and io.read_existing(spark, [b], df.schema).count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_existing(spark, [b])
    df.write.option("header", True).csv(str(tmp_path / "c"))
    df.write.json(str(tmp_path / "j"))
    assert io.read_table(spark, str(tmp_path / "c"), "csv").count() == io.read_table(spark, str(tmp_path / "j"), "jsonl").count() == io.read_table(spark, a, "parquet").count() == 5
    with pytest.raises(ValueError, match="unknown"):
        io.read_table(spark, a, "xml")


def test_block_csv(spark):
    rows = [("f", 0, "title"), ("f", 1, "id;n;o,c;m;o,c"), ("f", 2, "1;x;1,2;y;3,"), ("f", 3, "2;x;4;;"), ("f", 4, "3"), ("g", 0, ""), ("g", 1, "id;k;v"), ("g", 2, "7;t;8"), ("h", 2, "9;t;8")]
    lines = spark.createDataFrame(rows, "file string, line_no int, value string")
    got = {(r.file, r.id, r.block, r["at"], r.field): r.value for r in io.block_rows(lines, file="file").collect()}
    assert got == {
        ("f", "1", "n", "x", "o"): 1.0, ("f", "1", "n", "x", "c"): 2.0, ("f", "1", "m", "y", "o"): 3.0, ("f", "1", "m", "y", "c"): None, ("f", "2", "n", "x", "o"): 4.0, ("f", "2", "n", "x", "c"): None,
        ("f", "2", "m", "", "o"): None, ("f", "2", "m", "", "c"): None, ("g", "7", "k", "t", "v"): 8.0,
    }
    assert io.block_rows(lines.where("file = 'g'").drop("file")).count() == 1 and io.block_rows(lines.where("false")).count() == 0


def test_wire_scales(spark):
    r = io.from_wire(spark.createDataFrame([(b"n1", 1234567, 2500, 7)], "name binary, open bigint, volume bigint, other int")).first()
    assert (r.name, r.open, r.volume, r.other) == ("n1", 12.35, 2.5, 7)


def test_shared_folder_is_the_session_s(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir") and new_path(spark, "x") != new_path(spark, "x")
    assert written(spark.range(3), "t").count() == 3


def events(spark, data):
    rows = spark.read.parquet(f"{data}/events.parquet")
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(data)
    cast = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))
    return cast(rows), cast(stream)


def test_stream_equals_batch(spark, data):
    batch, stream = events(spark, data)
    out = online.drain(online.tumbling(stream, "ts", ["event_type"], "value"), new_path(spark, "s"))
    whole = batch.groupBy("event_type", F.window("ts", "1 hour").alias("w")).count().select("event_type", F.col("w.start").alias("start"), F.col("count").alias("n"))
    assert out.count() > 0 and out.select("event_type", "start", "n").exceptAll(whole).count() == 0
    pairs = stream.select((F.col("user_id") % 2).alias("s"), (F.col("user_id") % 4).alias("b"))
    state = online.latest(online.drain(online.posterior_counts(pairs, "s", "b", 4), new_path(spark, "s"), "update"), ["s"])
    with pytest.raises(Exception, match="a bin outside the range"):
        online.drain(online.posterior_counts(pairs, "s", "b", 3), new_path(spark, "s"), "update")
    n = batch.count()
    assert sum(sum(r.counts) for r in state.collect()) == n + 8
    s = online.drain(online.sessions(stream, "ts", "user_id"), new_path(spark, "s"))
    assert s.agg(F.sum("n")).first()[0] <= n and s.count() > 0


def test_rate_limit_drops_the_excess(spark, tmp_path):
    rows = spark.range(10).select(F.lit("k").alias("key"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts")).unionByName(spark.sql("select 'k' key, timestamp_seconds(1000100) ts"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    out = online.drain(online.rate_limited(stream, "ts", "key", 4), new_path(spark, "s"))
    assert out.where("accepted").count() == 5 and out.count() == 11


def test_instruments_ranges_and_trials(spark, tmp_path):
    inst = spark.createDataFrame([("a", 1, 99991231), ("a", 1, 99991231), ("b", 1, 20000101), ("c", None, None)], "sid string, first_trading int, delist int")
    assert [r.sid for r in io.live_instruments(inst, 20040101).collect()] == ["a"]
    days = spark.createDataFrame([(20021231,), (20030601,), (20040601,), (20050101,)], "day int")
    assert sorted((r.day, r.warm_up) for r in io.warm_range(days, "day", 20040101, 20041231).collect()) == [(20030601, True), (20040601, False)]
    for s in (1.0, 2.0):
        io.append_trials(spark, str(tmp_path / "t"), [({"m": 1}, s)])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_a_stream_in_many_triggers_gives_the_last_counts_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(0, j % 2) for j in range(10 * (i + 1))], "s int, b int").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = online.file_stream(spark, str(tmp_path / "in/*"), "s int, b int", 1)
    path = new_path(spark, "s")
    rows = online.drain(online.posterior_counts(stream, "s", "b", 2), path, "update")
    assert rows.select("_batch").distinct().count() == 3 and [r.counts for r in online.latest(rows, ["s"]).collect()] == [[31, 31]]
    again = online.drain(online.posterior_counts(stream, "s", "b", 2), path, "update")
    assert [r.counts for r in online.latest(again, ["s"]).collect()] == [[31, 31]]
