"""Streams with state in pieces: against their batch forms, over killed and repeated runs, late rows and silent bins."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthwave.operators import vitals
from hearthwave.streaming import jobs, live
from tests.test_streams import _blob

#: A job with timers of the clock has always another batch to run.
ONCE = {"once": True}
BASE = 1_700_000_000.0


def _snapshots(spark, seconds=50, fps=16.0, sensors=("a", "b")):
    t = np.arange(int(seconds * fps)) / fps
    rows = []
    for n, sensor in enumerate(sensors):
        d = 0.5 * np.sin(2 * np.pi * (0.2 + 0.1 * n) * t)
        for b in (100, 101):
            z = np.exp(-1j * 4 * np.pi * d * (1 + 0.1 * (b - 100)) / 5.0)
            rows += [(sensor, b, BASE + i / fps, [float(x.real)] * 4, [float(x.imag)] * 4) for i, x in enumerate(z)]
    return spark.createDataFrame(rows, "sensor_id string, range_bin long, ts double, re array<double>, im array<double>")


def _timed(df):
    return df.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def _feed(df, path, number):
    df.coalesce(1).write.mode("append").parquet(f"{path}/{number:03d}")


def _drain(out, tmp_path, name="out", trigger=None):
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(**(trigger or {"availableNow": True})).start(f"{tmp_path}/{name}").awaitTermination(120)
    return out.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_windows_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    """Rows come in six batches, cut across windows; each window equals the batch operator's on the same rows."""
    df = _snapshots(spark)
    for i in range(6):
        _feed(_timed(df.where((F.col("ts") >= BASE + 9 * i) & (F.col("ts") < BASE + 9 * (i + 1)))), f"{tmp_path}/in", i)
    source = spark.readStream.schema(_timed(df).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r["sensor_id"], r["start"]): r.asDict() for r in _drain(live.window_states(source, ["sensor_id"], 20.0, 3.0), tmp_path).collect()}
    want = {(r["sensor_id"], r["start"]): r.asDict() for r in vitals.vitals(df, ["sensor_id"], 20.0, 3.0).collect()}
    closed = {k for k in want if k[1] + 20.0 <= BASE + 50 - 1 / 16 - 10}
    assert set(got) == closed and len(closed) >= 14
    assert all(got[k] == want[k] for k in closed)
    # each snapshot that is still needed is in state once
    store = spark.read.format("statestore").option("stateVarName", "slabs").load(f"{tmp_path}/cp").select("key.sensor_id", "user_map_key.slab", "user_map_value.n").collect()
    last = max(k[1] for k in closed)
    needed = df.where(F.col("ts") >= last + 3.0).count()
    assert sum(r["n"] for r in store) == needed


def test_late_rows_are_dropped(spark, tmp_path):
    df = _timed(_snapshots(spark, sensors=("a",)))
    late = df.withColumn("ts", F.col("ts") - F.expr("INTERVAL 5 SECONDS")).where(F.col("ts") < F.timestamp_seconds(F.lit(BASE + 8)))
    _feed(df, f"{tmp_path}/in", 0)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    first = _drain(live.window_states(source, ["sensor_id"], 20.0, 10.0), tmp_path).count()
    _feed(late, f"{tmp_path}/in", 1)
    assert _drain(live.window_states(source, ["sensor_id"], 20.0, 10.0), tmp_path).count() == first
    store = spark.read.format("statestore").option("stateVarName", "slabs").load(f"{tmp_path}/cp").select("user_map_key.slab").collect()
    assert min(r["slab"] for r in store) * 10 > BASE + 8


def test_bins_are_fresh_as_in_batch(spark, tmp_path):
    rows = [("s", 1, 100.0), ("s", 2, 100.5), ("u", 1, 5.0)], [("s", 1, 104.0), ("s", 3, 103.0), ("u", 2, 9.0)], [("s", 3, 169.5), ("s", 4, 167.0)]
    schema = "sensor_id string, range_bin long, t double"
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    for i, part in enumerate(rows):
        _feed(spark.createDataFrame(part, schema), f"{tmp_path}/in", i)
        got = _drain(live.live_bins(source, ["sensor_id"]), tmp_path, trigger=ONCE).collect()
    told = {}
    for i in range(3):
        df = spark.createDataFrame([r for part in rows[: i + 1] for r in part], schema)
        now = df.groupBy("sensor_id").agg(F.max("t").alias("now"))
        for r in jobs.fresh(df, ["sensor_id", "range_bin"], "t", now).groupBy("sensor_id", "range_bin").agg(F.max("t").alias("t")).collect():
            told.setdefault(i, set()).add((r["sensor_id"], r["range_bin"], r["t"]))
    by_now = {("s", 100.5): 0, ("s", 104.0): 1, ("s", 169.5): 2, ("u", 5.0): 0, ("u", 9.0): 1}
    for (sensor, now), i in by_now.items():
        assert {(r["sensor_id"], r["range_bin"], r["t"]) for r in got if (r["sensor_id"], r["now"]) == (sensor, now) and r["fresh"]} == {x for x in told[i] if x[0] == sensor}
    last = {r["range_bin"] for r in got if r["sensor_id"] == "s" and r["now"] == 169.5}
    assert last == {3, 4}  # bin 1 was seen 65.5 seconds before, bin 2 even longer ago


def test_a_silent_bin_leaves_the_state(spark, tmp_path):
    """By the clock: nothing but the time to live takes it out."""
    schema = "sensor_id string, range_bin long, t double"
    _feed(spark.createDataFrame([("s", 1, 1.0), ("s", 2, 1.0)], schema), f"{tmp_path}/in", 0)
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    _drain(live.live_bins(source, ["sensor_id"], keep_s=15.0), tmp_path, trigger=ONCE)
    read = lambda: {r["b"] for r in spark.read.format("statestore").option("stateVarName", "bins").load(f"{tmp_path}/cp").select(F.col("user_map_key.range_bin").alias("b")).collect()}
    assert read() == {1, 2}
    time.sleep(16)
    _feed(spark.createDataFrame([("s", 2, 1.5)], schema), f"{tmp_path}/in", 1)
    rows = _drain(live.live_bins(source, ["sensor_id"], keep_s=15.0), tmp_path, trigger=ONCE).where("now = 1.5").collect()
    assert [(r["range_bin"], r["fresh"]) for r in rows] == [(2, True)] and read() == {2}


def test_a_batch_that_runs_twice_is_there_once(spark, tmp_path):
    write = live.replayable(f"{tmp_path}/out", ["kind"])
    rows = spark.createDataFrame([(1, "point"), (2, "track")], "frame long, kind string")
    write(rows, 0)
    write(rows.where("frame = 1"), 1)
    write(rows, 0)
    got = sorted((r["batch"], r["frame"], r["kind"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, 1, "point"), (0, 2, "track"), (1, 1, "point")]


def test_a_killed_ingest_goes_on_without_doubles(spark, tmp_path, monkeypatch):
    """The run dies after a batch's rows are written and before the batch is committed."""
    for i in range(3):
        _feed(spark.createDataFrame([(f"f{i}", bytearray(_blob(i, [(i, 2, 3, 4), (i, 5, 6, 7)])))], "path string, content binary"), f"{tmp_path}/in", i)
    source = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run(out, cp):
        jobs.ingest(source, f"{tmp_path}/{out}", f"{tmp_path}/{cp}").trigger(availableNow=True).start().awaitTermination(60)

    run("whole", "cp_whole")
    honest = live.replayable

    def dying(path, partitions):
        write = honest(path, partitions)

        def once(batch, number):
            write(batch, number)
            if number == 1:
                raise RuntimeError("killed")

        return once

    monkeypatch.setattr(jobs, "replayable", dying)
    with pytest.raises(Exception, match="killed"):
        run("broken", "cp_broken")
    assert spark.read.parquet(f"{tmp_path}/broken").where("batch = 1 AND kind = 'point'").count() == 2
    monkeypatch.setattr(jobs, "replayable", honest)
    run("broken", "cp_broken")
    columns = ["path", "frame", "x", "y", "z", "doppler"]
    whole, broken = (sorted(map(str, spark.read.parquet(f"{tmp_path}/{t}").where("kind = 'point'").select(*columns).collect())) for t in ("whole", "broken"))
    assert whole == broken and len(whole) == 6
