import struct
import time

import numpy as np
from pyspark.sql import functions as F

from hearthwave.operators import features, scene
from hearthwave.sources import frames as wire
from hearthwave.streaming import jobs


def _blob(frame, points):
    body = np.asarray(points, "<f4").tobytes()
    return wire.MAGIC + struct.pack("<9I", 1, wire.HEADER + 8 + len(body), 0, frame, 0, len(points), 0, 1, 0) + struct.pack("<2I", 1, len(body)) + body


def test_ingest_writes_a_table_per_kind(spark, tmp_path):
    blobs = spark.createDataFrame([("a", bytearray(_blob(1, [(1, 2, 3, 4)]) + _blob(2, [(5, 6, 7, 8)])))], "path string, content binary")
    blobs.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(blobs.schema).parquet(f"{tmp_path}/in")
    jobs.ingest(source, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").where("kind = 'point'").orderBy("frame").collect()
    assert [(r["frame"], r["x"], r["doppler"]) for r in got] == [(1, 1.0, 4.0), (2, 5.0, 8.0)]


def _entries(spark, seconds=40, fps=20.0):
    t = np.arange(int(seconds * fps)) / fps
    d = 0.5 * np.sin(2 * np.pi * 0.25 * t)
    rows = []
    for b in (100, 101):
        z = np.exp(-1j * 4 * np.pi * d * (1 + 0.1 * (b - 100)) / 5.0)
        rows += [("s", b, 1_700_000_000.0 + i / fps, [float(v.real)] * 4, [float(v.imag)] * 4) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "sensor_id string, range_bin long, e double, re array<double>, im array<double>")
    return df.withColumn("ts", F.timestamp_micros((F.col("e") * 1_000_000).cast("long"))).drop("e")


def test_sliding_vitals_of_a_stream(spark, tmp_path):
    df = _entries(spark)
    batch = {r["start"]: r for r in jobs.vitals_windows(df, ["sensor_id"], "20 seconds", "10 seconds").collect()}
    full = [r for r in batch.values() if r["bins"] == 2 and abs(r["rr"] - 15) < 1.6]
    assert full and all(r["present"] for r in full)
    df.where("range_bin = 100 OR range_bin = 101").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = jobs.vitals_windows(source, ["sensor_id"], "20 seconds", "10 seconds")
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert got and all(batch[r["start"]]["rr"] == r["rr"] for r in got)


def test_stale_sensor_alarm(spark, tmp_path):
    df = spark.createDataFrame([("s", 1), ("s", 2)], "sensor_id string, frame long")
    df.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    run = jobs.stale_sensors(source, "sensor_id", seconds=1).writeStream.format("memory").queryName("stale").outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(60):
            rows = spark.sql("SELECT * FROM stale").collect()
            if rows:
                break
            time.sleep(0.5)
    finally:
        run.stop()
    assert [(r["sensor_id"], r["frames"]) for r in rows] == [("s", 2)]


def test_fresh_bins(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 1, 99.0), ("s", 2, 90.0)], "sensor_id string, range_bin long, t double")
    now = spark.createDataFrame([("s", 100.0)], "sensor_id string, now double")
    assert [(r["range_bin"], r["t"]) for r in jobs.fresh(df, ["sensor_id", "range_bin"], "t", now).collect()] == [(1, 99.0)]


def test_window_features_of_snapshots(spark):
    df = _entries(spark).select("sensor_id", "range_bin", (F.unix_micros("ts") / 1e6 - 1_700_000_000.0).alias("ts"), "re", "im")
    keys = ["sensor_id"]
    live = features.per_bin(df, keys, features.liveness, features.LIVE, 40.0, 40.0).collect()
    assert len(live) == 2 and all(r["live"] > 0.3 and abs(r["rate"] - 15) < 2 for r in live)
    burst = features.per_bin(df, keys, features.burst_state, features.BURST, 40.0, 40.0).collect()
    assert burst[0]["micro"] and abs(burst[0]["rr"] - 15) < 1.6
    parts = features.per_bin(df, keys, features.body_parts, features.PARTS, 40.0, 40.0).collect()
    assert {r["part"] for r in parts} == {"abdomen"}
    cube = features.per_bin(df, keys, features.cube_feature, features.CUBE, 40.0, 40.0).collect()
    assert cube[0]["n_cube"] == 1600 and cube[0]["rr_strength"] > 0
    grams = features.spectrogram_table(df, keys, 128, 64)
    assert abs(grams.groupBy("range_bin", "f").agg(F.percentile("above", 0.5).alias("m")).agg(F.max(F.abs("m"))).first()[0]) < 1e-9


def test_scene_parts(spark):
    boxes = spark.createDataFrame([("s", 0.0, 0.0, 1.0, 1.0, 1.0), ("s", 1.2, 0.0, 1.0, 1.0, 3.0), ("s", 9.0, 9.0, 1.0, 1.0, 1.0)], "sensor_id string, x0 double, y0 double, sx double, sy double, energy double")
    got = sorted((r["x0"], r["x1"], r["cx"], r["energy"]) for r in scene.merged(boxes, ["sensor_id"]).collect())
    assert got == [(0.0, 2.2, 0.5 * 0.25 + 1.7 * 0.75, 4.0), (9.0, 10.0, 9.5, 1.0)]
    cells = spark.createDataFrame([("s", c, 5, 0, 0, float(c), 0.0) for c in (1, 2, 3)], "sensor_id string, capture_id int, range_bin int, i int, j int, re double, im double")
    persons = spark.createDataFrame([("s", 3, 6)], "sensor_id string, capture_id int, person_bin int")
    kept = scene.accumulated(cells, persons, ["sensor_id"]).first()
    assert kept["re"] == 1.5 and kept["captures"] == 2
    model = scene.scene_model(spark.createDataFrame([("s", 5.0)], "sensor_id string, wall_m double"), boxes, spark.createDataFrame([("s", 1.0, 2.0)], "sensor_id string, x double, y double"), ["sensor_id"]).first()
    assert len(model["objects"]) == 3 and model["corners"][0]["y"] == 2.0
