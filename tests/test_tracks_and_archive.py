"""Smoothed tracks by steps, the archive by day, and breath cycles taken out."""

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from hearthwave.helpers import signal as s
from hearthwave.operators import baseline, features, vitals
from hearthwave.streaming.steps import smooth_step


def _track(n, seed):
    e, level, out = random.Random(seed), 70.0, []
    for _ in range(n):
        level = e.choice([level] * 12 + [e.uniform(45, 140)])
        out.append(e.choice([None, float("nan"), level * e.uniform(0.95, 1.05), level * e.uniform(0.97, 1.03), level * e.uniform(0.5, 2)]))
    return out


def test_steps_equal_the_plain_loop():
    for seed in range(30):
        values = _track(200, seed)
        for options in ({}, {"use_median": True}, {"history": 3, "near": 0.05, "q": 0.3}):
            state = {}
            got = [smooth_step(state, {"hr": v}, **options)["hr_smooth"] for v in values]
            assert got == s.smoothed(values, **options)
            assert len(state["kept"]) <= options.get("history", 5) >= len(state["odd"])


def test_table_equals_stream_equals_loop(spark, tmp_path):
    tracks = {f"t{i}": _track(60, i) for i in range(3)}
    rows = [(k, float(i), None if v is None or math.isnan(v) else v, i % 2 == 0) for k, own in tracks.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "sensor_id string, start double, hr double, present boolean")
    want = {(k, float(i)): v for k, own in tracks.items() for i, v in enumerate(s.smoothed(own))}
    batch = vitals.smoothed_rates(df.repartition(6), ["sensor_id"])
    assert batch.columns == [*df.columns, "hr_smooth"]
    assert "FlatMapGroupsInPandas" not in batch._jdf.queryExecution().toString()
    assert {(r["sensor_id"], r["start"]): r["hr_smooth"] for r in batch.collect()} == want
    for i in range(3):
        df.where((F.col("start") >= 20 * i) & (F.col("start") < 20 * (i + 1))).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = vitals.smoothed_rates(source, ["sensor_id"])
    out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination(90)
    assert {(r["sensor_id"], r["start"]): r["hr_smooth"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_archive_reads_only_its_days(spark, tmp_path):
    day = datetime.datetime(2026, 1, 1, 12)
    rows = [(sensor, day + datetime.timedelta(days=d, hours=h), 1, float(d)) for sensor, days in (("a", range(60)), ("silent", range(5))) for d in days for h in (0, 6)]
    df = spark.createDataFrame(rows, "sensor_id string, ts timestamp, range_bin int, power double")
    for lo, hi in ((0, 20), (20, 60)):
        baseline.archive(df.where((F.col("power") >= lo) & (F.col("power") < hi)), str(tmp_path))
    got = baseline.recent_archived(spark, str(tmp_path), 7)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, baseline.recent(df, 7).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "power" in line)
    assert "PartitionFilters" in scan
    files = {f.split("day=")[1][:10] for f in got.inputFiles() if "day=" in f}
    read = {r["d"] for r in spark.read.parquet(f"{tmp_path}/sweeps").where(F.col("day").isin([datetime.date(2026, 1, 1) + datetime.timedelta(days=d) for d in (*range(5), *range(52, 60))])).select(F.col("day").cast("string").alias("d")).distinct().collect()}
    wanted = {str(datetime.date(2026, 1, 1) + datetime.timedelta(days=d)) for d in range(52, 60)} | {str(datetime.date(2026, 1, 1) + datetime.timedelta(days=d)) for d in range(5)}
    assert read == wanted and files >= wanted
    partitions = scan.split("PartitionFilters:")[1]
    assert "2026-01-20" not in partitions and "day" in partitions


def test_heart_tone_under_the_breath(spark):
    """A heart of a tenth of the breath is found once the breath's cycle, with its harmonics in the heart's band, is out."""
    fps, n = 20.0, 1200
    t = np.arange(n) / fps
    phase = 2 * np.pi * 0.25 * t
    breath = np.sin(phase) + 0.25 * np.sin(4 * phase + 0.4) + 0.2 * np.sin(5 * phase + 1)
    x = 0.5 * breath + 0.05 * np.sin(2 * np.pi * 1.37 * t)
    rows = [("s", b, i / fps, [float(np.cos(a))] * 4, [float(np.sin(a))] * 4) for b in (7, 8) for i, a in enumerate(-4 * np.pi / s.WAVELENGTH_MM * x)]
    df = spark.createDataFrame(rows, "sensor_id string, range_bin int, ts double, re array<double>, im array<double>")
    got = features.per_bin(df, ["sensor_id"], features.breath_cycles_out, features.CYCLES, 60.0, 60.0).collect()
    assert {r["range_bin"] for r in got} == {7, 8}
    for r in got:
        assert r["cycles"] >= 12 and r["removed"] > 0.9
        assert abs(r["hr_before"] - 82.2) > 5 and abs(r["hr_after"] - 82.2) < 1.5


def test_slow_map_day_by_day(spark):
    """Advanced a day at a time, and combined from all days at once: the closed form over all frames."""
    from hearthwave.operators import voxels as v

    e = random.Random(6)
    frames = {"a": [7, 3, 9, 5], "b": [4, 0, 6, 2]}
    rows, number = [], {"a": 0, "b": 0}
    for day in range(4):
        for sensor, days in frames.items():
            for f in range(1, days[day] + 1):
                number[sensor] += 1
                for cell in e.sample(range(6), 3):
                    rows.append((sensor, day, f, number[sensor], cell, 0, 1, e.random()))
                if number[sensor] == sum(days):
                    rows.append((sensor, day, f, number[sensor], 9, 0, 1, 1.0))
    df = spark.createDataFrame(rows, "sensor_id string, day int, f int, frame int, ix int, iy int, iz int, e double")
    counts = spark.createDataFrame([(s_, d, n) for s_, days in frames.items() for d, n in enumerate(days)], "sensor_id string, day int, n int")
    want = {(r["sensor_id"], r["ix"]): r["slow"] for r in v.ema_difference(df, ["sensor_id"], 0.05, "frame", 3).collect()}
    parts = v.day_maps(df, counts, ["sensor_id"], 0.05, "day", "f")
    at_once = {(r["sensor_id"], r["ix"]): r["slow"] for r in v.slow_map(parts, counts, ["sensor_id"], 0.05, "day").collect()}
    now = spark.createDataFrame([], "sensor_id string, ix int, iy int, iz int, slow double")
    for day in range(4):
        now = v.advanced_map(now, parts.where(F.col("day") == day).drop("day"), counts.where(F.col("day") == day).drop("day"), ["sensor_id"], 0.05)
    stepwise = {(r["sensor_id"], r["ix"]): r["slow"] for r in now.collect()}
    assert set(want) == set(at_once) == set(stepwise)
    assert all(abs(at_once[k] - x) < 1e-12 and abs(stepwise[k] - x) < 1e-12 for k, x in want.items())
