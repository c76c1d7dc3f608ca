"""Window states, respiration, sinks and ordered steps, against plain versions and planted cases."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthwave.helpers import signal as s
from hearthwave.operators import baseline, clusters, falls, features, mldata, moments, scene, voxels
from hearthwave.sources import tables
from hearthwave.streaming import jobs, steps

FPS = 20.0


def _person(spark, seconds=30, breath_hz=0.25, beat_hz=1.2, hold=None):
    """Snapshots of one person: bins 100 to 111, breathing strongest at 104, the beat at 108; ``hold``: no breath from then on."""
    e = np.random.default_rng(1)
    t = np.arange(int(seconds * FPS)) / FPS
    breath = np.where(t < hold if hold else True, np.sin(2 * np.pi * breath_hz * t), 0.0)
    rows = []
    for b in range(100, 112):
        mm = 0.3 * np.exp(-(((b - 104) / 1.5) ** 2)) * breath + 0.02 * np.exp(-(((b - 108) / 1.5) ** 2)) * np.sin(2 * np.pi * beat_hz * t)
        wave = np.exp(-1j * 4 * np.pi / s.WAVELENGTH_MM * mm)[:, None] * np.exp(1j * np.arange(16) * 0.3) * 10 + e.normal(scale=0.002, size=(len(t), 16))
        rows += [("a", float(t[i]), b, wave[i].real.tolist(), wave[i].imag.tolist()) for i in range(len(t))]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["capture_id", "ts", "range_bin", "re", "im"]))


def test_window_states_of_a_breathing_person(spark):
    r = features.window_states(_person(spark), ["capture_id"], 30.0, 30.0).collect()[0]
    assert r["present"] and abs(r["rr"] - 15) < 1.01 and r["abdomen"] == 104 and r["breathing"] == "normal"
    assert abs(r["chest"] - 108) <= 2 and abs(r["hr"] - 72) < 4 and r["trust"] in ("ok", "harmonic")
    assert 5 <= len(r["marks"]) <= 8 and abs(r["interval_s"] - 4) < 0.3 and r["quality"] > 0.5
    assert r["pose"] in ("fall", "stand", "sit") and 2.3 < r["target_m"] < 2.7
    still = _person(spark).withColumns({"re": F.array_repeat(F.lit(1.0), 16), "im": F.array_repeat(F.lit(0.0), 16)})
    r = features.window_states(still, ["capture_id"], 30.0, 30.0).collect()[0]
    assert not r["present"] and r["rr"] is None and r["hr"] is None and r["pose"] == "unknown" and r["trust"] == "none"


def test_respiration_tells_a_held_breath(spark):
    tracks, per = features.respiration(_person(spark, 60, hold=40), ["capture_id"], 60.0, 60.0)
    r = per.collect()[0]
    assert r["present"] and r["pattern"] == "APNEA" and r["apneas"] == 1 and r["absences"] == 0
    rows = tracks.orderBy("t").collect()
    assert rows[5]["amp"] > 20 * rows[-3]["amp"] and abs(rows[5]["rate"] - 15) < 2
    assert features.respiration(_person(spark, 60), ["capture_id"], 60.0, 60.0)[1].collect()[0]["pattern"] == "REGULAR"


def test_prominent_peaks_against_a_plain_version():
    e = np.random.default_rng(2)
    for _ in range(30):
        x = np.convolve(e.normal(size=120), np.ones(4) / 4, "same")
        want = []
        for i in s.peaks(x, -np.inf, 5).tolist():
            left = right = i
            while left > 0 and x[left - 1] <= x[i]:
                left -= 1
            while right < len(x) - 1 and x[right + 1] <= x[i]:
                right += 1
            if x[i] - max(x[left : i + 1].min(), x[i : right + 1].min()) >= 0.4:
                want.append(i)
        assert s.prominent(x, 0.4, 5).tolist() == want


def test_chest_rates_and_beats():
    t = np.arange(600) / FPS
    x = np.stack([0.3 * np.sin(2 * np.pi * 0.25 * t) * w + 0.02 * np.sin(2 * np.pi * 1.3 * t) * h for w, h in ((1, 0.1), (0.6, 0.2), (0.1, 0.6), (0.02, 1.0))])
    found = s.chest_cluster(x, np.array([10, 11, 14, 15]), FPS, 0.25)
    assert found["abdomen"] == 10 and found["chest"] == 15 and abs(found["hr"] - 78) < 3
    assert abs(s.beat_count(np.sin(2 * np.pi * 1.3 * t), FPS) - 78) <= 2
    assert s.chest_rate(x[:1], np.array([10]), FPS) == {"hr": None, "decoupled": False, "abdomen": 10}


def test_moving_posture_tells_the_floor(spark):
    low = spark.createDataFrame([("a", 0.1, 2.0, 0.1, 5.0, 2.2), ("a", 0.2, 2.0, 0.2, 5.0, 2.4), ("a", 0.0, 2.0, 1.0, 1.0, 2.0)], "capture_id string, x double, y double, z double, power double, range_m double")
    r = features.motion_pose(low, ["capture_id"]).collect()[0]
    assert r["pose"] == "fall" and abs(r["tx"] - 1.5 / 11) < 1e-9 and abs(r["target_m"] - 25 / 11) < 1e-9
    assert features.motion_pose(low.withColumn("z", F.col("z") + 3), ["capture_id"]).collect()[0]["pose"] == "stand"
    assert features.motion_pose(low.withColumn("z", F.col("z") + 1), ["capture_id"]).collect()[0]["pose"] == "sit"


def test_objects_over_the_learned_floor(spark):
    beams = spark.createDataFrame([("a", b, float(az), 100.0 if (b, az) in ((120, 10), (120, 20), (130, -20)) else 1.0) for b in (110, 120, 130) for az in range(-30, 31, 10)], "capture_id string, range_bin int, az double, power double")
    line = spark.createDataFrame([("a", 0.0, 0.0)], "capture_id string, slope double, intercept double")
    rows = sorted((r["range_bin"], r["az"], round(r["excess"], 6), r["energy"]) for r in scene.over_floor(beams, line, ["capture_id"]).collect())
    assert rows == [(120, 10.0, 20.0, 200.0), (130, -20.0, 20.0, 100.0)]


def test_hourly_sweeps_mask_the_occupied(spark):
    entries = spark.createDataFrame([("s", 3600.0 * h + i, b, [1.0, 2.0], [0.0, 1.0]) for h in (0, 1) for i in (1, 2) for b in (10, 100)], "sensor_id string, ts double, range_bin int, re array<double>, im array<double>")
    spots = spark.createDataFrame([("s", 3700.0, 2.3)], "sensor_id string, ts double, range_m double")
    rows = {(r["hour"], r["range_bin"]): (r["power"], r["usable"]) for r in baseline.hourly_sweeps(entries, spots, ["sensor_id"], "ts").collect()}
    assert rows == {(0, 10): (6.0, True), (0, 100): (6.0, True), (1, 10): (6.0, True), (1, 100): (6.0, False)}


def test_planes_of_repeated_points(spark):
    """A floor, a wall with fewer points, and one point a thousand times; copies count but don't decide the draws."""
    e = random.Random(3)
    rows = [("a", e.uniform(-3, 3), e.uniform(0, 6), 0.0) for _ in range(400)] + [("a", e.uniform(-3, 3), 5.0, e.uniform(0.2, 2.5)) for _ in range(150)] + [("a", 1.0, 2.0, 1.5)] * 1000 + [("a", e.uniform(-3, 3), e.uniform(0, 4.8), e.uniform(0.2, 2.5)) for _ in range(200)]
    found = {r["plane"]: r for r in clusters.planes(spark.createDataFrame(rows, "capture_id string, x double, y double, z double").where("not (x = 1.0 and y = 2.0)"), ["capture_id"], most=2, tries=400).collect()}
    assert abs(found[0]["c"]) > 0.99 and found[0]["inliers"] >= 400 and abs(found[1]["b"]) > 0.99 and found[1]["inliers"] >= 150
    with_copies = clusters.planes(spark.createDataFrame(rows, "capture_id string, x double, y double, z double"), ["capture_id"], most=1, tries=400).collect()
    assert with_copies[0]["inliers"] >= 1000


def test_union_heights_and_trends(spark):
    a = spark.createDataFrame([(1, 0.1), (1, 0.9)], "capture_id int, z double")
    both = voxels.scans_together({"old": a, "new": a.withColumn("power", F.lit(2.0))})
    assert both.count() == 4 and {(r["scan"], r["power"]) for r in both.collect()} == {("old", None), ("new", 2.0)}
    r = voxels.cloud_heights(a, ["capture_id"]).collect()[0]
    assert (r["n"], r["z_med"], r["below"]) == (2, 0.5, 0.5)
    rows = spark.createDataFrame([(k, float(i), -float(i) if k else float(i * 7 % 5)) for k in (0, 1) for i in range(20)], "k int, x double, y double")
    p = {r["k"]: r["p"] for r in moments.trend_chance(rows, ["k"], "x", "y", 40).collect()}
    for k in (0, 1):
        y = [-float(i) if k else float(i * 7 % 5) for i in range(20)]

        def slope(v):
            return statistics.median((v[j] - v[i]) / (j - i) for i in range(20) for j in range(i + 1, 20))

        family = [y[-r:] + y[:-r] if r else y for r in range(20)] + [(y[-r:] + y[:-r] if r else y)[::-1] for r in range(20)]
        assert p[k] == sum(slope(v) <= slope(y) for v in family) / 40
    w = features.ridge_smoothness(rows, ["k"], "x", "y").collect()
    assert {r["k"]: round(r["rough"], 3) for r in w}[1] == 0 and {r["k"]: r["rough"] for r in w}[0] > 3


@pytest.fixture
def evidence(spark):
    e = random.Random(5)

    def some(*values):
        return e.choice(values)

    rows = [
        (i % 3, i, some(True, False, None), some(None, 0.2, 0.5, 0.9), some(True, False), some(None, 0.0, 12.0), some(True, False, None), some(None, 0.5, 0.7, 0.9), some(True, False, False), some(True, False), *(some(True, False, None) for _ in range(2)), *(some(None, 0.3, 0.5, 0.8) for _ in range(5)))
        for i in range(600)
    ]
    names = "w_down boolean, falling_p double, cube boolean, cube_rr double, cube_micro boolean, cube_floor_frac double, rest_spot boolean, extra boolean, floor_fall boolean, lying_state boolean, cloud_below double, cloud_z_med double, flat double, h_s double, track_floor double"
    return spark.createDataFrame(rows, f"sensor_id int, frame long, {names}")


@pytest.mark.parametrize("options", [{"persist": 2}, {"persist": 3, "require_cube": True}])
def test_cleaner_in_batch_and_by_steps(spark, evidence, options):
    kinds = "sensor_id int, frame long, run int, fall boolean, collapse boolean, suspected boolean, confidence double"
    names = [c.split()[0] for c in kinds.split(", ")]
    windowed = sorted(map(tuple, falls.cleaned(evidence, ["sensor_id"], "frame", **options).select(*names).collect()))
    stepped = sorted(map(tuple, jobs.in_batch(evidence, ["sensor_id"], ["frame"], lambda st, r: steps.clean_step(st, r, **options), kinds).collect()))
    assert windowed == stepped and any(r[3] for r in windowed) and any(r[4] for r in windowed)


def test_collapse_in_stream_batch_and_window(spark, tmp_path):
    rows = [("a", float(t), t >= 2, float(max(0, t - 2)), t >= 2, t >= 3, t == 30, t in (31, 60), t >= 16) for t in range(0, 40)] + [("a", 60.0, True, 20.0, True, True, False, False, False), ("b", 1.0, True, 20.0, True, True, False, False, False)]
    df = spark.createDataFrame(rows, "sensor_id string, t double, down boolean, down_s double, red boolean, fallen boolean, rr boolean, micro boolean, measured boolean")
    kinds = "sensor_id string, t double, had_rr boolean, living boolean, measured_yet boolean, suspect boolean, confidence string"
    names = [c.split()[0] for c in kinds.split(", ")]
    windowed = sorted(map(tuple, falls.collapse(df, ["sensor_id"], "t").select(*names).collect()))
    assert windowed == sorted(map(tuple, jobs.in_batch(df, ["sensor_id"], ["t"], steps.collapse_step, kinds).collect()))
    told = {(r[0], r[1]): r[5:] for r in windowed}
    assert told["a", 13.0] == (False, None) and told["a", 14.0] == (True, "weak") and told["a", 16.0] == (True, "strong")
    assert told["a", 30.0] == (False, None) and told["a", 60.0] == (True, "weak") and told["b", 1.0] == (True, "weak")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.in_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), ["sensor_id"], ["t"], steps.collapse_step, kinds)
    run = stream.writeStream.format("memory").queryName("collapse").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("collapse").select(*names).collect())) == windowed


def test_sinks_read_back(spark, tmp_path):
    rec = spark.createDataFrame([("s1", 1, 1.5), ("s2", 2, 2.5)], "sensor_id string, frame int, x double").withColumn("ts", F.timestamp_seconds(F.lit(86400) * F.col("frame")))
    tables.write_recordings(rec, f"{tmp_path}/rec")
    tables.write_recordings(rec, f"{tmp_path}/rec")
    back = spark.read.parquet(f"{tmp_path}/rec")
    assert back.count() == 4 and back.where("sensor_id = 's1' and day = '1970-01-02'").count() == 2
    rates = spark.createDataFrame([("10:00:00", 1.0, None), ("10:00:02", None, 61.5)], "local_time string, t_rel_s double, hr double")
    tables.write_csv(rates, f"{tmp_path}/csv")
    assert sorted(map(tuple, spark.read.option("header", True).schema(rates.schema).csv(f"{tmp_path}/csv").collect())) == sorted(map(tuple, rates.collect()))
    walls = spark.createDataFrame([("s1", 4.2)], "sensor_id string, wall_m double")
    objects = spark.createDataFrame([("s1", 1.0, 2.0), ("s1", 0.5, 1.0)], "sensor_id string, x double, y double")
    corners = spark.createDataFrame([("s1", 0.0)], "sensor_id string, x double")
    tables.write_scene(scene.scene_model(walls, objects, corners, ["sensor_id"]), f"{tmp_path}/scene")
    model = spark.read.json(f"{tmp_path}/scene").collect()[0]
    assert model["wall_m"] == 4.2 and [o["x"] for o in model["objects"]] == [0.5, 1.0]
    pts = spark.createDataFrame([("s1", 1.0, 2.0, 3.0, 4.0), ("s1", 0.0, 2.0, 3.0, 4.0), ("s2", 5.0, 5.0, 5.0, 5.0)], "sensor_id string, x double, y double, z double, mag double")
    tables.write_ply(pts, "sensor_id", f"{tmp_path}/ply")
    text = next((tmp_path / "ply" / "sensor_id=s1").glob("*.txt")).read_text().splitlines()
    assert text[0] == "ply" and text[2] == "element vertex 2" and text[7] == "end_header" and text[8:] == ["0.0000 2.0000 3.0000 4.0000", "1.0000 2.0000 3.0000 4.0000"]
    cells = spark.createDataFrame([("s1", 100, i, j, 1.0, 0.0) for i in (0, 1) for j in (0, 1)], "sensor_id string, range_bin int, i int, j int, re double, im double")
    beams = spark.createDataFrame([("s1", 100, 0.0, 2.0)], "sensor_id string, range_bin int, az double, power double")
    tables.write_occlusion_baseline(*scene.baseline_tables(cells, beams, ["sensor_id"]), f"{tmp_path}/base")
    assert spark.read.parquet(f"{tmp_path}/base/power").collect()[0]["power"] == 2.0 and spark.read.parquet(f"{tmp_path}/base/grid").count() == 1


def test_compared_feature_sets(spark):
    e = random.Random(6)
    rows = [(i % 3, e.gauss(y, 0.5), e.random(), y) for i in range(300) for y in [i // 3 % 2]]
    df = spark.createDataFrame(rows, "recording int, good double, noise double, label int")
    auc = {}
    for r in mldata.compared(df, {"good": ["good"], "noise": ["noise"]}, "recording").collect():
        auc.setdefault(r["name"], []).append(r["auc"])
    assert min(auc["good"]) > 0.85 > 0.7 > max(auc["noise"])
