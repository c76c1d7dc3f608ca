import pytest
from pyspark.sql import functions as F

from hearthwave.operators import baseline, falls, islands, joins
from hearthwave.sources import tables
from hearthwave.streaming import jobs, steps


def _heights(spark, values, keys=("s",)):
    rows = [(k, i, None if v is None else float(v)) for k in keys for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sensor_id string, frame long, h_s double")


def _latched(values, sustain=5, clear=5):
    out, low_n, other, down = [], 0, 0, False
    for v in values:
        low = v is not None and v <= 0.45
        low_n, other = (low_n + 1, 0) if low else (0, other + 1)
        down = True if low_n >= sustain else False if other >= clear else down
        out.append(down)
    return out


@pytest.mark.parametrize("values", [[0.2] * 4, [0.2] * 5, [0.2] * 5 + [1] * 4, [0.2] * 5 + [1] * 5, [0.2] * 5 + [None] * 5, [0.2, 1] * 8, [1] * 3 + [0.2] * 6 + [None, 0.3] + [1] * 6])
def test_latch_and_its_step_agree(spark, values):
    df = _heights(spark, values)
    got = [r["down"] for r in islands.latch(df, ["sensor_id"], ["frame"], F.col("h_s") <= 0.45).orderBy("frame").collect()]
    state = {}
    assert got == [steps.latch_step(state, {"h_s": v})["down"] for v in values] == _latched(values)


def test_runs_episodes_and_timers(spark):
    df = spark.createDataFrame([("s", t, f, ["a"] if t % 2 else ["b"]) for t, f in enumerate([1, 1, 0, 1, 1, 1, 0, 0, 1])], "sensor_id string, t long, f int, why array<string>")
    flag = F.col("f") == 1
    eps = sorted((r["first"], r["last"], r["n"], tuple(r["reasons"])) for r in islands.episodes(df, ["sensor_id"], "t", flag, "why").collect())
    assert eps == [(0, 1, 2, ("a", "b")), (3, 5, 3, ("a", "b")), (8, 8, 1, ("b",))]
    assert [r["run"] for r in islands.trigger_run(df, ["sensor_id"], ["t"], flag).orderBy("t").collect()] == [1, 2, 0, 1, 2, 3, 0, 0, 1]
    assert [r["fallen"] for r in islands.back_filled(df, ["sensor_id"], ["t"], flag, 3).orderBy("t").collect()] == [False] * 3 + [True] * 3 + [False] * 3
    held = {r["t"]: (r["episode"], r["held"]) for r in islands.sustained(df, ["sensor_id"], "t", flag, 2).collect()}
    assert held == {0: (1, 0), 1: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 5), 8: (2, 0)}
    voted = [r["voted"] for r in islands.vote(df, ["sensor_id"], ["t"], flag, 3, 0.6).orderBy("t").collect()]
    assert voted[:4] == [True, True, True, True] and voted[7] is False


def test_cell_trigger(spark):
    rows = [("s", t / 10, 2.1, z) for t in range(12) for z in (0.2, 0.3, 0.1)] + [("s", 5.0, 2.1, z) for z in (1.5, 1.6, 1.7)]
    df = spark.createDataFrame(rows, "sensor_id string, ts double, wy double, wz double")
    got = falls.cell_trigger(df, ["sensor_id"], "ts", least=3).collect()
    assert len(got) == 1 and got[0]["burst"] == pytest.approx(0.6) and got[0]["range_m"] == 2.25 and got[0]["last_low"] == pytest.approx(1.1)


def test_floor_map_and_windows(spark):
    pts = [("s", 0.1, 0.1, z / 10) for z in range(20)] + [("s", 5.0, 5.0, 1.0)]
    df = spark.createDataFrame(pts, "sensor_id string, x double, y double, z double")
    floor = falls.floor_map(df, ["sensor_id"])
    assert floor.count() == 1 and floor.first()["hg"] == pytest.approx(0.095)
    assert max(r["h"] for r in falls.above_floor(df, floor, ["sensor_id"]).collect()) == pytest.approx(1.9 - 0.095)
    frames = spark.createDataFrame([("s", f, float(f), 2.0 * f) for f in range(20) if f != 9], "sensor_id string, frame long, a double, b double")
    got = {r["frame"]: r["vector"] for r in falls.frame_windows(frames, ["sensor_id"], "frame", ["a", "b"]).collect()}
    assert set(got) == {7, 8, 17, 18, 19} and got[7] == [float(i) for i in range(8)] + [2.0 * i for i in range(8)]
    flat = {r["frame"]: r["vector"] for r in falls.frame_windows(frames, ["sensor_id"], "frame", ["a", "b"], feature_major=False).collect()}
    assert flat[7][:4] == [0.0, 0.0, 1.0, 2.0]


def test_cleaner_rules(spark):
    names = "w_down boolean, falling_p double, cube boolean, cube_rr double, cube_micro boolean, cube_floor_frac double, rest_spot boolean, extra boolean, floor_fall boolean, lying_state boolean, cloud_below double, cloud_z_med double, flat double, h_s double, track_floor double"
    base = [True, 0.0, False, None, False, 0.0, False, False, False, False, 0.0, None, 0.0, None, 0.0]

    def row(n, **changes):
        cols = [c.split()[0] for c in names.split(", ")]
        return ("s", n, *(changes.get(c, v) for c, v in zip(cols, base, strict=True)))

    rows = [row(0), row(1, cube=True, cube_floor_frac=0.9, cube_rr=12.0), row(2, cube=True, cube_floor_frac=0.9), row(3, cube=True, cube_floor_frac=0.3), row(4, extra=True, floor_fall=True, lying_state=True, flat=0.6), row(5, w_down=False, falling_p=0.6), row(6, w_down=False)]
    df = spark.createDataFrame(rows, "sensor_id string, frame long, " + names)
    got = {r["frame"]: r for r in falls.cleaned(df, ["sensor_id"], "frame", persist=2).collect()}
    assert not got[0]["fall"] and got[0]["suspected"] and got[0]["confidence"] == 0.5
    assert got[1]["fall"] and not got[1]["collapse"] and got[1]["confidence"] == 0.9
    assert got[2]["collapse"] and not got[3]["fall"] and not got[3]["suspected"] and got[3]["confidence"] == 0.0
    assert got[4]["fall"] and got[4]["confidence"] == 0.98
    assert got[5]["suspected"] and not got[6]["suspected"] and got[6]["run"] == 0


def test_floor_tracker_cases():
    def run(frames, **o):
        state, out = {}, None
        for t, tracks, clusters, rr in frames:
            out = steps.floor_step(state, {"t": t, "tracks": [(k, *v) for k, v in tracks.items()], "clusters": clusters, "rr": [rr] * len(clusters)}, **o)
        return out

    a = run([(0, {5: (0, 3)}, [(0.05, 3, 30)], False), (0.1, {5: (0, 3)}, [(0, 3, 28)], False)])
    assert (a[0]["id"], a[0]["source"], a[0]["seen"]) == (5, "gtrack", 2)
    b = run([(0, {2: (0, 4)}, [(0, 4, 40)], False), (0.1, {}, [(0.05, 4, 35)], False)])
    assert (b[0]["id"], b[0]["source"], b[0]["person"]) == (2, "inherited", True)
    assert run([(0, {2: (0, 4)}, [], False), (0.1, {}, [], False)]) == []
    c = run([(0, {}, [(2, 2, 20)], False)])
    assert c[0]["id"] < 0 and not c[0]["person"]
    d = run([(0, {}, [(2, 2, 20)], True)])
    assert d[0]["person"] and d[0]["source"] == "floor"
    e = run([(0, {2: (0, 4)}, [], False), (0.1, {}, [], False), (2.2, {}, [(0, 4, 30)], False)], death_s=1.0)
    assert e[0]["id"] < 0 and not e[0]["person"]
    f = run([(0, {2: (0, 4)}, [], False), (0.1, {}, [(0.1, 4, 30)], False)])
    assert f[0]["id"] == 2 and f[0]["source"] == "inherited"


def _episode(frames, **o):
    state, out = {}, []
    base = {"down": False, "x": 0.0, "y": 3.0, "bin": 100, "upright": [], "stands": False, "cloud_z": 0.2, "cleaned": False, "track": None, "answer": None}
    for t, changes in frames:
        out.append(steps.episode_step(state, base | {"t": float(t)} | changes, **o))
    return out


def test_episode_machine():
    down = [(t, {"down": True}) for t in range(40)]
    out = _episode(down)
    assert out[5]["phase"] == "anchored" and out[6]["phase"] == "open" and [o["t"] for o in out if o["ask"]] == [24.0]
    yes = _episode([*down[:26], (26, {"down": True, "answer": (1, 104, True)}), (27, {})])
    assert yes[-1]["red"] and yes[-2]["event"] and yes[-1]["events"] == 1
    far = _episode([*down[:26], (26, {"answer": (1, 150, True)}), (27, {"answer": (2, 100, True)})])
    assert not far[-1]["red"]
    no = _episode([*down[:26], (26, {"answer": (1, 100, False)}), (27, {"answer": (1, 100, None)}), (28, {"answer": (1, 100, False)})])
    assert no[-2]["phase"] == "open" and no[-1]["phase"] == "idle"
    up = _episode([(0, {"down": True}), (1, {"upright": [(0.1, 3.0)]}), (2, {"upright": [(0.1, 3.0)]})])
    assert up[-1]["phase"] == "idle"
    rises = _episode([*down[:10], *[(10 + t, {"cloud_z": 0.9}) for t in range(3)]])
    assert rises[-1]["phase"] == "idle"
    leaves = _episode([*down[:10], *[(10 + t / 2, {"track": (t * 0.25, 3.0)}) for t in range(9)]])
    assert leaves[-1]["phase"] == "idle"
    jumps = _episode([*down[:10], (10, {"track": (0.0, 3.0)}), (10.1, {"track": (3.0, 3.0)})])
    assert jumps[-1]["phase"] == "open"
    held = _episode([(0, {"cleaned": True}), (29, {}), (31, {})])
    assert [o["red"] for o in held] == [True, True, False] and held[0]["event"]
    stands = _episode([*down[:24], (24, {"stands": True})])
    assert stands[-1]["phase"] == "idle"


def test_map_step_is_the_closed_form():
    state, out = {}, None
    for e in (1.0, 2.0, 3.0):
        out = steps.map_step(state, {"cells": {"a": e}}, alpha=0.1, window=2)
    slow = 0.1 * (0.81 * 1 + 0.9 * 2 + 3)
    assert out["diff"]["a"] == pytest.approx(2.5 - slow)


def test_stream_equals_batch(spark, tmp_path):
    values = [0.2] * 6 + [1.0] * 3 + [0.3] * 7 + [None] * 6
    df = _heights(spark, values, ("a", "b"))
    schema = "sensor_id string, frame long, down boolean"
    want = sorted(map(tuple, jobs.in_batch(df, ["sensor_id"], ["frame"], steps.latch_step, schema).collect()))
    for i, (lo, hi) in enumerate(((0, 7), (7, 15), (15, 99))):
        df.where(F.col("frame").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = jobs.in_stream(source, ["sensor_id"], ["frame"], steps.latch_step, schema)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("sensor_id", "frame", "down").collect())) == want


def test_blocks_and_answers(spark):
    df = spark.createDataFrame([("s", i * 60) for i in range(11)], "sensor_id string, e long").withColumn("ts", F.timestamp_seconds("e"))
    got = jobs.blocks(df, ["sensor_id"], "ts", [F.count("*").alias("n")]).orderBy("start").collect()
    assert [r["n"] for r in got] == [5, 5, 1]
    req = spark.createDataFrame([("s", 1, 100, 50)], "sensor_id string, epoch long, e long, range_bin int").withColumn("ts", F.timestamp_seconds("e"))
    ans = spark.createDataFrame([("s", 1, 105, 55, True), ("s", 1, 120, 50, True), ("s", 2, 105, 50, True), ("s", 1, 106, 70, True)], "sensor_id string, epoch long, e long, a_bin int, verdict boolean").withColumn("a_ts", F.timestamp_seconds("e"))
    assert jobs.answered(req, ans).count() == 1


def test_hour_stats_cases(spark):
    def sweep(day, hour, minute, power, usable=True):
        return ("s", f"2024-01-{day:02d} {hour:02d}:{minute:02d}:00", 1, power, usable)

    rows = [sweep(d, 5, m, 10.0 * d) for d in (1, 2, 3) for m in (0, 10)] + [sweep(d, 6, 0, 5.0) for d in (1, 2)] + [sweep(4, 5, 0, 1e9, False), sweep(4, 5, 1, None)]
    df = spark.createDataFrame(rows, "sensor_id string, t string, range_bin long, power double, usable boolean").withColumn("ts", F.to_timestamp("t"))
    got = baseline.hour_stats(df).collect()
    assert len(got) == 1 and got[0]["hour"] == 5 and got[0]["days"] == 3 and got[0]["level"] == pytest.approx(20)
    cover = {r["hour"]: r["n"] for r in baseline.coverage(df).collect()}
    assert cover[5] == 6 and cover[0] == 0 and len(cover) == 24


def test_change_points(spark):
    levels = [100, 105, 100, 103, 30, 31, 30, 31]
    rows = [("s", f"2024-01-{d + 1:02d} 01:00:00", b, float(v) if b == 1 else 50.0, True) for d, v in enumerate(levels) for b in (1, 2)]
    df = spark.createDataFrame(rows, "sensor_id string, t string, range_bin long, power double, usable boolean").withColumn("ts", F.to_timestamp("t"))
    got = baseline.furniture_events(df).collect()
    assert [(r["range_bin"], str(r["day"])) for r in got] == [(1, "2024-01-05")] and got[0]["jump_x"] == pytest.approx(30 / 103)


def test_band_at_the_end_of_the_range(spark):
    def bands(bins):
        df = spark.createDataFrame([("s", b, 2000.0 if b in bins else 1.0, 1.0) for b in range(128)], "sensor_id string, range_bin int, var double, cal double")
        return [(r["bin_start"], r["bin_end"], r["tier"]) for r in baseline.presence_bands(df, ["sensor_id"]).collect()]

    assert bands({72, 73, 74}) == [(72, 75, "strong")] and bands({74}) == [] and bands({10, 11, 90}) == [(10, 12, "strong")]


def test_watch_joins(spark):
    watch = spark.createDataFrame([("p", 0.0, 60.0), ("p", 10.0, 70.0), ("p", 100.0, 90.0)], "person_id string, ts double, bpm double")
    win = spark.createDataFrame([("p", t) for t in (-5.0, 5.0, 40.0, 55.0, 200.0)], "person_id string, at double")
    pairs = joins.nearest(joins.interpolated(joins.as_of(win, watch, ["person_id"], "at", "ts", "bpm"), "at"), "at", 8.0)
    got = {r["at"]: (r["interp"], r["nearest"]) for r in pairs.collect()}
    assert got[-5.0] == (60.0, 60.0) and got[5.0] == (65.0, 60.0) and got[55.0] == (80.0, None) and got[200.0] == (90.0, None)
    ref = {r["at"]: r["ref"] for r in joins.watch_reference(win, watch, ["person_id"], "at", 15.0).collect()}
    assert ref[5.0] == 65.0 and ref[55.0] == 80.0 and ref[-5.0] == 65.0


def test_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Start Time,Heart Rate\n1700000000000,61\n2024-01-01 00:00:00,70\nbad,1\n")
    rows = sorted((r["ts"], r["bpm"]) for r in tables.read_watch_csv(spark, str(tmp_path / "w.csv")).collect())
    assert rows == [(1700000000.0, 61.0), (1704067200.0, 70.0)]
    (tmp_path / "h.xml").write_text('<HealthData><Record type="HKQuantityTypeIdentifierHeartRate" startDate="2024-01-01 00:00:00 +0000" value="72"/><Record type="Steps" startDate="2024-01-01 00:00:00 +0000" value="9"/></HealthData>')
    assert [tuple(r) for r in tables.read_health_xml(spark, str(tmp_path / "h.xml")).collect()] == [(1704067200.0, 72.0)]
    (tmp_path / "l.jsonl").write_text('{"label": "lie", "entries": 3}\n{"label": "x", "entries": 0}\n{"label": "y"}\n')
    assert [r["label"] for r in tables.read_labels(spark, str(tmp_path / "l.jsonl")).collect()] == ["lie"]
    wide = spark.createDataFrame([("f", 1, 1.0, 2.0, 3.0, 4.0, None, None, None)], "file string, row long, pointy0 double, pointz0 double, snr0 double, pointy1 double, pointz1 double, snr1 double, z double")
    assert [(r["p"], r["x"], r["y"]) for r in tables.posture_points(wide.drop("z"), 0, ["file", "row"]).collect()] == [(0, None, 1.0)]


def test_labels(spark):
    rows = [("Empty room", "empty"), ("half-kneel on side", "boundary"), ("侧倒", "collapse"), ("lie flat", "lie"), ("sits", "upright"), ("?", "unknown")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r[0] == r[1] for r in df.select(falls.label_class(F.col("t")), "want").collect())


def test_ties_of_blackouts_follow_their_order(spark):
    """Frames of one second: their runs are those of the second column, however the rows come."""
    rows = [(1, 5, i, i in (0, 1, 2, 6)) for i in range(8)] + [(1, 6, 8, True)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "user_id int, t long, event_id long, low boolean")
        got = falls.blackouts(df, ["user_id"], "t", F.lit(0), F.col("low"), least=1, ties=["event_id"]).collect()
        assert sorted((r["first"], r["last"], r["n"]) for r in got) == [(5, 5, 1), (5, 5, 3), (6, 6, 1)]


def test_ties_of_descent_take_the_first(spark):
    """Of two heights of one moment the one that comes first counts, upright and on the floor; null heights never do."""
    rows = [(1, 3, 0, 1.4), (1, 3, 1, 1.9), (1, 7, 2, None), (1, 7, 3, 0.5), (1, 7, 4, 0.1)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "user_id int, t long, event_id long, h double").coalesce(1)
        (r,) = falls.descent(df, ["user_id"], "t", "h", tie="event_id").collect()
        assert (r["h_up"], r["h_floor"], r["seconds"], r["rate"]) == (1.4, 0.5, 4, pytest.approx(0.225))
