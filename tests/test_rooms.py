import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthwave.operators import clusters, geometry, moments, voxels
from hearthwave.sources import frames as wire

XYZ = "capture_id long, x double, y double, z double"


def _cloud(spark, rows, capture=1):
    return spark.createDataFrame([(capture, *map(float, r)) for r in rows], XYZ + (", power double" if len(rows[0]) > 3 else ""))


def test_voxels_bin_and_cap(spark):
    df = _cloud(spark, [(0.1 - 2, 0.1, 0.1), (0.15 - 2, 0.12, 0.1), (1.9, 5.9, 2.9), (99, 0, 0), (-2.1, 0.1, 0.1)])
    rows = {(r["ix"], r["iy"], r["iz"]): r for r in voxels.voxel_map(df, ["capture_id"]).collect()}
    assert rows[0, 0, 0]["hit_count"] == 3 and rows[0, 0, 0]["log_odds"] == 60 and rows[0, 0, 0]["intensity"] == 300  # just outside is cut into cell 0
    assert sum(r["hit_count"] for r in rows.values()) == 4
    many = spark.range(120).select(F.lit(1).cast("long").alias("capture_id"), *(F.lit(0.1).alias(c) for c in "xyz"))
    assert voxels.voxel_map(many, ["capture_id"]).first()["log_odds"] == 2000


def test_room_transforms_differ(spark):
    df = _cloud(spark, [(0, 2, 0), (float("nan"), 1, 1), (float("inf"), 1, 1)])
    down = geometry.to_room(df, 90.0, 2.0).collect()
    assert len(down) == 1 and down[0]["y"] == pytest.approx(0, abs=1e-9) and down[0]["z"] == pytest.approx(0, abs=1e-9)
    up = geometry.to_room_from_vertical(df.limit(1), 90.0, 2.0).first()
    assert up["y"] == pytest.approx(2) and up["z"] == pytest.approx(2)
    mounts = spark.createDataFrame([(1, 90.0, 2.0)], "sensor_id long, tilt_deg double, height double")
    assert geometry.to_room_by_sensor(df.limit(1).withColumn("sensor_id", F.lit(1).cast("long")), mounts).first()["z"] == pytest.approx(0, abs=1e-9)


def test_energy_sums_to_one_and_drops_outside(spark):
    e = voxels.energy_density(_cloud(spark, [(0, 1, 0.5, 2), (0.02, 1, 0.5, 3)]), ["capture_id"]).collect()
    assert len(e) == 1 and e[0]["e"] == pytest.approx(1)
    e = voxels.energy_density(_cloud(spark, [(0, 3, 0.5, 1), (100, 3, 0.5, 1), (0, 3, -1, 1)]), ["capture_id"], normalize=False).collect()
    assert sum(r["e"] for r in e) == pytest.approx(1)


def test_change_events(spark):
    rng = np.random.default_rng(1)
    back = [(x, y, 1.5, 1.0) for x, y in rng.uniform((-2.5, 1), (2.5, 6), (60, 2))]
    thing = [(1.0 + a, 3.5 + b, 0.8, 3.0) for a, b in rng.normal(0, 0.05, (40, 2))]
    person = [(-0.5 + a, 3.5 + b, 0.3, 3.0) for a, b in rng.normal(0, 0.05, (40, 2))]
    before, after = (voxels.energy_density(_cloud(spark, back + x), ["capture_id"]) for x in (thing, person))
    assert clusters.change_events(voxels.energy_change(before, before, ["capture_id"]), ["capture_id"]).count() == 0
    found = clusters.change_events(voxels.energy_change(before, after, ["capture_id"]), ["capture_id"], rel=0.3, least=1).collect()
    appeared = [r for r in found if r["kind"] == "appeared"]
    gone = [r for r in found if r["kind"] == "gone"]
    assert any(np.hypot(r["cx"] + 0.5, r["cy"] - 3.5) < 0.5 and r["fall_zone"] for r in appeared)
    assert any(np.hypot(r["cx"] - 1.0, r["cy"] - 3.5) < 0.5 for r in gone) and not any(r["fall_zone"] for r in gone)


def _dbscan(p, eps, least):
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.full(len(p), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        stack.append(j)
    for i in np.flatnonzero(~core):
        reach = label[near[i] & core]
        label[i] = reach.min() if len(reach) else -1
    ids = {v: n for n, v in enumerate(sorted(set(label) - {-1}))}
    return [ids.get(v, -1) for v in label]


def test_dbscan_and_boxes(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal((0, 1, 0.5), 0.08, (30, 3)), rng.normal((2.5, 3, 0.8), 0.08, (30, 3)), [(5, 5, 5), (-4, 0, 0)]])
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(p)], "capture_id long, node long, x double, y double, z double")
    found = clusters.dbscan(df, ["capture_id"], "node", 0.3, 5)
    got = {r["node"]: r["cluster_id"] for r in found.collect()}
    assert [got[i] for i in range(len(p))] == _dbscan(p, 0.3, 5)
    boxes = voxels.boxes(found, ["capture_id"], least=5).collect()
    assert len(boxes) == 2 and {r["n"] for r in boxes} <= {28, 29, 30}


def test_stable_cell_and_labels(spark):
    df = _cloud(spark, [(1.05, 2.05, 0.55)] * 20 + [(1, 2, -1)] * 5)
    rows = voxels.stable_voxels(df, ["capture_id"]).collect()
    assert len(rows) == 1 and rows[0]["n"] == 20
    cases = [(0.25, 0.5, "floor"), (1.95, 0.5, "wall/person"), (1.1, 1.0, "table"), (0.5, 0.3, "chair"), (0.6, 1.5, "bed/sofa"), (1.3, 0.9, "object")]
    df = spark.createDataFrame([(t, f) for t, f, _ in cases], "top double, foot double")
    assert [r[0] for r in df.select(geometry.box_label(F.col("top"), F.col("foot"))).collect()] == [c for _, _, c in cases]
    poses = [(1.0, 0.5, "LIE"), (0.5, 1.2, "STAND"), (0.5, 0.8, "STAND"), (0.8, 0.5, "LIE"), (0.7, 0.7, "SIT")]
    df = spark.createDataFrame([(a, b) for a, b, _ in poses], "l double, v double")
    assert [r[0] for r in df.select(geometry.pose(F.col("l"), F.col("v"))).collect()] == [c for _, _, c in poses]


def test_frame_clusters(spark):
    rows = [(1, f, k, k * 0.3 + (5 if k > 5 else 0), 0.0, 0.0) for f in range(2) for k in range(11)] + [(1, 0, 99, 50.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "capture_id long, frame long, k long, x double, y double, z double")
    got = {(r["frame"], r["k"]): r["cluster_id"] for r in clusters.frame_clusters(df, ["capture_id", "frame"]).collect()}
    assert got[0, 0] == got[0, 5] == 0 and got[0, 6] == got[0, 10] == 1 and got[0, 99] == -1 and got[1, 7] == 1


def test_planes(spark):
    rng = np.random.default_rng(5)
    floor = [(x, y, 0.0) for x, y in rng.uniform(0, 4, (200, 2))]
    wall = [(0.0, y, z) for y, z in rng.uniform(0.5, 4, (120, 2))]
    rows = {r["plane"]: r for r in clusters.planes(_cloud(spark, floor + wall), ["capture_id"], most=2, tries=60).collect()}
    assert abs(rows[0]["c"]) > 0.99 and rows[0]["inliers"] >= 200 and abs(rows[1]["a"]) > 0.99


def test_moments_against_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 16)) + 1j * rng.normal(size=(40, 16))
    df = spark.createDataFrame([(1, 9, i, [float(v) for v in r.real], [float(v) for v in r.imag]) for i, r in enumerate(x)], "capture_id long, range_bin long, snap long, re array<double>, im array<double>").repartition(5)
    keys = ["capture_id", "range_bin"]
    r = moments.bin_moments(df, keys).first()
    cov = x.T @ x.conj() / len(x)
    assert r["power"] == pytest.approx(np.trace(cov).real) and r["variance"] == pytest.approx((np.trace(cov) - (np.abs(x.mean(0)) ** 2).sum()).real)

    def matrix(d):
        out = np.zeros((16, 16), complex)
        for c in d.collect():
            out[c["i"], c["j"]] = c["re"] + 1j * c["im"]
        return out

    assert np.allclose(matrix(moments.covariances(df, keys)), cov)
    assert np.allclose(matrix(moments.covariances(df, keys, conjugate=True)), x.conj().T @ x / len(x))
    m = x.mean(0)
    assert np.allclose(matrix(moments.covariances(df, keys, fluctuation=True)), cov - np.outer(m, m.conj()))
    parts = np.array_split(x, 4)
    covs = [p.T @ p.conj() / len(p) for p in parts]
    want = np.mean([np.linalg.norm(covs[j] - covs[i]) / np.linalg.norm(covs[i]) for i in range(4) for j in range(i + 1, 4)])
    assert moments.motion_score(df, keys, "snap").first()["score"] == pytest.approx(want)
    assert moments.capped(df, keys, ["snap"], 5).count() == 5 and moments.capped(df, keys, ["snap"], 5, least=50).count() == 0


def _frame(parts, number=3, points=0):
    import struct

    body = b"".join(struct.pack("<2I", k, len(p)) + p for k, p in parts)
    return wire.MAGIC + struct.pack("<9I", 1, wire.HEADER + len(body), 0, number, 0, points, 0, len(parts), 0) + body


def test_decode_frames(spark):
    import struct

    pts = np.array([[1, 2, 0.5, 0.1], [-0.5, 3, 1.2, -0.3]], "<f4")
    track = struct.pack("<I9f", 7, 1, 2, 3, 4, 5, 6, 0, 0, 0) + bytes(112 - 40)
    pose = struct.pack("<HH", 1, 0) + struct.pack("<IBBBBhBB", 7, 2, 255, 1, 1, 30, 5, 1)
    vec = np.arange(32, dtype="<i2").tobytes()
    entry = struct.pack("<IHhf", 7, 150, -20, 3.5) + vec
    old, new = struct.pack("<2H", 1, 16) + entry, struct.pack("<3H", 1, 16, 9) + entry
    ra = struct.pack("<2H", 100, 2) + vec + vec
    cloud = struct.pack("<5f", 0.01, 0.01, 0.1, 0.01, 0.5) + np.array([(10, -20, 3, 250, 8)], wire.CLOUD).tobytes()
    blob = b"\x11garbage" + _frame([(1, pts.tobytes()), (308, track), (321, pose), (320, old), (8, ra), (3001, cloud), (99, b"zz")]) + _frame([(320, new)], 4) + wire.MAGIC + b"\x00" * 40
    df = wire.decode_blobs(spark.createDataFrame([("a", bytearray(blob)), ("b", bytearray(b"none"))], "path string, content binary"))
    rows = df.collect()
    by = {}
    for r in rows:
        by.setdefault(r["kind"], []).append(r)
    assert [r["frame"] for r in by["frame"]] == [3, 4] and len(by["point"]) == 2 and by["point"][1]["y"] == 3.0
    assert by["track"][0]["vz"] == 6.0 and by["pose"][0]["down"] and by["pose"][0]["falling_prob"] == 1.0
    assert len(by["cube"]) == 2 and all(r["re"] == [float(v) for v in range(1, 32, 2)] and r["range_bin"] == 150 for r in by["cube"])
    assert [r["range_bin"] for r in by["range_antenna"]] == [100, 101] and by["cloud"][0]["snr"] == 4.0
    assert len(by["dead"]) == 1
    r = 2.5
    assert by["cloud"][0]["x"] == pytest.approx(r * np.cos(0.1) * np.sin(-0.2), abs=1e-6)


def test_plane_scores_keep_numbers_in_arrays(spark, monkeypatch):
    """Blocks of points are not turned into Python objects, which takes many times their size."""
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda *a, **k: pytest.fail("rows of points as objects"))
    floor = [(x / 10, y / 10, 0.0) for x in range(20) for y in range(20)]
    (r,) = clusters.planes(_cloud(spark, floor + floor[:7]), ["capture_id"], most=1, tries=60, block=50).collect()
    assert abs(r["c"]) == pytest.approx(1.0) and r["inliers"] == 407


def test_single_frames_of_points_are_read_at_once(spark):
    """Written and read many at a time: what frame by frame gives, cut parts, empty and null blobs and broken ones too."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    sizes = [1, 3, 70_000 // 16, 1, 2]
    points = rng.normal(size=(sum(sizes), 4)).astype("<f4")
    first = np.cumsum([0, *sizes[:-1]])
    blobs = wire.point_blobs(np.arange(5) + 9, first, points).to_pylist()
    assert blobs == [_frame([(1, points[s : s + n].tobytes())], 9 + i, n) for i, (s, n) in enumerate(zip(first, sizes, strict=True))]
    cut = _frame([(1, points[:2].tobytes()[:-5])], 20, 2)
    blobs += [cut, _frame([(1, b"")], 21), b"", None, blobs[1][:-1], b"x" + blobs[0], blobs[0] + blobs[1], _frame([(8, b"")], 22)]
    paths = [None, *map(str, range(1, len(blobs)))]
    df = spark.createDataFrame(list(zip(paths, [None if b is None else bytearray(b) for b in blobs], strict=True)), "path string, content binary").coalesce(1)
    got = sorted(map(repr, wire.decode_blobs(df).collect()))
    single, read = wire.single_points(pa.array(paths), pa.array(blobs, pa.binary()))
    assert single.tolist() == [0, 1, 2, 3, 4, 5, 6] and sum(b.num_rows for b in read) == sum(sizes) + 7 + 1
    assert wire.single_points(pa.array([], pa.string()), pa.array([], pa.binary()))[0].tolist() == []
    slow = [wire._batch(k, [(p, f, c)]) for p, b in zip(paths, blobs, strict=True) for x in wire.split(b or b"") if len(x) == int.from_bytes(x[12:16], "little") for k, f, c in wire.parts_of(x)]
    want = sorted(repr(r) for r in spark.createDataFrame(pa.Table.from_batches(slow).to_pylist(), wire.SCHEMA).collect())
    assert [g for g in got if "kind='dead'" not in g] == want and sum("kind='dead'" in g for g in got) == 1
