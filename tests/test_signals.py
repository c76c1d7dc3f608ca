import numpy as np
import pytest

from hearthwave.helpers import angles, signal
from hearthwave.operators import directions, evaluation, mldata, vitals

FPS = 18.78


def _chest(bpm, breath=15.0, seconds=40, bins=12, amplitude=0.35, breath_mm=0.5, noise=0.002, seed=0):
    t = np.arange(int(seconds * FPS)) / FPS
    e = np.random.default_rng(seed)
    x = breath_mm * np.sin(2 * np.pi * breath / 60 * t) + amplitude * np.sin(2 * np.pi * bpm / 60 * t)
    return np.outer(1 + 0.1 * np.arange(bins), x) + noise * e.normal(size=(bins, len(t)))


def test_rates_of_known_sinusoids():
    x = _chest(78, breath=16.0)
    rr, _ = signal.breathing_rate(x, FPS, refine=True)
    assert rr == pytest.approx(16, abs=0.5)
    got = signal.heart_rate(x, FPS, rr / 60)
    assert got["hr"] == pytest.approx(78, abs=4) and got["band"] == "LOW"
    for bpm in (108, 120):  # a faster beat has two periods within the lags that are searched
        fast = signal.heart_rate(_chest(bpm, breath=16.0), FPS, 16 / 60, fast_hi=2.5)
        assert fast["band"] == "HIGH" and fast["hr"] == pytest.approx(bpm, abs=4)


def test_presence_and_noise():
    assert signal.presence(_chest(70), FPS)["present"]
    assert not signal.presence(np.zeros((5, 400)), FPS)["present"]
    assert not signal.presence(1e-4 * np.random.default_rng(0).normal(size=(5, 400)), FPS)["present"]
    one = np.vstack([_chest(70, bins=1), 1e-3 * np.random.default_rng(1).normal(size=(30, int(40 * FPS)))])
    assert signal.living(one, np.arange(31), 0.0234375, FPS, k=1)["present"]


def test_displacement_of_a_moving_phase():
    t = np.arange(600) / FPS
    d = 0.8 * np.sin(2 * np.pi * 0.25 * t)
    z = np.exp(-1j * 4 * np.pi * d / signal.WAVELENGTH_MM)[None, :, None] * np.exp(1j * np.arange(16))[None, None, :]
    got = signal.displacement(z)[0]
    assert np.allclose(got - got.mean(), d - d.mean(), atol=1e-6)


def test_band_and_comb():
    t = np.arange(1000) / 20
    x = np.sin(2 * np.pi * 0.3 * t) + np.sin(2 * np.pi * 1.2 * t) + np.sin(2 * np.pi * 1.33 * t)
    kept = signal.band(x, 20, 1.0, 1.7, comb=0.3)
    f, s = signal.spectrum(kept, 20)
    assert s[np.argmin(abs(f - 1.2))] < 1e-6 * s[np.argmin(abs(f - 1.34))]
    assert signal.quality(x[None], 20, 1.0, 1.7)[0] == pytest.approx(2, rel=0.1)


def test_tracks_and_cycles():
    t = np.arange(int(60 * FPS)) / FPS
    x = np.where((t > 25) & (t < 40), 0, np.sin(2 * np.pi * 0.25 * t))
    amp = dict((round(a), b) for a, b in signal.amplitude_track(x, FPS))
    assert amp[32] < 0.01 < amp[10]
    times = signal.breath_times(np.sin(2 * np.pi * 0.25 * t), FPS, 0.25)
    assert np.diff(times)[2:-2] == pytest.approx(np.full(len(times) - 5, 4.0), abs=0.1)
    assert all(r == pytest.approx(15, abs=3) for _, r in signal.rate_track(np.sin(2 * np.pi * 0.25 * t), FPS))
    slow = np.sin(2 * np.pi * 0.25 * t)
    assert signal.without_breath(slow, slow).std() < 0.3 * slow.std()


def test_smoothing_gates_and_anchors():
    out = signal.smoothed([70, 71, 140, 70, None, 69])
    assert out[2] == out[1] and abs(out[-1] - 70) < 2
    again = signal.smoothed([70, 70, *[100] * 6])
    assert again[-1] == pytest.approx(100)
    assert signal.smoothed([None, None]) == [None, None]
    x = np.arange(20.0)
    assert 0 < signal.rotation_p(x, 0.5 * x) <= 1 and signal.rotation_p(x, np.random.default_rng(2).normal(size=20)) > 0.01


def test_directions_of_known_sources():
    az, el = angles.scan(-45, 45), angles.scan(-30, 30)
    grid = angles.steering(az, el)
    a = grid[az.index(20.0), el.index(-10.0)]
    e = np.random.default_rng(0)
    x = e.normal(size=(100, 1)) * a + 0.05 * (e.normal(size=(100, 16)) + 1j * e.normal(size=(100, 16)))
    r = x.T @ x.conj() / 100
    for power in (angles.beam(r[None], grid)[0], angles.subspace(r, grid, 1)):
        best = angles.peaks(power, az, el)[0]
        assert abs(best[0] - 20) <= 3 and abs(best[1] + 10) <= 3
    assert angles.sources(r, 100) == 1
    b = grid[az.index(-20.0), el.index(10.0)]
    same = e.normal(size=(100, 1)) * (a + b) + 0.02 * (e.normal(size=(100, 16)) + 1j * e.normal(size=(100, 16)))
    sub = angles.smoothed(same)
    assert angles.sources(sub, 100) >= 2 and np.allclose(sub, sub.conj().T)


def test_doa_table(spark):
    az, el = angles.scan(-45, 45), angles.scan(-45, 20)
    a = angles.steering(az, el)[az.index(20.0), el.index(-10.0)]
    r = np.outer(a, a.conj()) + 0.01 * np.eye(16)
    df = spark.createDataFrame([(1, b, [float(v) for v in r.real.ravel()], [float(v) for v in r.imag.ravel()]) for b in (100, 200)], "capture_id long, range_bin long, re array<double>, im array<double>")
    rows = directions.doa_points(df, ["capture_id", "range_bin"], signals=1, most=1).collect()
    assert {r["range_bin"]: r["range_m"] for r in rows} == {100: 2.34375, 200: 4.6875}
    assert all(abs(r["az"] - 20) <= 3 and abs(r["el"] + 10) <= 3 and r["x"] > 0 for r in rows)
    cells = directions.beam_cells(df, ["capture_id", "range_bin"], (-20.0, 20.0), (-10.0,), board=False)
    power = {(c["range_bin"], c["az"]): c["power"] for c in cells.collect()}
    assert power[100, 20.0] > power[100, -20.0]


def test_vitals_windows(spark):
    x = _chest(78, breath=16.0, seconds=32, bins=4)
    rows = []
    for b, own in enumerate(x):
        z = np.exp(-1j * 4 * np.pi * own / signal.WAVELENGTH_MM)
        rows += [("s", 100 + b, i / FPS, [float(v.real)] * 16, [float(v.imag)] * 16) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "sensor_id string, range_bin long, ts double, re array<double>, im array<double>").repartition(6)
    got = {r["start"]: r for r in vitals.vitals(df, ["sensor_id"], 30.0, 10.0).collect()}
    assert got[0.0]["present"] and got[0.0]["hr"] == pytest.approx(78, abs=4) and got[0.0]["rr"] == pytest.approx(16, abs=2)
    smooth = vitals.smoothed_rates(vitals.vitals(df, ["sensor_id"], 30.0, 10.0), ["sensor_id"]).collect()
    assert all("hr_smooth" in r.asDict() for r in smooth)


def test_pauses_and_segments(spark):
    rows = [("s", float(t), 0.001 if 20 <= t <= 35 else 0.1, 1.0 if t < 60 else 0.1) for t in range(60)] + [("s", float(t), 0.001, 0.1) for t in range(60, 75)]
    df = spark.createDataFrame(rows, "sensor_id string, t double, amp double, refl double")
    got = {(r["start"], r["kind"]) for r in vitals.pauses(df, ["sensor_id"]).collect()}
    assert got == {(20.0, "apnea"), (60.0, "absence")}
    env = spark.createDataFrame([("s", t / 10, 5.0 if 30 < t < 70 else 0.1 + (t % 3) * 0.01) for t in range(100)], "sensor_id string, t double, motion double")
    kinds = sorted((r["start"], r["kind"]) for r in vitals.segments(env, ["sensor_id"], half=2).collect())
    assert [k for _, k in kinds] == ["still", "active", "still"]


# Differences from the watch in 30 published validation windows, sitting and lying.
SIT = [1.7, -4.6, -0.7, -2.3, -0.8, -3.8, -5.2, -1.8, -0.2, 0.4, -0.2, -1.6, -0.9, -2.2, -1.6, -10.6]
LIE = [-0.9, -1.6, -1.3, 0.3, 0.5, 1.4, 0.1, 0.0, -0.1, -0.8, 0.0, 0.0, 0.1, 0.3]


def test_published_errors(spark):
    df = spark.createDataFrame([("SIT", d) for d in SIT] + [("LIE", d) for d in LIE], "segment string, d double")
    got = {r["segment"]: r for r in evaluation.errors(df, "segment", "d", 5.0).collect()}
    assert got["SIT"]["mae"] == pytest.approx(2.412, abs=1e-3) and got["LIE"]["mae"] == pytest.approx(0.529, abs=1e-3)
    assert got["all"]["n"] == 30 and got["all"]["mae"] == pytest.approx(1.533, abs=1e-3) and got["all"]["bias"] == pytest.approx(-1.213, abs=1e-3)


def test_models(spark):
    e = np.random.default_rng(0)
    rows = [(f"r{i % 3}", float(a), float(b), int(a + 0.2 * b > 0)) for i, (a, b) in enumerate(e.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "recording string, a double, b double, label int")
    got = mldata.leave_one_out(df, ["a", "b"], "recording").collect()
    assert len(got) == 3 and all(r["auc"] > 0.95 for r in got)
    weights = {r["name"]: r["weight"] for r in mldata.exported(df, ["a", "b"]).collect()}
    assert weights["a"] > weights["b"] > 0
    w = [(e.normal(size=(2, 4)), e.normal(size=4)), (e.normal(size=(4, 3)), e.normal(size=3))]
    vec = spark.createDataFrame([(i, [float(v) for v in e.normal(size=2)]) for i in range(10)], "id long, vector array<double>")
    for r in mldata.apply_perceptron(vec, w, ["id"]).join(vec, "id").collect():
        h = np.maximum(np.array(r["vector"]) @ w[0][0] + w[0][1], 0) @ w[1][0] + w[1][1]
        want = np.exp(h - h.max()) / np.exp(h - h.max()).sum()
        assert np.allclose(r["chances"], want) and sum(r["chances"]) == pytest.approx(1)
    assert mldata.oversampled(spark.createDataFrame([(0,)] * 9 + [(1,)] * 3, "label int")).groupBy("label").count().count() == 2
