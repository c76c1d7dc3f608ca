"""Features of label windows, bursts and bins, for the fall decision and for training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import signal as s
from . import directions as dr
from . import geometry as g
from . import vitals as v


def cloud_features(points: DataFrame, keys: list[str], bin_m: str, near: float = 0.5, floor_z: float = 0.4, least: int = 4) -> DataFrame:
    """Per label window: points near the label's range, or all of them where fewer than ``least`` are.

    points: keys, frame, x, wy (ground range), wz (height), bin_m (the label's range). Gives n, hi2 (90th percentile
    of height), med, floor_frac, spans, flat (height over width) and micro (spread of the frames' counts).
    """
    marked = points.withColumn("_near", F.abs(F.col("wy") - F.col(bin_m)) < near)
    enough = marked.groupBy(*keys).agg((F.count_if("_near") >= least).alias("_enough"), F.count("*").alias("_all"))
    used = marked.join(enough, keys).where((F.col("_near") | ~F.col("_enough")) & (F.col("_all") >= least))
    per_frame = used.groupBy(*keys, "frame").agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.coalesce(F.stddev_pop("_c"), F.lit(0.0)).alias("micro"))
    width = F.greatest(F.max("x") - F.min("x"), F.lit(0.1))
    found = used.groupBy(*keys).agg(
        F.count("*").alias("n"), F.percentile("wz", 0.9).alias("hi2"), F.percentile("wz", 0.5).alias("med"), F.avg((F.col("wz") < floor_z).cast("double")).alias("floor_frac"),
        (F.max("x") - F.min("x")).alias("x_span"), (F.max("wy") - F.min("wy")).alias("y_span"), ((F.max("wz") - F.min("wz")) / width).alias("flat"),
    )
    return found.join(per_frame, keys)


def height_features(points: DataFrame, keys: list[str], ts: str, bin_m: str, near: float = 0.6, least: int = 3, min_dt: float = 0.05) -> DataFrame:
    """Fastest drop and range of the frames' median heights near the label's range; null below three frames."""
    from pyspark.sql import Window as W

    rows = points.where(F.abs(F.col("wy") - F.col(bin_m)) < near).groupBy(*keys, ts).agg(F.median("wz").alias("_h"), F.count("*").alias("_n")).where(F.col("_n") >= least)
    order = W.partitionBy(*keys).orderBy(ts)
    slope = (F.col("_h") - F.lag("_h").over(order)) / F.greatest(F.col(ts) - F.lag(ts).over(order), F.lit(min_dt))
    found = rows.withColumn("_s", slope).groupBy(*keys).agg(F.min("_s").alias("drop_rate"), (F.max("_h") - F.min("_h")).alias("h_range"), F.count("*").alias("n_traj"))
    few = F.col("n_traj") < 3
    return found.withColumns({"drop_rate": F.when(~few, F.col("drop_rate")), "h_range": F.when(~few, F.col("h_range"))})


def cube_feature(bins: np.ndarray, z: np.ndarray, fps: float) -> dict:
    """Strongest breathing line over the bins' first antenna, its share of the spectrum, and the mean amplitude variance."""
    a = z[:, :, 0] - z[:, :, 0].mean(axis=1, keepdims=True)
    power = np.abs(np.fft.fft(a * np.hanning(a.shape[1]), axis=1))
    f = np.fft.fftfreq(a.shape[1], 1 / fps)
    inside = np.flatnonzero((f >= 0.15) & (f <= 0.5))
    out = {"n_cube": int(z.shape[0] * z.shape[1]), "rr": None, "rr_strength": 0.0, "cube_var": float(np.abs(z).var(axis=(1, 2)).mean())}
    if len(inside):
        share = power[:, inside].max(axis=1) / (power.sum(axis=1) + 1e-9)
        best = int(share.argmax())
        if share[best] > 0:
            out |= {"rr": float(f[inside[power[best, inside].argmax()]] * 60), "rr_strength": float(share[best])}
    return out


def burst_state(bins: np.ndarray, z: np.ndarray, fps: float) -> dict:
    """Breathing of a fetched burst: rate (where the bins agree), strength, micro-motion, and that it was measured."""
    x = s.displacement(z)
    rr, spread = s.breathing_rate(x, fps, refine=True)
    strength = max(0.0, 1 - spread / 12)
    f, power = s.spectrum(x * np.hanning(x.shape[1]), fps)
    share = power[:, (f >= 0.15) & (f <= 0.5)].sum(axis=1) / np.maximum(power[:, f > 0.05].sum(axis=1), 1e-9)
    return {"rr": rr if strength > 0.2 else None, "strength": strength, "micro": bool(np.median(share) > 0.10 or spread < 15), "measured": True}


def body_parts(bins: np.ndarray, z: np.ndarray, fps: float) -> list[dict]:
    """Per bin: static reflection, breathing and heart motion, each against the window's largest, and the part they tell."""
    m = z.mean(axis=1)
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    static = np.abs(np.einsum("cta,ca->ct", z, m.conj()).mean(axis=1))
    x = s.displacement(z)
    parts = [static, s.band(x, fps, *s.BREATH).std(axis=1), s.band(x, fps, *s.HEART).std(axis=1)]
    r, b, c = (p / (p.max() + 1e-12) for p in parts)
    kind = np.select([(r < 0.15) & (b < 0.15), b >= 0.45, (c >= 0.40) & (r >= 0.30), (r >= 0.40) & (b < 0.25) & (c < 0.30)], ["empty", "abdomen", "chest", "head"], "body")
    return [{"range_bin": int(k), "reflection": float(r[i]), "breath": float(b[i]), "heart": float(c[i]), "part": str(kind[i])} for i, k in enumerate(bins)]


def moving_covariances(z: np.ndarray, fps: float, lo: float = 0.1, hi: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Per bin: covariance and energy of what moves between two frequencies."""
    spectrum = np.fft.fft(z - z.mean(axis=1, keepdims=True), axis=1)
    f = np.abs(np.fft.fftfreq(z.shape[1], 1 / fps))
    moving = np.fft.ifft(spectrum * ((f >= lo) & (f <= hi))[None, :, None], axis=1)
    return np.einsum("cti,ctj->cij", moving, moving.conj()) / z.shape[1], (np.abs(moving) ** 2).mean(axis=(1, 2))


def moving(entries: DataFrame, keys: list[str], size: float = 30.0, slide: float = 30.0, share: float = 0.2, least: int = 64) -> DataFrame:
    """Covariances of what moves, per window and bin, of bins with ``share`` of the largest energy or more, as packed arrays: keys, start, range_bin, re, im."""

    def helper(bins: np.ndarray, z: np.ndarray, fps: float) -> list[dict]:
        cov, energy = moving_covariances(z, fps)
        return [{"range_bin": int(b), "re": c.real.ravel().tolist(), "im": c.imag.ravel().tolist()} for b, c, e in zip(bins, cov, energy, strict=True) if e > share * energy.max()]

    return per_bin(entries, keys, helper, "range_bin int, re array<double>, im array<double>", size, slide, least)


def moving_points(packed: DataFrame, keys: list[str], tilt_deg: float = 35.0, height: float = 2.3) -> DataFrame:
    """Room points (x, y, z, power, range_m) of moving covariances (keys, range_bin, re, im): two directions a bin at most."""
    found = dr.doa_points(packed, [*keys, "range_bin"], el=(-45.0, 45.0), most=2, within_db=-10.0)
    return g.to_room(found, tilt_deg, height)


def motion_pose(points: DataFrame, keys: list[str], floor_z: float = 0.4, fall: float = 0.7, stand: float = 2.6) -> DataFrame:
    """Posture from moving points (keys, x, y, z, power, range_m): fall by the share near the floor, stand or sit by the 90th percentile; and the target, their centre by power."""
    from .voxels import weighted_height

    found = weighted_height(points, keys, "z", "power", 0.9, floor_z)
    centre = [(F.sum(F.col(c) * F.col("power")) / F.sum("power")).alias(n) for c, n in (("x", "tx"), ("y", "ty"), ("z", "tz"), ("range_m", "target_m"))]
    posed = found.withColumn("pose", F.when(F.col("floor_frac") > fall, "fall").when(F.col("z_q") >= stand, "stand").otherwise("sit"))
    return posed.join(points.groupBy(*keys).agg(*centre), keys)


def breath_wave(x: np.ndarray, fps: float, out_hz: float = 4.0) -> dict:
    """Of the strongest breathing channel: the wave in micrometres, times of its peaks, the pause since, and how periodic it is."""
    b = s.band(x, fps, *s.BREATH)
    w = b[(b**2).mean(axis=1).argmax()]
    at = s.prominent(w, max(s.BREATH_PEAK_MM, 0.2 * float(w.std())), max(1, int(2 * fps)))
    marks = at / fps
    n = len(w)
    ac = np.fft.irfft(np.abs(np.fft.rfft(w - w.mean(), 2 * n)) ** 2)[:n]
    lags = ac[int(1.5 * fps) : min(n - 1, int(10 * fps))] / (ac[0] + 1e-12)
    return {
        "wave_um": (w[:: max(1, round(fps / out_hz))] * 1000).tolist(), "marks": marks.tolist(), "pause_s": float(n / fps - (marks[-1] if len(marks) else 0.0)),
        "interval_s": float(np.median(np.diff(marks))) if len(marks) > 1 else None, "quality": float(lags.max()) if len(lags) else 0.0,
    }


def window_helper(bins: np.ndarray, z: np.ndarray, fps: float) -> dict:
    """What one window tells of a person: breathing, its wave and pause, and the heart where breathing is weak.

    Without breathing in one place, of a body's amplitude, there is no rate.
    """
    x = s.displacement(z)
    wave, place = breath_wave(x, fps), s.living(x, bins, g.RANGE_STEP, fps)
    amp = float(s.band(x, fps, *s.BREATH).std(axis=1).max())
    long = max(7.0, 2.0 * (wave["interval_s"] or 4.0))
    out = {
        "present": bool(place["present"] and amp >= s.BODY_MM), "range_m": place["range_m"], "body_um": amp * 1000, "reflection": float(np.abs(z.mean(axis=1)).mean(axis=1).max()), "pause_s": wave["pause_s"], "interval_s": wave["interval_s"],
        "quality": wave["quality"], "breathing": "pause" if wave["pause_s"] >= long else "normal", "wave_um": wave["wave_um"], "marks": wave["marks"], "rr": None, "hr": None, "strength": None, "abdomen": None, "chest": None, "hr_apart": None, "beats": None,
    }
    if out["present"]:
        rr, _ = s.breathing_rate(x, fps)
        found = s.chest_cluster(x, bins, fps, (rr or 15.0) / 60)
        out |= {"rr": rr} | {k: found[k] for k in ("hr", "strength", "abdomen", "chest")} | {"hr_apart": s.chest_rate(x, bins, fps)["hr"]}
        if found["chest"] is not None:
            out["beats"] = s.beat_count(s.band(x[bins == found["chest"]], fps, *s.HEART)[0], fps)
    return out


WINDOW = "present boolean, range_m double, body_um double, reflection double, pause_s double, interval_s double, quality double, breathing string, wave_um array<double>, marks array<double>, rr double, hr double, strength double, abdomen int, chest int, hr_apart double, beats double"


def window_states(entries: DataFrame, keys: list[str], size: float = 30.0, slide: float = 30.0, least: int = 64, tilt_deg: float = 35.0, height: float = 2.3) -> DataFrame:
    """The whole state of each window: presence, breathing, heart with its trust, posture and target (where something moves)."""
    from .falls import heart_trust

    on = [*keys, "start"]
    told = per_bin(entries, keys, window_helper, WINDOW, size, slide, least).withColumn("trust", heart_trust(F.col("hr"), F.col("strength"), F.col("rr")))
    posed = motion_pose(moving_points(moving(entries, keys, size, slide, least=least), on, tilt_deg, height), on).select(*on, "pose", "z_q", "floor_frac", "tx", "ty", "tz", "target_m")
    return told.join(posed, on, "left").withColumn("pose", F.when(F.col("present"), F.coalesce("pose", F.lit("unknown"))).otherwise("unknown"))


def respiration_helper(bins: np.ndarray, z: np.ndarray, fps: float, size: float = 4.0, hop: float = 1.0) -> list[dict]:
    """At each second: depth of the breathing and static reflection at the strongest bin, and the rate around it; with each row the window's regularity."""
    x = s.displacement(z)
    b = s.band(x, fps, *s.BREATH)
    at = int((b**2).mean(axis=1).argmax())
    rr, _ = s.breathing_rate(x, fps)
    gaps = np.diff(s.breath_times(x[at], fps, (rr or 15.0) / 60))
    cv = float(gaps.std() / gaps.mean()) if len(gaps) > 1 else 99.0
    mag = np.abs(z[at]).mean(axis=1)
    rates = s.rate_track(b[at], fps)
    there = bool(s.living(x, bins, g.RANGE_STEP, fps)["present"])
    out = []
    for t, amp in s.amplitude_track(x[at], fps, size, hop):
        part = mag[max(0, int((t - size / 2) * fps)) : int((t + size / 2) * fps)]
        near = min(rates, key=lambda r: abs(r[0] - t))[1] if rates else None
        out.append({"range_bin": int(bins[at]), "t": t, "amp": amp, "refl": float(part.mean()) if len(part) else 0.0, "rate": near, "rr": rr, "interval_cv": cv, "present": there})
    return out


RESPIRATION = "range_bin int, t double, amp double, refl double, rate double, rr double, interval_cv double, present boolean"


def respiration(entries: DataFrame, keys: list[str], size: float = 60.0, slide: float = 60.0, least: int = 64) -> tuple[DataFrame, DataFrame]:
    """The monitor: its tracks (keys, window, t, amp, refl, rate, ...), and per window the pauses, regularity and pattern."""
    from .selection import breathing_pattern

    on = [*keys, "window"]
    tracks = per_bin(entries, keys, respiration_helper, RESPIRATION, size, slide, least).withColumnRenamed("start", "window")
    stops = v.pauses(tracks.where("present"), on).groupBy(*on).agg(F.count_if(F.col("kind") == "apnea").alias("apneas"), F.count_if(F.col("kind") == "absence").alias("absences"))
    per = tracks.groupBy(*on).agg(F.first("present").alias("present"), F.first("rr").alias("rr"), F.first("interval_cv").alias("interval_cv"), F.percentile("amp", 0.5).alias("depth"), (F.stddev_pop("amp") / F.avg("amp")).alias("depth_cv"))
    both = per.join(stops, on, "left").fillna(0, ["apneas", "absences"]).withColumnRenamed("interval_cv", "cv")
    return tracks, breathing_pattern(both)


def ridge_smoothness(track: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Spread of a track's second differences per key: rows, rough, and smooth, from 0 to 1."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    bend = F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)
    per = track.withColumn("_bend", bend).groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_pop("_bend").alias("rough"))
    return per.where("n >= 4").withColumn("smooth", 1 / (1 + F.col("rough") / 10))


def liveness(bins: np.ndarray, z: np.ndarray, fps: float) -> list[dict]:
    """Per bin: share of the slow motion (0.1-2.5 Hz) that is breathing (0.15-0.5 Hz), and the rate of its peak."""
    f = np.abs(np.fft.fftfreq(z.shape[1], 1 / fps))
    power = (np.abs(np.fft.fft(z - z.mean(axis=1, keepdims=True), axis=1)) ** 2).sum(axis=2)
    breath, slow = (f >= 0.15) & (f <= 0.5), (f >= 0.1) & (f <= 2.5)
    share = power[:, breath].sum(axis=1) / np.maximum(power[:, slow].sum(axis=1), 1e-12)
    at = np.flatnonzero(breath)
    rates = f[at[power[:, at].argmax(axis=1)]] * 60 if len(at) else np.full(len(bins), np.nan)
    return [{"range_bin": int(b), "live": float(share[i]), "rate": float(rates[i])} for i, b in enumerate(bins)]


def per_bin(entries: DataFrame, keys: list[str], helper, schema: str, size: float = 30.0, slide: float = 30.0, least: int = 64) -> DataFrame:
    """``helper(bins, snapshots, fps)``'s rows of each window. schema: the helper's columns."""
    def work(pdf: pd.DataFrame) -> list[dict]:
        bins, z, fps = v.cube(pdf, least)
        found = helper(bins, z, fps) if len(bins) and fps > 0 else []
        return found if isinstance(found, list) else [found]

    return v.in_windows(entries.select(*keys, "ts", "range_bin", "re", "im"), keys, size, slide, work, f"start double, {schema}")


def clear_channels(bins: np.ndarray, z: np.ndarray, fps: float, k: int = 8) -> list[dict]:
    """The k bins whose power is most in the breathing band, best first."""
    worth = s.quality(s.displacement(z), fps, *s.BREATH)
    return [{"range_bin": int(bins[i]), "place": n + 1, "quality": float(worth[i])} for n, i in enumerate(s.best(worth, k))]


def breath_cycles_out(bins: np.ndarray, z: np.ndarray, fps: float) -> list[dict]:
    """Per bin: the heart rate before and after the mean breath cycle is taken out, and the share of the motion that goes with it.

    Cycles run between the peaks of the strongest bin's breathing; each bin's cycles are stretched to one length, averaged,
    and the average is taken out of each at its own length. A window of under three cycles only loses its mean.
    """
    x = s.displacement(z)
    breathing = s.band(x, fps, *s.BREATH)
    breath = breathing[int(breathing.std(axis=1).argmax())]
    cycles = max(0, len(s.peaks(breath, 0.0, 3)) - 1)
    out = []
    for i, own in enumerate(x):
        rest = s.without_breath(own, breath)
        before, after = (float(s.peak_frequency(v, fps, *s.HEART)[0]) * 60 for v in (own, rest))
        power = float(own.var())
        out.append({"range_bin": int(bins[i]), "cycles": cycles, "hr_before": before, "hr_after": after, "removed": 1 - float(rest.var()) / power if power > 0 else 0.0})
    return out


CYCLES = "range_bin int, cycles int, hr_before double, hr_after double, removed double"
CLEAR = "range_bin int, place int, quality double"
PARTS = "range_bin int, reflection double, breath double, heart double, part string"
LIVE = "range_bin int, live double, rate double"
CUBE = "n_cube int, rr double, rr_strength double, cube_var double"
BURST = "rr double, strength double, micro boolean, measured boolean"


def spectrogram_table(entries: DataFrame, keys: list[str], size: int = 128, hop: int = 32) -> DataFrame:
    """Displacement spectrogram of each bin, less each frequency's median: keys, range_bin, t, f, db, above."""
    rows = per_bin(entries, keys, lambda b, z, fps: _spectrogram(b, z, fps, size, hop), "range_bin int, t double, f double, db double", 1e9, 1e9, size)
    med = rows.groupBy(*keys, "range_bin", "f").agg(F.percentile("db", 0.5).alias("_m"))
    return rows.join(med, [*keys, "range_bin", "f"]).withColumn("above", F.col("db") - F.col("_m")).drop("_m", "start")


def _spectrogram(bins: np.ndarray, z: np.ndarray, fps: float, size: int, hop: int) -> list[dict]:
    out = []
    for b, x in zip(bins, s.displacement(z), strict=True):
        t, f, db = s.spectrogram(x, fps, size, hop)
        out += [{"range_bin": int(b), "t": float(t[i]), "f": float(f[j]), "db": float(db[i, j])} for i in range(len(t)) for j in range(len(f))]
    return out


def posture_score(bands: DataFrame, totals: DataFrame, keys: list[str], absent: float = 3000.0, standing: float = 40_000.0, lying: float = 35_000.0, wide: int = 5, narrow: int = 4) -> DataFrame:
    """standing, lying, unknown or absent from the total variance (column total) and the bands' widths, with a score."""
    per = bands.groupBy(*keys).agg(F.sum(F.col("bin_end") - F.col("bin_start")).alias("_w"), F.sum(F.when(F.col("tier") == "weak", F.col("bin_end") - F.col("bin_start")).otherwise(0)).alias("_weak"))
    rows = totals.join(per, keys, "left").fillna(0, ["_w", "_weak"])
    total, w = F.col("total"), F.col("_w")
    up = F.when(total >= standing, 0.5).otherwise(0.0) + F.when(w >= wide, 0.5).otherwise(0.0)
    down = F.when((total < standing) & (total <= lying), 0.5).otherwise(0.0) + F.when((w > 0) & (w < wide) & (w <= narrow), 0.5).otherwise(0.0) + F.when((F.col("_weak") > 0) & (total < lying), 0.3).otherwise(0.0)
    scored = rows.withColumns({"_u": up, "_d": down})
    gone = (total < absent) & (w == 0)
    posture = F.when(gone, "absent").when(F.col("_u") > F.col("_d"), "standing").when(F.col("_d") > F.col("_u"), "lying").otherwise("unknown")
    score = F.when(gone, 0.8).when(F.col("_u") == F.col("_d"), 0.0).otherwise(F.least(F.greatest("_u", "_d"), F.lit(1.0)))
    return scored.select(*keys, "total", posture.alias("posture"), score.alias("score"))


def scene_rows(states: DataFrame, heights: DataFrame, keys: list[str], order: str, low: float = 0.45, least: int = 5) -> DataFrame:
    """Feature rows of a recording with a label that the features don't see: runs of low height, filled back.

    states: what the episode machine gives per frame; heights: keys, order, h_s.
    """
    from .islands import back_filled

    labelled = back_filled(heights, keys, [order], F.col("h_s") <= low, least, "fallen")
    return states.join(labelled.select(*keys, order, "fallen"), [*keys, order])
