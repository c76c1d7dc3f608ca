"""Vitals from slow-time snapshots: windows per capture, worked on by the numpy helpers, one window a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..helpers import signal as s
from .geometry import RANGE_STEP

STATE = "start double, present boolean, disp_rms double, rr double, rr_spread double, hr double, strength double, band string, range_m double, concentration double, bins int, fps double"


def in_windows(entries: DataFrame, keys: list[str], size: float, slide: float, work: Callable[[pd.DataFrame], list[dict]], schema: str) -> DataFrame:
    """``work``'s rows for each window [start, start + size) that holds a snapshot; schema: start and the rows' columns.

    Starts are whole multiples of ``slide``. Windows come in blocks of four times their length, and a snapshot goes to
    each block whose windows hold it: to one, or near a block's end to two, however much the windows overlap.
    """
    slots = max(1, int(np.ceil(4 * size / slide)))
    first, last = F.floor((F.col("ts") - size) / slide) + 1, F.floor(F.col("ts") / slide)
    placed = entries.withColumn("_block", F.explode(F.sequence(F.floor(first / slots), F.floor(last / slots))))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.select(*keys).schema.fields)
    names = [*keys, *(c.split()[0] for c in schema.split(", "))]

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_block").sort_values(["ts", "range_bin"], kind="stable").reset_index(drop=True)
        ts, out = pdf["ts"].to_numpy(float), []
        for slot in range(key[-1] * slots, (key[-1] + 1) * slots):
            start = slot * float(slide)
            low, high = np.searchsorted(ts, [start, start + size])
            if high > low:
                out += [dict(zip(keys, key, strict=False)) | {"start": start} | r for r in work(pdf.iloc[low:high])]
        return pd.DataFrame(out, columns=names)

    return placed.groupBy(*keys, "_block").applyInPandas(block, f"{kinds}, {schema}")


def cube(pdf: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(bins, complex snapshots by bin, frame and antenna, frames a second); bins with under ``least`` frames go."""
    bins, parts, rates = [], [], []
    for b, own in pdf.sort_values("ts").groupby("range_bin"):
        if len(own) >= least:
            bins.append(b)
            parts.append(np.stack(own["re"].to_numpy()).astype(float) + 1j * np.stack(own["im"].to_numpy()).astype(float))
            span = own["ts"].iloc[-1] - own["ts"].iloc[0]
            rates.append((len(own) - 1) / span if span > 0 else 0.0)
    if not bins:
        return np.array([]), np.zeros((0, 0, 0)), 0.0
    n = min(map(len, parts))
    return np.array(bins), np.stack([p[:n] for p in parts]), float(np.median(rates))


def state_of(bins: np.ndarray, x: np.ndarray, fps: float, step: float = RANGE_STEP, fast_hi: float | None = None) -> dict:
    """Presence, breathing and heart rate of one window's displacements."""
    there, place = s.presence(x, fps), s.living(x, bins, step, fps)
    out = {"present": bool(there["present"]), "disp_rms": there["disp_rms"], "range_m": place["range_m"], "concentration": place["concentration"], "bins": len(bins), "fps": fps, "rr": None, "rr_spread": None, "hr": None, "strength": None, "band": None}
    if there["present"]:
        rr, spread = s.breathing_rate(x, fps)
        out |= {"rr": rr, "rr_spread": spread} | s.heart_rate(x, fps, (rr or 15.0) / 60, fast_hi=fast_hi)
    return out


def per_window(entries: DataFrame, keys: list[str], size: float, slide: float, helper: Callable[[np.ndarray, np.ndarray, float], dict], schema: str, least: int = 64) -> DataFrame:
    """``helper(bins, displacements, fps)`` of each window; windows without frames enough give no row."""

    def work(pdf: pd.DataFrame) -> list[dict]:
        bins, z, fps = cube(pdf, least)
        return [helper(bins, s.displacement(z), fps)] if len(bins) and fps > 0 else []

    return in_windows(entries.select(*keys, "ts", "range_bin", "re", "im"), keys, size, slide, work, schema)


def vitals(entries: DataFrame, keys: list[str], size: float = 30.0, slide: float = 10.0, fast_hi: float | None = None) -> DataFrame:
    """Window states of captures; entries: keys, ts (seconds), range_bin, re, im."""
    return per_window(entries, keys, size, slide, lambda bins, x, fps: state_of(bins, x, fps, fast_hi=fast_hi), STATE)


def rhythm_alerts(entries: DataFrame, keys: list[str], size: float = 30.0, slide: float = 10.0, rows: int = 7, least: int = 4) -> DataFrame:
    """Regularity of the beat per window, and an alert where ``least`` of the last ``rows`` windows are irregular."""
    from pyspark.sql import Window as W

    def helper(bins: np.ndarray, x: np.ndarray, fps: float) -> dict:
        rr, _ = s.breathing_rate(x, fps)
        return {k: v for k, v in s.rhythm(x, fps, (rr or 15.0) / 60).items()}

    found = per_window(entries, keys, size, slide, helper, "start double, coherence double, interval_cv double, n_beats int, verdict string")
    last = W.partitionBy(*keys).orderBy("start").rowsBetween(-(rows - 1), 0)
    return found.withColumn("alert", F.sum((F.col("verdict") == "IRREGULAR").cast("int")).over(last) >= least)


def smoothed_rates(states: DataFrame, keys: list[str], value: str = "hr", order: str = "start", **options) -> DataFrame:
    """Adds ``{value}_smooth``: gated and filtered in time order, of a table or a stream, by ``streaming.steps.smooth_step``.

    A table's rows come batch after batch from sorted partitions; of a track only its state is held.
    """
    from ..streaming import jobs
    from ..streaming.steps import smooth_step

    kinds = {f.name: f.dataType.simpleString() for f in states.schema.fields}
    others = [c for c in states.columns if c not in (*keys, order)]
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, order, *others)) + f", {value}_smooth double"

    def step(state: dict, row: dict) -> dict:
        return {c: row[c] for c in others} | smooth_step(state, row, value, **options)

    run = jobs.in_stream if states.isStreaming else jobs.in_batch
    return run(states, keys, [order], step, schema).select(*states.columns, f"{value}_smooth")


def pauses(amplitude: DataFrame, keys: list[str], share: float = 0.45, floor_mm: float = 0.015, least_s: float = 10.0, present: float = 0.5) -> DataFrame:
    """Breathing pauses: runs of low amplitude; apnea where the reflection stays, absence where it goes.

    amplitude: keys, t, amp (mm), refl. The bounds are against the capture's 75th percentile and its median reflection.
    """
    from .islands import runs

    base = amplitude.groupBy(*keys).agg(F.percentile("amp", 0.75).alias("_p75"), F.percentile("refl", 0.5).alias("_r"))
    rows = runs(amplitude.join(base, keys), keys, ["t"], (F.col("amp") < share * F.col("_p75")) & (F.col("amp") < floor_mm)).where("run_flag")
    found = rows.groupBy(*keys, "run").agg(F.min("t").alias("start"), F.max("t").alias("end"), (F.avg("refl") >= present * F.first("_r")).alias("_there"))
    return found.where(F.col("end") - F.col("start") >= least_s).select(*keys, "start", "end", (F.col("end") - F.col("start")).alias("seconds"), F.when(F.col("_there"), "apnea").otherwise("absence").alias("kind"))


def segments(envelope: DataFrame, keys: list[str], half: int = 5, k: float = 4.0, least_s: float = 1.0) -> DataFrame:
    """Active and still spans: a moving average of motion above the median plus k deviations, one second long or longer."""
    from pyspark.sql import Window as W

    from .islands import runs

    smooth = F.avg("motion").over(W.partitionBy(*keys).orderBy("t").rowsBetween(-half, half))
    rows = envelope.withColumn("_m", smooth)
    med = rows.groupBy(*keys).agg(F.median("_m").alias("_med"))
    mad = rows.join(med, keys).groupBy(*keys, "_med").agg(F.median(F.abs(F.col("_m") - F.col("_med"))).alias("_mad"))
    flagged = runs(rows.join(mad, keys), keys, ["t"], F.col("_m") > F.col("_med") + k * F.col("_mad"))
    spans = flagged.groupBy(*keys, "run", "run_flag").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    return spans.where(F.col("end") - F.col("start") >= least_s).select(*keys, "start", "end", F.when(F.col("run_flag"), "active").otherwise("still").alias("kind"))
