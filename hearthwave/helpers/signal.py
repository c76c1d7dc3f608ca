"""Small numpy helpers for displacement signals: rows are channels (range bins), columns are frames."""

from __future__ import annotations

import numpy as np

#: Wavelength in mm, the bands of breathing and of a resting heart in Hz, least chest motion in mm.
WAVELENGTH_MM = 5.0
BREATH, HEART = (0.12, 0.6), (1.0, 1.7)
BREATH_MM = 0.004
#: What a breath's peak stands out by at least, and a body's least breathing amplitude, in mm.
BREATH_PEAK_MM, BODY_MM = 0.010, 0.015


def displacement(z: np.ndarray) -> np.ndarray:
    """mm from complex snapshots (channels, frames, antennas): the phase along each channel's mean vector."""
    m = z.mean(axis=1)
    m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    phase = np.unwrap(np.angle(np.einsum("cta,ca->ct", z, m.conj())), axis=1)
    return -WAVELENGTH_MM / (4 * np.pi) * (phase - phase.mean(axis=1, keepdims=True))


def spectrum(x: np.ndarray, fps: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies, and the power of each channel without its mean."""
    return np.fft.rfftfreq(x.shape[-1], 1 / fps), np.abs(np.fft.rfft(x - x.mean(axis=-1, keepdims=True))) ** 2


def band(x: np.ndarray, fps: float, lo: float, hi: float, comb: float | None = None, width: float = 0.022, teeth: int = 24) -> np.ndarray:
    """What of each channel lies between two frequencies; comb: a frequency whose multiples are cut out."""
    f = np.fft.rfftfreq(x.shape[-1], 1 / fps)
    keep = (f >= lo) & (f <= hi)
    if comb:
        n = np.clip(np.round(f / comb), 1, teeth)
        keep &= np.abs(f - n * comb) > width
    return np.fft.irfft(np.fft.rfft(x - x.mean(axis=-1, keepdims=True)) * keep, n=x.shape[-1])


def quality(x: np.ndarray, fps: float, lo: float, hi: float) -> np.ndarray:
    """Power inside a band over the power outside."""
    f, s = spectrum(x, fps)
    inside = s[..., (f >= lo) & (f <= hi)].sum(axis=-1)
    return inside / (s.sum(axis=-1) - inside + 1e-12)


def _vertex(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where a parabola through three values peaks, from the middle one."""
    bend = a - 2 * b + c
    return np.clip(np.where(np.abs(bend) > 1e-9, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-9, bend, 1), 0.0), -0.5, 0.5)


def peak_frequency(x: np.ndarray, fps: float, lo: float, hi: float, refine: bool = False) -> np.ndarray:
    """Each channel's strongest frequency in a band (NaN where the band has none)."""
    f, s = spectrum(np.atleast_2d(x), fps)
    inside = np.flatnonzero((f >= lo) & (f <= hi))
    if not len(inside):
        return np.full(len(s), np.nan)
    k = inside[s[:, inside].argmax(axis=1)]
    found = f[k]
    if refine:
        at, ok = np.arange(len(s)), (k > 0) & (k < s.shape[1] - 1)
        shift = _vertex(s[at, np.maximum(k - 1, 0)], s[at, k], s[at, np.minimum(k + 1, s.shape[1] - 1)])
        found = found + np.where(ok, shift, 0) * (f[1] - f[0])
    return found


def period_rate(x: np.ndarray, fps: float, lo_bpm: float, hi_bpm: float, refine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Beats a minute from each channel's autocorrelation, and its height there (NaN and 0 where there is none)."""
    x = np.atleast_2d(x)
    n = x.shape[1]
    power = np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2
    ac = np.fft.irfft(power, axis=1)[:, :n]
    first, last = int(fps / (hi_bpm / 60)), int(fps / (lo_bpm / 60))
    if last <= first + 1 or last >= n:
        return np.full(len(x), np.nan), np.zeros(len(x))
    good = ac[:, 0] > 0
    ac = ac / np.where(good, ac[:, 0], 1)[:, None]
    k = first + ac[:, first:last].argmax(axis=1)
    at = np.arange(len(x))
    lag = k.astype(float)
    if refine:
        lag += np.where((k > 0) & (k < n - 1), _vertex(ac[at, np.maximum(k - 1, 0)], ac[at, k], ac[at, np.minimum(k + 1, n - 1)]), 0)
    return np.where(good, fps / lag * 60, np.nan), np.where(good, ac[at, k], 0.0)


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Local maxima of ``height`` or more, the higher ones first where they are nearer than ``distance``."""
    at = np.flatnonzero((x[1:-1] > x[:-2]) & (x[1:-1] >= x[2:]) & (x[1:-1] >= height)) + 1
    kept: list[int] = []
    for i in at[np.argsort(-x[at], kind="stable")]:
        if all(abs(i - j) >= distance for j in kept):
            kept.append(int(i))
    return np.array(sorted(kept), dtype=int)


def prominent(x: np.ndarray, least: float, distance: int) -> np.ndarray:
    """Local maxima, the higher ones first where they are nearer than ``distance``, that stand out by ``least``.

    A maximum stands out by its height over the higher of the two lowest points that part it from higher ground.
    """
    kept = peaks(x, -np.inf, distance)
    out = []
    for i in kept.tolist():
        higher = np.flatnonzero(x > x[i])
        left, right = higher[higher < i], higher[higher > i]
        low = x[left[-1] + 1 if len(left) else 0 : i + 1].min(), x[i : right[0] if len(right) else len(x)].min()
        if x[i] - max(low) >= least:
            out.append(i)
    return np.array(out, dtype=int)


def beat_count(x: np.ndarray, fps: float, hi_bpm: float = 150, height: float = 0.25) -> float:
    """Beats a minute by counting peaks."""
    scaled = x / (x.std() + 1e-9)
    return len(peaks(scaled, height, max(1, int(fps / (hi_bpm / 60))))) / (len(x) / fps) * 60


def best(values: np.ndarray, k: int) -> np.ndarray:
    return np.argsort(-values, kind="stable")[:k]


def _median(values: np.ndarray) -> float | None:
    values = values[~np.isnan(values)]
    return float(np.median(values)) if len(values) else None


def breathing_rate(x: np.ndarray, fps: float, k: int = 8, refine: bool = False) -> tuple[float | None, float]:
    """Breaths a minute (the median over the k clearest channels), and their spread."""
    top = best(quality(band(x, fps, *BREATH), fps, *BREATH), k)
    rates = peak_frequency(x[top], fps, *BREATH, refine=refine) * 60
    rates = rates[~np.isnan(rates)]
    return _median(rates), float(rates.std()) if len(rates) > 1 else 99.0


def presence(x: np.ndarray, fps: float, k: int = 8) -> dict:
    """Whether a chest moves: the breathing band's root mean square over the k clearest channels."""
    b = band(x, fps, *BREATH)
    top = best(quality(b, fps, *BREATH), k)
    rms = float(np.median(np.sqrt((b[top] ** 2).mean(axis=1)))) if len(top) else 0.0
    return {"present": rms >= BREATH_MM, "disp_rms": rms}


def living(x: np.ndarray, bins: np.ndarray, step: float, fps: float, k: int = 6, least: float = 2.6, span: float = 0.15) -> dict:
    """Whether the breathing is in one place: its peak over its mean, and the range over which the k best bins lie."""
    level = band(x, fps, *BREATH).std(axis=1)
    top = best(level, k)
    concentration, spread = float(level.max() / (level.mean() + 1e-12)), float(bins[top].astype(float).std()) * step
    return {"present": concentration >= least and spread <= span, "concentration": concentration, "span_m": spread, "range_m": float(np.median(bins[top])) * step}


def heart_rate(x: np.ndarray, fps: float, breath_hz: float, k: int = 8, lo: float = HEART[0], hi: float = HEART[1], fast_hi: float | None = None, share: float = 0.5) -> dict:
    """Resting heart rate; with ``fast_hi``, the rate above the band if most channels' periods are there."""

    def clearest(low: float, high: float) -> np.ndarray:
        b = band(x, fps, low, high, comb=breath_hz)
        return b[best(quality(b, fps, low, high), k)]

    rates, heights = period_rate(clearest(lo, hi), fps, round(lo * 60), round(hi * 60))
    out = {"hr": _median(rates), "strength": float(np.median(heights[~np.isnan(rates)])) if (~np.isnan(rates)).any() else 0.0, "band": "LOW"}
    if fast_hi and fast_hi > hi:
        wide, _ = period_rate(clearest(lo, fast_hi), fps, round(lo * 60), round(fast_hi * 60))
        above = wide[~np.isnan(wide)] > hi * 60
        if len(above) and above.mean() >= share and np.nanmedian(wide) > hi * 60:
            b = band(x, fps, hi, fast_hi, comb=breath_hz)
            top = best(quality(b, fps, hi, fast_hi), k)
            fast = _median(peak_frequency(x[top], fps, hi, fast_hi) * 60)
            if fast is not None:
                out = {"hr": fast, "strength": float(above.mean()), "band": "HIGH"}
    return out


def rhythm(x: np.ndarray, fps: float, breath_hz: float, k: int = 8, least_beats: int = 5) -> dict:
    """How regular the beat is: autocorrelation height, and the variation of the intervals between beats."""
    b = band(x, fps, *HEART, comb=breath_hz)
    b = b[best(quality(b, fps, *HEART), k)]
    rates, heights = period_rate(b, fps, HEART[0] * 60, HEART[1] * 60)
    coherence = float(np.median(heights)) if len(heights) else 0.0
    beats = [peaks(row / (row.std() + 1e-9), 0.25, max(1, int(fps / HEART[1] * 0.7))) for row in b]
    gaps = [np.diff(p) / fps for p in beats if len(p) >= least_beats]
    cv = float(np.median([g.std() / g.mean() for g in gaps])) if gaps else None
    n = int(np.median([len(p) for p in beats])) if beats else 0
    verdict = "REGULAR" if coherence >= 0.45 else "IRREGULAR" if coherence < 0.30 and n >= least_beats else "UNCLEAR"
    return {"coherence": coherence, "interval_cv": cv, "n_beats": n, "verdict": verdict}


def chest_rate(x: np.ndarray, bins: np.ndarray, fps: float, lo: float = 0.9, hi: float = 2.3, offset: int = 3, share: float = 0.5) -> dict:
    """Heart rate at bins away from the strongest breathing, where there are any."""
    power = (np.abs(np.fft.rfft(band(x, fps, *BREATH), axis=1)) ** 2).sum(axis=1)
    belly = int(power.argmax())
    chest = np.flatnonzero((power > 0.01 * power[belly]) & (power < share * power[belly]) & (np.abs(bins - bins[belly]) >= offset))
    if not len(chest):
        return {"hr": None, "decoupled": False, "abdomen": int(bins[belly])}
    rates, heights = period_rate(band(x[chest], fps, lo, hi), fps, lo * 60, hi * 60, refine=True)
    return {"hr": _median(rates), "decoupled": True, "abdomen": int(bins[belly]), "strength": float(np.median(heights))}


def beat_contrast(x: np.ndarray, fps: float, breath_hz: float, lo: float = HEART[0], hi: float = HEART[1], harmonics: int = 11, width: float = 0.035) -> np.ndarray:
    """Each channel's tallest line in the heart's band that is no multiple of the breathing, over the median there."""
    f, power = spectrum(x, fps)
    multiples = breath_hz * np.arange(1, harmonics + 1)
    inside = (f >= lo) & (f <= hi) & (np.abs(f[:, None] - multiples).min(axis=1) > width)
    if not inside.any():
        return np.zeros(len(x))
    level = np.sqrt(power[:, inside])
    return level.max(axis=1) / (np.median(level, axis=1) + 1e-12)


def chest_cluster(x: np.ndarray, bins: np.ndarray, fps: float, breath_hz: float, reach: int = 20, soft: float = 0.3) -> dict:
    """Heart rate where the beat is clear and the breathing weak: the best such bin near the strongest breathing, and two to either side."""
    amp = band(x, fps, *BREATH).std(axis=1)
    belly = int(amp.argmax())
    score = beat_contrast(x, fps, breath_hz) / (amp / (amp[belly] + 1e-9) + soft)
    score = np.where(np.abs(bins - bins[belly]) <= reach, score, -1.0)
    out = {"abdomen": int(bins[belly]), "chest": None, "hr": None, "strength": None}
    if score.max() <= 0:
        return out
    chest = int(score.argmax())
    rates, heights = period_rate(band(x[max(0, chest - 2) : chest + 3], fps, *HEART), fps, HEART[0] * 60, HEART[1] * 60, refine=True)
    ok = ~np.isnan(rates)
    return out | {"chest": int(bins[chest]), "hr": _median(rates), "strength": float(np.median(heights[ok])) if ok.any() else None}


def rate_track(x: np.ndarray, fps: float, size: float = 20.0, hop: float = 2.0) -> list[tuple[float, float]]:
    """(time, breaths a minute) of a signal's windows."""
    w, h = int(size * fps), max(1, int(hop * fps))
    starts = range(0, max(1, len(x) - w), h)
    return [((s + w / 2) / fps, float(peak_frequency(x[s : s + w], fps, *BREATH)[0]) * 60) for s in starts]


def amplitude_track(x: np.ndarray, fps: float, size: float = 5.0, hop: float = 1.0) -> list[tuple[float, float]]:
    """(time, spread about the window's own straight line): a breath held shows as nearly none."""
    w, h = int(size * fps), max(1, int(hop * fps))
    t = np.arange(w) - (w - 1) / 2
    out = []
    for s in range(0, max(1, len(x) - w), h):
        seg = x[s : s + w] - x[s : s + w].mean()
        line = t[: len(seg)] * (t[: len(seg)] @ seg) / (t[: len(seg)] @ t[: len(seg)])
        out.append(((s + w / 2) / fps, float((seg - line).std())))
    return out


def breath_times(x: np.ndarray, fps: float, breath_hz: float) -> np.ndarray:
    """Times of whole cycles of the breathing phase."""
    tight = band(x, fps, max(BREATH[0], breath_hz - 0.08), breath_hz + 0.08)
    full = np.fft.fft(tight)
    full[len(full) // 2 + 1 :] = 0
    full[1 : (len(full) + 1) // 2] *= 2
    phase = np.unwrap(np.angle(np.fft.ifft(full)))
    phase = phase - phase[0]
    cycles = np.arange(1, int(phase[-1] // (2 * np.pi)) + 1)
    return np.interp(2 * np.pi * cycles, phase, np.arange(len(phase))) / fps


def without_breath(x: np.ndarray, breath: np.ndarray, least: int = 3) -> np.ndarray:
    """The signal less its mean cycle: cycles run between the breath's peaks and are stretched to one length."""
    top = peaks(breath, 0.0, 3)
    if len(top) < least + 1:
        return x - x.mean()
    size = int(np.median(np.diff(top)))
    grid = np.linspace(0, 1, size)
    cycles = [np.interp(grid, np.linspace(0, 1, b - a), x[a:b]) for a, b in zip(top[:-1], top[1:], strict=True)]
    mean = np.mean(cycles, axis=0)
    out = x.astype(float).copy()
    for a, b in zip(top[:-1], top[1:], strict=True):
        out[a:b] -= np.interp(np.linspace(0, 1, b - a), grid, mean)
    return out


def spectrogram(x: np.ndarray, fps: float, size: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, frequencies and power (dB) of windowed pieces."""
    starts = np.arange(0, len(x) - size + 1, hop)
    pieces = np.stack([x[s : s + size] for s in starts]) * np.hanning(size)
    return (starts + size / 2) / fps, np.fft.rfftfreq(size, 1 / fps), 10 * np.log10(np.abs(np.fft.rfft(pieces, axis=1)) ** 2 + 1e-12)


def smoothed(rates: list[float | None], q: float = 0.7, r: float = 4.0, near: float = 0.10, jump: float = 0.20, history: int = 5, use_median: bool = False) -> list[float | None]:
    """A rate track: values far from the recent ones are passed over (coasting), the rest go through a Kalman filter.

    near: allowed distance from the recent mean or median; jump: from the last value. After ``history`` values in
    a row that were passed over but agree with each other, the track starts anew from them.
    """
    out: list[float | None] = []
    kept: list[float] = []
    odd: list[float] = []
    state, variance = None, 0.0
    for value in rates:
        if value is None or np.isnan(value):
            out.append(state)
            continue
        if state is None:
            ok = True
        else:
            recent = np.median(kept[-history:]) if use_median else np.mean(kept[-history:])
            ok = abs(value - recent) <= near * recent and abs(value - kept[-1]) <= jump * kept[-1]
        if not ok:
            odd.append(value)
            if len(odd) >= history and np.std(odd[-history:]) <= near * np.mean(odd[-history:]):
                kept, state, variance, odd = odd[-history:], float(np.mean(odd[-history:])), r, []
            out.append(state)
            continue
        odd = []
        kept.append(float(value))
        if state is None:
            state, variance = float(value), r
        else:
            variance += q * q
            gain = variance / (variance + r)
            state, variance = state + gain * (value - state), (1 - gain) * variance
        out.append(state)
    return out


def rotation_p(x: np.ndarray, y: np.ndarray, shifts: int = 400) -> float:
    """Share of the ``shifts`` rotated series, every second round of them reversed, whose robust slope is the series' own or falls steeper.

    1 for under five values.
    """
    n = len(y)
    if n < 5:
        return 1.0
    i, j = np.nonzero(x[None, :] > x[:, None])
    run = x[j] - x[i]
    slopes = {(r, back): float(np.median((v[j] - v[i]) / run)) for r in range(n) for back in (0, 1) for v in [np.roll(y, r)[:: -1 if back else 1]]}
    own = slopes[0, 0]
    return sum(slopes[k % n, k // n % 2] <= own for k in range(shifts)) / shifts
