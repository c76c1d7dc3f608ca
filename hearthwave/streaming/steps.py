"""Step functions of the ordered jobs: (state, row) -> outputs. Batch and stream share them.

A state is a plain dict of JSON values, so that it can be kept between micro-batches.
"""

from __future__ import annotations

import math

import numpy as np


def latch_step(state: dict, row: dict, sustain: int = 5, clear: int = 5, low_m: float = 0.45) -> dict:
    """Down latch of one track: on at the ``sustain``-th low frame in a row, off at the ``clear``-th other one."""
    low = row.get("h_s") is not None and row["h_s"] <= low_m
    state["n"] = state.get("n", 0) + 1 if state.get("low") == low else 1
    state["low"] = low
    if low and state["n"] >= sustain:
        state["down"] = True
    elif not low and state["n"] >= clear:
        state["down"] = False
    return {"down": state.get("down", False)}


def smooth_step(state: dict, row: dict, value: str = "hr", q: float = 0.7, r: float = 4.0, near: float = 0.10, jump: float = 0.20, history: int = 5, use_median: bool = False) -> dict:
    """Continuity gate and filter of one rate track, a value at a time: the filter's mean and variance and the last values are its state.

    A value far from the recent ones (``near``: from their mean or median, ``jump``: from the last) is passed over, and the
    track coasts on its mean; ``history`` values in a row that were passed over but agree start it anew.
    """
    v, kept, odd = row.get(value), state.get("kept", []), state.get("odd", [])
    if v is not None and not math.isnan(v):
        v = float(v)
        if kept:
            recent = np.median(kept) if use_median else np.mean(kept)
            ok = abs(v - recent) <= near * recent and abs(v - kept[-1]) <= jump * kept[-1]
        else:
            ok = True
        if not ok:
            odd = [*odd, v][-history:]
            if len(odd) == history and np.std(odd) <= near * np.mean(odd):
                state.update(mean=float(np.mean(odd)), variance=r)
                kept, odd = odd, []
        elif not kept:
            state.update(mean=v, variance=r)
            kept, odd = [v], []
        else:
            spread = state["variance"] + q * q
            gain = spread / (spread + r)
            state.update(mean=state["mean"] + gain * (v - state["mean"]), variance=(1 - gain) * spread)
            kept, odd = [*kept, v][-history:], []
        state.update(kept=kept, odd=odd)
    return {f"{value}_smooth": state.get("mean")}


def _nearest(x: float, y: float, spots: list[tuple], gate: float):
    """Key of the nearest of (key, x, y) strictly within the gate; the first of equals."""
    found = min(((math.hypot(x - sx, y - sy), i, key) for i, (key, sx, sy) in enumerate(spots)), default=None)
    return found[2] if found and found[0] < gate else None


def floor_step(state: dict, row: dict, gate: float = 1.2, grace: int = 8, death_s: float = 5.0) -> list[dict]:
    """Identity of clusters near the floor, for one frame of a sensor.

    row: t, tracks [(tid, x, y)], clusters [(x, y, n)] in their order, rr [bool per cluster]. A cluster takes, in this
    order, a live track, a floor track not yet taken, a track that died lately (and is then spent), or a new id.
    """
    t, live = row["t"], {int(k): (x, y) for k, x, y in row["tracks"]}
    dead = {int(k): v for k, v in state.get("dead", {}).items()}
    for tid, x, y in state.get("last", []):
        if tid not in live:
            dead[tid] = [x, y, t]
    dead = {k: v for k, v in dead.items() if t - v[2] < death_s and k not in live}
    floor = state.get("floor", [])
    for f in floor:
        f["age"] += 1
    taken: set[int] = set()

    def put(key: int, x: float, y: float, n: int, source: str) -> dict:
        own = next((f for f in floor if f["id"] == key), None)
        if own is None:
            own = {"id": key, "seen": 0, "has_rr": False}
            floor.append(own)
        own.update(x=x, y=y, n=n, age=0, source=source, seen=own["seen"] + 1)
        taken.add(key)
        return own

    for i, (x, y, n) in enumerate(row["clusters"]):
        key = _nearest(x, y, [(k, *xy) for k, xy in live.items()], gate)
        if key is not None:
            own = put(key, x, y, n, "gtrack")
        elif (key := _nearest(x, y, [(f["id"], f["x"], f["y"]) for f in floor if f["id"] not in taken], gate)) is not None:
            own = put(key, x, y, n, "inherited" if key >= 0 else "floor")
        elif (key := _nearest(x, y, [(k, v[0], v[1]) for k, v in dead.items()], gate)) is not None:
            dead.pop(key)
            own = put(key, x, y, n, "inherited")
        else:
            state["next"] = state.get("next", 0) - 1
            own = put(state["next"], x, y, n, "floor")
        if row.get("rr") and row["rr"][i]:
            own["has_rr"] = True
    floor = [f for f in floor if f["age"] <= grace]
    state |= {"floor": floor, "dead": {str(k): v for k, v in dead.items()}, "last": [[k, *xy] for k, xy in live.items()]}
    return [f | {"person": f["source"] in ("gtrack", "inherited") or f["has_rr"]} for f in floor]


#: Seconds and metres of the episode machine, fixed values; each can be given as an option.
EPISODE = {
    "open_s": 6.0, "ask_s": 18.0, "again_s": 60.0, "answers": 3, "negatives": 2, "hold_s": 30.0, "rearm_s": 4.0, "cancel_m": 0.5, "cancel_s": 1.0,
    "up_z": 0.4, "up_s": 2.0, "near_m": 0.8, "away_m": 1.5, "step_m": 0.3, "speed": 1.2, "answer_s": 12.0, "answer_bins": 10,
}


def episode_step(state: dict, row: dict, **options) -> dict:
    """One frame of a sensor's fall episode. Phases: idle, anchored (down seen), open (after ``open_s``).

    row: t, down, x, y, bin (of the target), upright [(x, y)] tracks that stand, stands (a standing box at the anchor
    without a lying cluster), cloud_z (median height or None), cleaned (a confirmed fall), track (x, y) or None,
    answer (epoch, bin, yes/no/None) or None. Gives phase, red, event, and ask: the query's epoch when one is due.
    """
    o = EPISODE | options
    t = row["t"]
    out = {"t": t, "phase": "", "red": False, "event": False, "ask": None, "events": 0}
    if row["down"]:
        state["down_t"] = t
        if state.get("phase", "idle") == "idle":
            state |= {"phase": "anchored", "x": row["x"], "y": row["y"], "bin": row["bin"], "since": t, "up_since": None}
    if state.get("phase") == "anchored":
        stands = any(math.hypot(x - state["x"], y - state["y"]) <= o["cancel_m"] for x, y in row["upright"])
        state["up_since"] = (state["up_since"] if state["up_since"] is not None else t) if stands else None
        if stands and t - state["up_since"] >= o["cancel_s"]:
            state["phase"] = "idle"
        elif t - state["since"] >= o["open_s"]:
            state |= {"phase": "open", "opened": t, "epoch": state.get("epoch", 0) + 1, "asked": None, "counted": 0, "negatives": 0, "track0": None, "low_since": None}
    if state.get("phase") == "open":
        _open(state, row, o, out)
    if row.get("cleaned"):
        state["hold"] = t + o["hold_s"]
        _fire(state, out)
    if state.get("phase", "idle") == "idle" and t - state.get("down_t", -math.inf) >= o["rearm_s"]:
        state["armed"] = True
    out |= {"phase": state.get("phase", "idle"), "red": bool(state.get("red")) or t < state.get("hold", -math.inf), "events": state.get("events", 0)}
    return out


def _fire(state: dict, out: dict) -> None:
    if state.get("armed", True):
        state |= {"armed": False, "events": state.get("events", 0) + 1}
        out["event"] = True


def _end(state: dict) -> None:
    state |= {"phase": "idle", "red": False}


def _open(state: dict, row: dict, o: dict, out: dict) -> None:
    t = row["t"]
    answer = row.get("answer")
    if answer and answer[0] == state["epoch"] and state["asked"] is not None and t - state["asked"] <= o["answer_s"] and abs(answer[1] - state["bin"]) <= o["answer_bins"] and state["counted"] < o["answers"]:
        if answer[2] is True:
            state |= {"red": True, "negatives": 0, "counted": state["counted"] + 1}
            _fire(state, out)
        elif answer[2] is False:
            state |= {"negatives": state["negatives"] + 1, "counted": state["counted"] + 1}
            if state["negatives"] >= o["negatives"]:
                return _end(state)
    if t - state["opened"] >= o["ask_s"]:
        if state["asked"] is None and row.get("stands"):
            return _end(state)
        if state["counted"] < o["answers"] and (state["asked"] is None or t - state["asked"] >= o["again_s"]):
            state["asked"] = t
            out["ask"] = state["epoch"]
    z = row.get("cloud_z")
    state["low_since"] = (state["low_since"] if state["low_since"] is not None else t) if z is not None and z > o["up_z"] else None
    if state["low_since"] is not None and t - state["low_since"] >= o["up_s"]:
        return _end(state)
    if row.get("track"):
        x, y = row["track"]
        start = state["track0"]
        if start is None:
            if math.hypot(x - state["x"], y - state["y"]) <= o["near_m"]:
                state["track0"] = [x, y, x, y, t]
        else:
            step, dt = math.hypot(x - start[2], y - start[3]), max(t - start[4], 1e-6)
            if step > o["step_m"] and step / dt > o["speed"]:
                state["track0"] = None  # a jump: it has to come near again
            elif math.hypot(x - start[0], y - start[1]) >= o["away_m"]:
                return _end(state)
            else:
                state["track0"] = [start[0], start[1], x, y, t]
    return None


def map_step(state: dict, row: dict, alpha: float = 0.02, window: int = 60) -> dict:
    """Slow and current energy map of a sensor: the slow one moves by ``alpha`` a frame, the current is the window's mean.

    row: cells {name: energy}. Gives the difference of the two.
    """
    slow = {k: v * (1 - alpha) for k, v in state.get("slow", {}).items()}
    for k, v in row["cells"].items():
        slow[k] = slow.get(k, 0.0) + alpha * v
    recent = [*state.get("recent", []), row["cells"]][-window:]
    state |= {"slow": {k: v for k, v in slow.items() if v > 1e-9}, "recent": recent}
    now: dict[str, float] = {}
    for cells in recent:
        for k, v in cells.items():
            now[k] = now.get(k, 0.0) + v / len(recent)
    return {"diff": {k: now.get(k, 0.0) - slow.get(k, 0.0) for k in {*now, *slow}}}


def clean_step(state: dict, row: dict, persist: int = 10, floor_frac_min: float = 0.7, confirm: float = 0.45, require_cube: bool = False) -> dict:
    """One frame's evidence fused to a fall, a suspicion or a collapse; only the trigger's run is kept.

    row: the columns of ``falls.cleaned``, any of them None.
    """
    trigger = bool(row.get("w_down")) or (row.get("falling_p") or 0.0) >= 0.5
    state["run"] = state.get("run", 0) + 1 if trigger else 0
    out = {"run": state["run"], "fall": False, "collapse": False, "suspected": False, "confidence": 0.0}
    sure = (0.5 if row.get("w_down") else 0.0) + (0.3 if (row.get("falling_p") or 0.0) >= 0.5 else 0.0)
    score = 0.0
    if row.get("extra"):

        def below(name: str, limit: float) -> bool:
            return row.get(name) is not None and row[name] < limit

        def least(name: str, limit: float) -> bool:
            return row.get(name) is not None and row[name] >= limit

        evidence = (
            (row.get("floor_fall"), 0.25), (row.get("lying_state"), 0.15), (least("cloud_below", floor_frac_min), 0.15), (below("cloud_z_med", 0.4), 0.1),
            (least("flat", 0.55), 0.1), (below("h_s", 0.4), 0.05), (least("track_floor", floor_frac_min), 0.05),
        )
        score = sum(worth for condition, worth in evidence if condition)
        sure = min(0.98, sure + score)
    cube = bool(row.get("cube"))
    if cube and (row.get("cube_floor_frac") or 0.0) < floor_frac_min:
        return out
    vital = bool(row.get("cube_rr")) or bool(row.get("cube_micro"))
    if cube:
        sure = min(0.98, sure + 0.4)
    if row.get("rest_spot"):
        sure *= 0.4
    confirmed = cube or (not require_cube and round(score, 9) >= confirm)
    fall = trigger and state["run"] >= persist and confirmed and sure >= 0.5
    return out | {"fall": fall, "collapse": fall and cube and not vital, "suspected": trigger and not fall, "confidence": round(sure, 2)}


def collapse_step(state: dict, row: dict, sustain: float = 12.0, quiet: float = 5.0) -> dict:
    """Collapse suspicion of one frame; signs of life are kept until nothing was down for more than ``quiet`` seconds.

    row: t, down, down_s, red, fallen, rr, micro, measured, as in ``falls.collapse``.
    """
    if state.get("down_t") is None or row["t"] - state["down_t"] > quiet:
        state |= {"had_rr": False, "living": False, "measured": False}
    state["had_rr"] |= bool(row["rr"])
    state["living"] |= bool(row["rr"] or row["micro"])
    state["measured"] |= bool(row["measured"])
    if row["down"]:
        state["down_t"] = row["t"]
    suspect = bool(row["red"] and row["down_s"] >= sustain and row["fallen"] and not state["living"])
    return {"had_rr": state["had_rr"], "living": state["living"], "measured_yet": state["measured"], "suspect": suspect, "confidence": ("strong" if state["measured"] else "weak") if suspect else None}
