"""Fall decisions from frames: heights, floor maps, triggers, evidence and episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import quantiles


def floor_map(points: DataFrame, keys: list[str], cell: float = 0.5, least: int = 8, q: float = 0.05) -> DataFrame:
    """Floor height (column hg) per floor cell: a low percentile of z where a cell has points enough.

    Cells are rounded half to even. The percentile is found by selection: a cell may hold months of points.
    """
    cells = points.withColumns({"fx": F.rint(F.col("x") / cell).cast("int"), "fy": F.rint(F.col("y") / cell).cast("int")})
    return quantiles(cells, [*keys, "fx", "fy"], "z", {"hg": q}).where(F.col("n") >= least).drop("n")


def floor_default(floor: DataFrame, keys: list[str]) -> DataFrame:
    """The height where no cell is known: the median of the known ones."""
    return floor.groupBy(*keys).agg(F.percentile("hg", 0.5).alias("hg_default"))


def above_floor(points: DataFrame, floor: DataFrame, keys: list[str], cell: float = 0.5) -> DataFrame:
    """Adds ``h``: height above the cell's floor, else above the default, else above 0."""
    cells = points.withColumns({"fx": F.rint(F.col("x") / cell).cast("int"), "fy": F.rint(F.col("y") / cell).cast("int")})
    joined = cells.join(floor, [*keys, "fx", "fy"], "left").join(floor_default(floor, keys), keys, "left")
    return joined.withColumn("h", F.col("z") - F.coalesce("hg", "hg_default", F.lit(0.0))).drop("fx", "fy", "hg", "hg_default")


def second_highest(points: DataFrame, keys: list[str], value: str = "z", least: int = 2) -> DataFrame:
    """The second highest value per key (column h_s), where there are ``least`` points or more."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value)))
    total = F.count("*").over(W.partitionBy(*keys))
    ranked = points.withColumns({"_at": place, "_n": total})
    return ranked.where((F.col("_at") == 2) & (F.col("_n") >= least)).select(*keys, F.col(value).alias("h_s"), F.col("_n").alias("n"))


def top_points(points: DataFrame, keys: list[str], k: int = 5, value: str = "z", order: str = "k") -> DataFrame:
    """The k highest points per key in ascending order (value, then ``order``), as an array ``top``."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), F.desc(order)))
    kept = points.withColumn("_at", place).where(F.col("_at") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(order).alias("o")))).alias("top"))


def _picker(i: int) -> Callable[[Column], Column]:
    return lambda row: F.element_at(row, i + 1)


def frame_windows(frames: DataFrame, keys: list[str], frame: str, features: list[str], size: int = 8, feature_major: bool = True) -> DataFrame:
    """``size`` consecutive frames as one vector; a gap in the frame numbers gives none.

    feature_major: all frames of the first feature, then of the next; else frame by frame.
    """
    window = W.partitionBy(*keys).orderBy(frame).rowsBetween(-(size - 1), 0)
    rows = F.collect_list(F.array(*features)).over(window)
    whole = frames.withColumns({"_rows": rows, "_first": F.min(frame).over(window)}).where((F.size("_rows") == size) & (F.col(frame) - F.col("_first") == size - 1))
    vector = F.flatten("_rows")
    if feature_major:
        vector = F.flatten(F.array(*(F.transform("_rows", _picker(i)) for i in range(len(features)))))
    return whole.select(*keys, frame, vector.alias("vector"))


def kinematics(centres: DataFrame, keys: list[str], frame: str, fps: float = 10.0, scale_acceleration: bool = True) -> DataFrame:
    """Velocity and acceleration of centroids (x, y, z); both are 0 after a gap in the frame numbers."""
    order = W.partitionBy(*keys).orderBy(frame)
    joined = F.col(frame) - F.lag(frame).over(order) == 1
    out = centres.withColumns({f"v{c}": F.when(joined, (F.col(c) - F.lag(c).over(order)) * fps).otherwise(0.0) for c in "xyz"})
    factor = fps if scale_acceleration else 1.0
    return out.withColumns({f"a{c}": F.when(joined, (F.col(f"v{c}") - F.lag(f"v{c}").over(order)) * factor).otherwise(0.0) for c in "xyz"})


def height_trend(frames: DataFrame, keys: list[str], ts: str, h: str, min_dt: float = 0.05) -> DataFrame:
    """Fastest descent (over steps of ``min_dt`` seconds or more) and range of height."""
    order = W.partitionBy(*keys).orderBy(ts)
    dt = F.col(ts) - F.lag(ts).over(order)
    slope = F.when(dt >= min_dt, (F.col(h) - F.lag(h).over(order)) / dt)
    return frames.withColumn("_s", slope).groupBy(*keys).agg(F.min("_s").alias("min_slope"), (F.max(h) - F.min(h)).alias("h_range"))


def auto_label(frames: DataFrame, keys: list[str], frame: str, h: str, v: str, size: int = 8, drop: float = -1.5, net: float = 0.30, stood: float = 0.60, sat: float = 0.15) -> DataFrame:
    """falling, stood, sat or lying from the last ``size`` frames: the fastest descent (speed ``v``), the net one, the height."""
    window = W.partitionBy(*keys).orderBy(frame).rowsBetween(-(size - 1), 0)
    rows = frames.withColumns({"_peak": F.min(v).over(window), "_net": F.first(h).over(window) - F.last(h).over(window), "_n": F.count(h).over(window)}).where(F.col("_n") == size)
    label = F.when((F.col("_peak") < drop) & (F.col("_net") > net), "falling").when(F.col(h) > stood, "stood").when(F.col(h) > sat, "sat").otherwise("lying")
    return rows.select(*keys, frame, label.alias("label"))


# Mean, scale, weight, what stands in for a null, and whether log(1 + x) is taken; then the bias.
LIE = {
    "hi2": (0.6200000000000001, 0.7666800084090608, -0.9829643762248325, 2.0, False),
    "floor_frac": (0.5624705882352941, 0.47229989446475495, 1.0161303869375549, 0.0, False),
    "micro": (6.565294117647059, 5.018890336280765, 0.2009435855096036, 0.0, False),
    "y_span": (0.4970000000000001, 0.33467701726045207, 0.5890826781478072, 0.0, False),
    "n": (6.103751424492684, 2.1752012345999066, -0.35882379443416196, 0.0, True),
}
LIE_BIAS = 0.5370608839809906


def lie_chance(weights: dict[str, tuple[float, float, float, float, bool]] | None = None, bias: float = LIE_BIAS) -> Column:
    """Logistic score of lying on the floor from a label window's features."""
    total = F.lit(bias)
    for name, (mean, scale, weight, instead, logged) in (weights or LIE).items():
        value = F.coalesce(F.col(name).cast("double"), F.lit(instead))
        total = total + ((F.log1p(value) if logged else value) - mean) / (scale or 1.0) * weight
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))


def flatness(sx: Column, sy: Column, sz: Column) -> Column:
    """How flat a cloud lies: 1 for no height against its larger side, 0 from 1.3 times as high as wide."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1.3 - sz / F.greatest(sx, sy, F.lit(0.05))) / 1.3))


def fall_fusion(falling_p: Column, down: Column, cloud_z: Column, below: Column, breathing: Column, flat: Column, floor_fall: Column, floor_z: float = 0.4) -> Column:
    """Fall probability from weighted evidence; the floor alone makes 0.6, and without breathing it counts 0.7."""

    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

    low = F.coalesce(unit((floor_z - cloud_z) / 0.7), F.lit(0.0))
    total = 0.22 * F.coalesce(falling_p, F.lit(0.0)) + F.when(down, 0.20).otherwise(0.0) + 0.22 * low + 0.18 * unit(below / 0.8) + 0.18 * flat
    return unit(F.when(floor_fall, F.greatest(total, F.lit(0.6))).otherwise(total)) * F.when(breathing, 1.0).otherwise(0.7)


def cube_verdict(rr: Column, strength: Column, motion_frac: Column, ratio: Column, frac: Column) -> Column:
    """Whether somebody lies there: true, false or (null) not measured."""
    return (
        F.when(rr.isNotNull() & (strength >= 0.3), True).when(motion_frac >= 0.5, True)
        .when(ratio.isNotNull(), ratio >= 0.4).when(frac.isNotNull(), False).otherwise(F.lit(None).cast("boolean"))
    )


def heart_trust(hr: Column, strength: Column, rr: Column) -> Column:
    """none, weak, harmonic (within 5 beats of a multiple of the breathing rate) or ok."""
    k = F.rint(hr / F.when(rr > 0, rr))
    near = F.coalesce((k >= 1) & (F.abs(hr - k * rr) <= 5), F.lit(False))
    return F.when(hr.isNull(), "none").when(F.coalesce(strength, F.lit(0.0)) < 0.30, "weak").when(near, "harmonic").otherwise("ok")


def label_class(text: Column) -> Column:
    """Class of a free-text label; the first rule that fits. English and Chinese words are fixed values."""
    t = F.lower(text)

    def has(*words: str) -> Column:
        found = t.contains(words[0])
        for w in words[1:]:
            found = found | t.contains(w)
        return found

    return (
        F.when(has("empty", "无人", "空"), "empty").when(has("half-kneel", "半跪", "kneel-halfside", "跪式半侧"), "boundary").when(has("curl-sidefall", "侧倒"), "collapse")
        .when(has("lie", "躺"), "lie").when(has("stand", "站", "sit", "坐"), "upright").otherwise("unknown")
    )


def label_target(name: Column) -> Column:
    """1 for lying and collapsed, 0 for upright and empty, -1 for what is not to be learned from."""
    return F.when(name.isin("lie", "collapse"), 1).when(name.isin("empty", "upright"), 0).otherwise(-1)


def cleaned(frames: DataFrame, keys: list[str], order: str, persist: int = 10, floor_frac_min: float = 0.7, confirm: float = 0.45, require_cube: bool = False) -> DataFrame:
    """Fall, suspected or collapse from all evidence of a frame; only the trigger's run looks back.

    frames: w_down, falling_p, cube (whether one was fetched), cube_rr, cube_micro, cube_floor_frac, rest_spot, extra
    (whether there is more evidence), floor_fall, lying_state, cloud_below, cloud_z_med, flat, h_s, track_floor.
    """
    from .islands import trigger_run

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    mlp = F.coalesce(F.col("falling_p") >= 0.5, F.lit(False))
    rows = trigger_run(frames.withColumn("trigger", on("w_down") | mlp), keys, [order], F.col("trigger"))
    base = F.when(on("w_down"), 0.5).otherwise(0.0) + F.when(mlp, 0.3).otherwise(0.0)
    evidence = (
        (on("floor_fall"), 0.25), (on("lying_state"), 0.15), (F.col("cloud_below") >= floor_frac_min, 0.15), (F.col("cloud_z_med") < 0.4, 0.1),
        (F.col("flat") >= 0.55, 0.1), (F.col("h_s") < 0.4, 0.05), (F.col("track_floor") >= floor_frac_min, 0.05),
    )
    score = F.lit(0.0)
    for condition, worth in evidence:
        score = score + F.when(on("extra") & F.coalesce(condition, F.lit(False)), worth).otherwise(0.0)
    cube = on("cube")
    body = F.coalesce(F.col("cube_floor_frac"), F.lit(0.0)) >= floor_frac_min
    first = F.when(on("extra"), F.least(F.lit(0.98), base + F.col("_score"))).otherwise(base)
    second = F.when(cube, F.least(F.lit(0.98), first + 0.4)).otherwise(first)
    third = F.when(on("rest_spot"), second * 0.4).otherwise(second)
    confirmed = F.when(cube, F.lit(True)).otherwise(F.lit(not require_cube) & (F.round("_score", 9) >= confirm))
    fall = F.col("trigger") & (F.col("run") >= persist) & confirmed & (F.col("_conf") >= 0.5)
    rejected = cube & ~body
    vital = (F.coalesce(F.col("cube_rr"), F.lit(0.0)) != 0) | on("cube_micro")
    done = rows.withColumn("_score", score).withColumn("_conf", third).withColumn("fall", ~rejected & fall)
    return done.withColumns({
        "collapse": F.col("fall") & cube & ~vital, "suspected": ~rejected & F.col("trigger") & ~F.col("fall"), "confidence": F.when(rejected, 0.0).otherwise(F.round("_conf", 2)),
    }).drop("_score", "_conf")


def collapse(frames: DataFrame, keys: list[str], ts: str, sustain: float = 12.0, quiet: float = 5.0) -> DataFrame:
    """Collapse suspicion: a red fall that lasts, with a body on the floor and no sign of life since its episode began.

    frames: down, down_s (seconds down so far), red, fallen (geometry of a body on the floor), rr, micro, measured. An
    episode ends when nothing is down for more than ``quiet`` seconds. Adds had_rr, living and measured_yet (told at
    any time of the episode so far), suspect and confidence: strong if the chest was measured and silent, else weak.
    """
    own = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.last(F.when(F.col("down"), F.col(ts)), ignorenulls=True).over(W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, -1))
    marked = frames.withColumn("_new", (last.isNull() | (F.col(ts) - last > quiet)).cast("int")).withColumn("_episode", F.sum("_new").over(own))
    so_far = W.partitionBy(*keys, "_episode").orderBy(ts).rowsBetween(W.unboundedPreceding, W.currentRow)

    def ever(c: Column) -> Column:
        return F.coalesce(F.max(c.cast("int")).over(so_far), F.lit(0)) == 1

    told = marked.withColumns({"had_rr": ever(F.col("rr")), "living": ever(F.col("rr") | F.col("micro")), "measured_yet": ever(F.col("measured"))})
    suspect = F.col("red") & (F.col("down_s") >= sustain) & F.col("fallen") & ~F.col("living")
    return told.drop("_new", "_episode").withColumn("suspect", suspect).withColumn("confidence", F.when(F.col("suspect"), F.when(F.col("measured_yet"), "strong").otherwise("weak")))


def descent(frames: DataFrame, keys: list[str], ts: str, h: str, upright: float = 1.0, floor: float = 0.4, tie: str | None = None) -> DataFrame:
    """Last upright moment before the first one on the floor, the seconds between, the rate, and the share that stays down.

    tie: of the frames of one moment, the one with the smallest ``tie`` gives the height; without it any of them may.
    """
    first_of = -F.col(tie) if tie else F.lit(0)
    first = frames.where(F.col(h) <= floor).groupBy(*keys).agg(F.min(ts).alias("t_floor"))
    joined = frames.join(first, keys)
    up = (F.col(h) >= upright) & (F.col(ts) < F.col("t_floor"))
    found = joined.groupBy(*keys, "t_floor").agg(
        F.max(F.when(up, F.col(ts))).alias("t_up"), F.max_by(h, F.when(up, F.struct(ts, first_of))).alias("h_up"), F.max_by(h, F.when((F.col(ts) == F.col("t_floor")) & F.col(h).isNotNull(), F.struct(first_of))).alias("h_floor"),
        F.avg(F.when(F.col(ts) >= F.col("t_floor"), (F.col(h) <= floor).cast("double"))).alias("stay_down"),
    )
    seconds = F.col("t_floor") - F.col("t_up")
    return found.withColumns({"seconds": seconds, "rate": F.when(seconds > 0, (F.col("h_up") - F.col("h_floor")) / seconds)})


def blackouts(frames: DataFrame, keys: list[str], frame: str, points: Column, has_cube: Column, least: int = 20, ties: list[str] | None = None) -> DataFrame:
    """Runs of frames with fewer than 3 cloud points but a cube, ``least`` frames or longer; ``ties`` orders those of equal ``frame``."""
    from .islands import episodes

    return episodes(frames, keys, frame, (points < 3) & has_cube, ties=ties).where(F.col("n") >= least)


def dwell(frames: DataFrame, keys: list[str], state: str, ts: str) -> DataFrame:
    """Frames and first time of each state."""
    return frames.groupBy(*keys, state).agg(F.count("*").alias("n"), F.min(ts).alias("first"))


def cell_trigger(points: DataFrame, keys: list[str], ts: str, cell: float = 0.5, least: int = 6, top: float = 0.4, confirm: float = 0.6, clear: float = 0.5) -> DataFrame:
    """BURST and STOP of floor cells by range: a cell is low when its second highest point is under ``top``.

    points: keys, ts, wy (ground range), wz (height), one row per point of a frame. A low spell ends with a high
    frame of the cell or ``clear`` seconds without a low one; a burst comes once a spell is ``confirm`` seconds old.
    The stop of a spell that runs out is given at its end, by time alone.
    """
    per = second_highest(points.withColumn("cell", (F.col("wy") / cell).cast("int")), [*keys, "cell", ts], "wz", least)
    order = W.partitionBy(*keys, "cell").orderBy(ts)
    rows = per.withColumn("low", F.col("h_s") <= top)
    before = F.lag(F.struct("low", ts)).over(order)
    starts = F.col("low") & (before.isNull() | ~before["low"] | (F.col(ts) - before[ts] > clear))
    spelled = rows.withColumn("spell", F.sum(starts.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).where("low")
    per_spell = spelled.withColumn("_since", F.min(ts).over(W.partitionBy(*keys, "cell", "spell")))
    late = F.when(F.col(ts) - F.col("_since") >= confirm, F.col(ts))
    found = per_spell.groupBy(*keys, "cell", "spell").agg(F.min(late).alias("burst"), F.max(ts).alias("last_low")).where("burst IS NOT NULL")
    return found.select(*keys, "cell", (F.col("cell") * cell + cell / 2).alias("range_m"), "burst", "last_low")


def ghost_probe(points: DataFrame, keys: list[str], frame: str, frames: int = 8, k: int = 5) -> DataFrame:
    """What tells a mirror ghost from a body, over the last ``frames`` frames of a track.

    Per frame: spread of the k highest points, spread of doppler, whether it has both signs, the centroid; then the
    means over the frames, the centroid's wander and the heights' spread.
    """
    place = F.row_number().over(W.partitionBy(*keys, frame).orderBy(F.desc("z"), "x"))
    ranked = points.withColumn("_at", place)
    top = F.when(F.col("_at") <= k, F.col("z"))
    per = ranked.groupBy(*keys, frame).agg(F.stddev_pop(top).alias("top_spread"), F.stddev_pop("doppler").alias("dop_std"), ((F.max("doppler") > 0) & (F.min("doppler") < 0)).cast("double").alias("bipolar"), F.avg("x").alias("cx"), F.avg("z").alias("cz"))
    window = W.partitionBy(*keys).orderBy(frame).rowsBetween(-(frames - 1), 0)
    return per.select(*keys, frame, *(F.avg(c).over(window).alias(c) for c in ("top_spread", "dop_std", "bipolar")), F.stddev_pop("cx").over(window).alias("wander"), F.stddev_pop("cz").over(window).alias("z_spread"))
