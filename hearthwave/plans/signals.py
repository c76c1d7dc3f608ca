"""Vitals, directions, ordered jobs and models over the stand-in tables. Most have no SQL form; the tests hold them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..helpers.angles import BOARD_AZ, BOARD_EL
from ..operators import baseline as b
from ..operators import clusters as cl
from ..operators import directions as dr
from ..operators import features as ft
from ..operators import geometry as g
from ..operators import mldata as ml
from ..operators import moments as m
from ..operators import scene as sc
from ..operators import vitals as v
from ..operators import voxels as vx
from ..operators.evaluation import rate_vote, trimmed_mean
from ..sources import frames as wire
from ..streaming import jobs, steps
from .arrays import COV, against_first
from .drift import VAR, _mags
from .motion import ON_EVENTS
from .registry import query
from .standins import ANTENNAS, EVENTS, FRAMES, POINTS, events, frames, points, snapshots

BIN = ["capture_id", "range_bin"]


def _slow_time(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots as three bins of one capture per four sensors, 50 frames a second."""
    return snapshots(spark, d).select((F.col("capture_id") % 2).alias("capture_id"), (F.col("range_bin") % 3 + 100).alias("range_bin"), (F.col("snap") * 0.02).alias("ts"), "re", "im")


@query()
def vitals_windows(spark: SparkSession, d: str) -> DataFrame:
    return v.vitals(_slow_time(spark, d), ["capture_id"], 10.0, 5.0)


@query()
def rhythm_alerts(spark: SparkSession, d: str) -> DataFrame:
    return v.rhythm_alerts(_slow_time(spark, d), ["capture_id"], 10.0, 5.0)


@query(f"""{EVENTS}, b AS (SELECT user_id, floor(k / 5.0) AS bar, sum(value) AS w FROM ev GROUP BY ALL) SELECT user_id, R((arg_max(bar, (w, -bar)) + 0.5) * 5.0) AS mode, R(max(w)) AS weight FROM b GROUP BY user_id""", 3)
def rate_mode(spark: SparkSession, d: str) -> DataFrame:
    return rate_vote(events(spark, d), ["user_id"], "k", "value", 5.0)


@query(f"""{EVENTS}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value) AS at_, count(*) OVER (PARTITION BY user_id) AS n FROM ev), c AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE greatest(1, n // 4) END AS cut FROM p) SELECT user_id, R(avg(value)) AS trimmed FROM c WHERE at_ > cut AND at_ <= n - cut GROUP BY user_id""")
def trimmed_rate(spark: SparkSession, d: str) -> DataFrame:
    return trimmed_mean(events(spark, d), ["user_id"], "value")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    cov = m.covariances(snapshots(spark, d), BIN)
    return dr.matrices(cov.withColumn("range_bin", F.col("range_bin") + 100), BIN)


@query()
def doa_points(spark: SparkSession, d: str) -> DataFrame:
    return dr.doa_points(_packed(spark, d), BIN)


def _beams(spark: SparkSession, d: str) -> DataFrame:
    return dr.beam_cells(_packed(spark, d), BIN, tuple(range(-40, 41, 10)), tuple(range(-40, 21, 20)))


def _beam_sql() -> str:
    """Beam power of each covariance in each direction of ``_beams``, from the antennas' places on the board."""
    board = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(zip(BOARD_AZ, BOARD_EL, strict=True)))
    return f"""{COV}, board AS (SELECT * FROM (VALUES {board}) AS t(a, at_az, at_el)), dirs AS (SELECT az::DOUBLE AS az, el::DOUBLE AS el FROM (SELECT unnest(range(-40, 41, 10)) AS az), (SELECT unnest(range(-40, 21, 20)) AS el)),
phase AS (SELECT az, el, a, pi() * (at_az * sin(radians(az)) * cos(radians(el)) + at_el * sin(radians(el))) AS f FROM dirs, board),
beams AS (SELECT capture_id, range_bin + 100 AS range_bin, p.az, p.el, sum(c.re * cos(q.f - p.f) - c.im * sin(q.f - p.f)) AS power FROM cov c JOIN phase p ON p.a = c.i JOIN phase q ON q.a = c.j AND q.az = p.az AND q.el = p.el GROUP BY ALL),
room AS (SELECT *, r * cos(e) * sin(a) AS x, r * cos(e) * cos(a) * cos(t) + r * sin(e) * sin(t) AS y, -r * cos(e) * cos(a) * sin(t) + r * sin(e) * cos(t) + 2.0 AS z FROM (SELECT *, range_bin * 0.0234375 AS r, radians(az) AS a, radians(el) AS e, radians(25.0) AS t FROM beams))"""


BEAMS = _beam_sql()


@query(f"""{BEAMS}, per AS (SELECT capture_id, range_bin, sum(CASE WHEN z <= 0.4 THEN greatest(power, 0) ELSE 0 END) AS floor, sum(greatest(power, 0)) AS total FROM room GROUP BY ALL)
SELECT capture_id, R(sum(floor)) AS floor, R(sum(floor) / greatest(sum(total), 1e-12)) AS floor_frac, arg_max(range_bin, (floor, -range_bin)) AS peak_bin FROM per GROUP BY capture_id""")
def floor_energy(spark: SparkSession, d: str) -> DataFrame:
    return dr.floor_energy(_beams(spark, d), ["capture_id"])


@query(f"""{BEAMS}, v AS (SELECT capture_id, least(trunc((x + 3.0) / 0.3)::INT, 19) AS ix, least(trunc(y / 0.3)::INT, 22) AS iy, least(trunc((z + 0.1) / 0.3)::INT, 8) AS iz, sum(power) AS e FROM room WHERE x >= -3.0 AND x < 3.0 AND y >= 0.0 AND y < 7.0 AND z >= -0.1 AND z < 2.5 GROUP BY ALL), s AS (SELECT *, sum(e) OVER (PARTITION BY capture_id) AS total FROM v)
SELECT capture_id, ix, iy, iz, R(CASE WHEN total > 0 THEN e / total ELSE e END) AS e FROM s""")
def energy_volume(spark: SparkSession, d: str) -> DataFrame:
    return dr.energy_volume(_beams(spark, d), ["capture_id"])


@query(f"""{BEAMS} SELECT a.capture_id, a.range_bin, R(avg(least(a.power, b.power))) AS floor_level, R(avg(abs(a.power - b.power) / 2)) AS object_level FROM beams a JOIN beams b ON a.capture_id = b.capture_id AND a.range_bin = b.range_bin AND a.el = b.el AND a.az = -b.az GROUP BY ALL""")
def symmetry_levels(spark: SparkSession, d: str) -> DataFrame:
    return dr.symmetry_levels(_beams(spark, d), BIN)


@query(f"""{BEAMS}, bins AS (SELECT capture_id, range_bin, lag(range_bin) OVER (PARTITION BY capture_id ORDER BY range_bin) AS prev FROM (SELECT DISTINCT capture_id, range_bin FROM beams)),
t AS (SELECT n.capture_id, n.range_bin, 1 - sum(a.power * b.power) / greatest(sqrt(sum(a.power ** 2)) * sqrt(sum(b.power ** 2)), 1e-12) AS turn FROM bins n JOIN beams a ON a.capture_id = n.capture_id AND a.range_bin = n.range_bin JOIN beams b ON b.capture_id = n.capture_id AND b.range_bin = n.prev AND b.az = a.az AND b.el = a.el GROUP BY ALL)
SELECT capture_id, range_bin, R(turn) AS turn, turn >= 0.2 AS edge FROM t""")
def spectrum_edges(spark: SparkSession, d: str) -> DataFrame:
    return dr.edges(_beams(spark, d), ["capture_id"])


@query(f"{ON_EVENTS}, e AS (SELECT *, CASE WHEN low AND pos = 3 THEN 1 WHEN NOT low AND pos = 3 THEN 0 END AS e FROM q) SELECT user_id, t, event_id, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS down FROM e")
def latch_steps(spark: SparkSession, d: str) -> DataFrame:
    """The stream's step function over whole tables; the SQL is that of the windowed form."""
    rows = events(spark, d).select("user_id", "t", "event_id", F.when(F.col("value") < 60, 0.1).otherwise(1.0).alias("h_s"))
    return jobs.in_batch(rows, ["user_id"], ["t", "event_id"], lambda s, r: steps.latch_step(s, r, 3, 3), "user_id long, t long, event_id long, down boolean")


@query()
def floor_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Identities of floor clusters: tracks are one kind of points, clusters another."""
    p = points(spark, d).withColumns({"sensor_id": F.col("capture_id") % 5, "t": (F.col("frame") % 300) * 0.1})
    spots = p.groupBy("sensor_id", "t", "k").agg(F.avg(F.when(F.col("scan") == "N", F.col("x"))).alias("tx"), F.avg(F.when(F.col("scan") == "N", F.col("y"))).alias("ty"), F.avg(F.when(F.col("scan") == "R", F.col("x"))).alias("cx"), F.avg(F.when(F.col("scan") == "R", F.col("y"))).alias("cy"), F.count("*").alias("n"))
    packed = spots.groupBy("sensor_id", "t").agg(
        F.sort_array(F.collect_list(F.when(F.col("tx").isNotNull() & (F.col("k") < 3), F.array(F.col("k").cast("double"), "tx", "ty")))).alias("tracks"),
        F.sort_array(F.collect_list(F.when(F.col("cx").isNotNull(), F.array("cx", "cy", F.col("n").cast("double"))))).alias("clusters"),
    )

    def step(state: dict, row: dict) -> list[dict]:
        found = steps.floor_step(state, {"t": row["t"], "tracks": [tuple(x) for x in row["tracks"]], "clusters": [tuple(x) for x in row["clusters"]]})
        return [{k: f[k] for k in ("id", "x", "y", "seen", "age", "source", "person")} for f in found]

    return jobs.in_batch(packed, ["sensor_id"], ["t"], step, "sensor_id long, t double, id long, x double, y double, seen long, age long, source string, person boolean")


@query()
def fall_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The episode machine over each user's events as frames a second apart."""
    rows = events(spark, d).select("user_id", F.col("t").cast("double").alias("t"), "event_id", F.col("value").alias("v"), "event_type", "k")

    def step(state: dict, row: dict) -> dict:
        state["clock"] = state.get("clock", 0.0) + 1.0
        k = row["k"]
        frame = {
            "t": state["clock"], "down": row["v"] < 80, "x": k % 5 * 0.2, "y": 3.0 + k % 3 * 0.1, "bin": 100 + k % 15, "upright": [(k % 7 * 0.2, 3.0)] if row["event_type"] == "signup" else [], "stands": k % 11 == 0,
            "cloud_z": None if k % 6 == 0 else k % 10 * 0.08, "cleaned": k % 37 == 0, "track": (k % 9 * 0.3, 3.0 + k % 4 * 0.4) if k % 2 else None,
        }
        frame["answer"] = (state.get("epoch", 0), 100 + k % 20, k % 3 == 0 if k % 4 else None) if row["event_type"] == "view" else None
        got = steps.episode_step(state, frame, ask_s=6.0, open_s=3.0)
        return {k: got[k] for k in ("phase", "red", "event", "ask", "events")}

    return jobs.in_batch(rows, ["user_id"], ["t", "event_id"], step, "user_id long, t double, event_id long, phase string, red boolean, event boolean, ask long, events long")


@query(f"{POINTS} SELECT capture_id::VARCHAR AS path, frame, R(x::FLOAT) AS x, R(y::FLOAT) AS y, R(z::FLOAT) AS z, R(doppler::FLOAT) AS doppler FROM points", 5)
def decoded_points(spark: SparkSession, d: str) -> DataFrame:
    """Points written as frame blobs and read back by the decoder."""

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            capture, frame, *values = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((frame, capture))
            capture, frame, values = capture[order], frame[order], np.column_stack(values)[order]
            first = np.flatnonzero(np.r_[True, (capture[1:] != capture[:-1]) | (frame[1:] != frame[:-1])]) if len(order) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(capture[first]).cast(pa.string()), wire.point_blobs(frame[first], first, values)], names=["path", "content"])

    blobs = points(spark, d).select("capture_id", "frame", "x", "y", "z", "doppler").mapInArrow(encode, "path string, content binary")
    return wire.table(wire.decode_blobs(blobs), "point", ["x", "y", "z", "doppler"])


@query()
def fusion_auc(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select((F.col("user_id") % 4).alias("recording"), F.col("value"), F.col("k").cast("double").alias("k"), (F.col("value") + F.col("k") < 90).cast("int").alias("label"))
    return ml.leave_one_out(rows, ["value", "k"], "recording")


@query()
def posture_folds(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select((F.col("user_id") % 20).alias("file"), F.array(F.col("value") / 500, F.col("k") / 100.0).alias("vector"), (F.col("k") > 50).cast("int").alias("label"))
    return ml.posture_model(rows, [2, 4, 2], folds=3, iterations=30)


def _weights() -> list[tuple[np.ndarray, np.ndarray]]:
    e = np.random.default_rng(7)
    return [(e.normal(size=(4, 8)), np.zeros(8)), (e.normal(size=(8, 3)), np.zeros(3))]


def _perceptron_sql() -> str:
    (first, _), (second, _) = _weights()
    hidden = ", ".join("greatest(0, " + " + ".join(f"{n} * {w!r}::DOUBLE" for n, w in zip(("x", "y", "z", "doppler"), map(float, column), strict=True)) + f") AS h{j}" for j, column in enumerate(first.T))
    out = ", ".join(" + ".join(f"h{j} * {float(w)!r}::DOUBLE" for j, w in enumerate(column)) + f" AS o{i}" for i, column in enumerate(second.T))
    most = "greatest(o0, o1, o2)"
    total = " + ".join(f"exp(o{i} - {most})" for i in range(3))
    chances = ", ".join(f"R(exp(o{i} - {most}) / ({total})) AS p{i}" for i in range(3))
    return f"{POINTS}, h AS (SELECT capture_id, frame, k, {hidden} FROM points), o AS (SELECT capture_id, frame, k, {out} FROM h) SELECT capture_id, frame, k, {chances} FROM o"


@query(_perceptron_sql())
def perceptron_chances(spark: SparkSession, d: str) -> DataFrame:
    weights = _weights()
    rows = points(spark, d).select("capture_id", "frame", "k", F.array("x", "y", "z", "doppler").alias("vector"))
    found = ml.apply_perceptron(rows, weights, ["capture_id", "frame", "k"])
    return found.select("capture_id", "frame", "k", *(F.col("chances")[i].alias(f"p{i}") for i in range(3)))


@query()
def body_parts(spark: SparkSession, d: str) -> DataFrame:
    return ft.per_bin(_slow_time(spark, d), ["capture_id"], ft.body_parts, ft.PARTS, 10.0, 10.0)


@query()
def bin_liveness(spark: SparkSession, d: str) -> DataFrame:
    return ft.per_bin(_slow_time(spark, d), ["capture_id"], ft.liveness, ft.LIVE, 10.0, 10.0)


@query()
def burst_states(spark: SparkSession, d: str) -> DataFrame:
    return ft.per_bin(_slow_time(spark, d), ["capture_id"], ft.burst_state, ft.BURST, 10.0, 10.0)


@query()
def spectrograms(spark: SparkSession, d: str) -> DataFrame:
    return ft.spectrogram_table(_slow_time(spark, d), ["capture_id"], 64, 32)


@query(f"""{POINTS}, p AS (SELECT capture_id % 20 AS label_id, frame % 7 AS frame, x, y AS wy, z AS wz, capture_id % 6 * 1.0::DOUBLE AS bin_m FROM points), m AS (SELECT *, abs(wy - bin_m) < 0.5 AS near FROM p),
e AS (SELECT label_id, count(*) FILTER (near) >= 4 AS enough, count(*) AS n_all FROM m GROUP BY ALL), u AS (SELECT m.* FROM m JOIN e USING (label_id) WHERE (near OR NOT enough) AND n_all >= 4), c AS (SELECT label_id, stddev_pop(c) AS micro FROM (SELECT label_id, frame, count(*) AS c FROM u GROUP BY ALL) GROUP BY label_id)
SELECT label_id, count(*) AS n, R(quantile_cont(wz, 0.9)) AS hi2, R(quantile_cont(wz, 0.5)) AS med, R(avg((wz < 0.4)::INT)) AS floor_frac, R(max(x) - min(x)) AS x_span, R(max(wy) - min(wy)) AS y_span, R((max(wz) - min(wz)) / greatest(max(x) - min(x), 0.1)) AS flat, R(any_value(micro)) AS micro FROM u JOIN c USING (label_id) GROUP BY label_id""")
def label_cloud_features(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select((F.col("capture_id") % 20).alias("label_id"), (F.col("frame") % 7).alias("frame"), "x", F.col("y").alias("wy"), F.col("z").alias("wz"), ((F.col("capture_id") % 6) * 1.0).alias("bin_m"))
    return ft.cloud_features(p, ["label_id"], "bin_m")


@query(f"""{POINTS}, p AS (SELECT capture_id % 20 AS label_id, (frame % 50) * 0.1::DOUBLE AS ts, y AS wy, z AS wz FROM points), r AS (SELECT label_id, ts, median(wz) AS h FROM p WHERE abs(wy - 3.0) < 0.6 GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT *, (h - lag(h) OVER w) / greatest(ts - lag(ts) OVER w, 0.05) AS s FROM r WINDOW w AS (PARTITION BY label_id ORDER BY ts))
SELECT label_id, R(CASE WHEN count(*) >= 3 THEN min(s) END) AS drop_rate, R(CASE WHEN count(*) >= 3 THEN max(h) - min(h) END) AS h_range, count(*) AS n_traj FROM s GROUP BY label_id""")
def label_height_features(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select((F.col("capture_id") % 20).alias("label_id"), ((F.col("frame") % 50) * 0.1).alias("ts"), F.col("y").alias("wy"), F.col("z").alias("wz"), F.lit(3.0).alias("bin_m"))
    return ft.height_features(p, ["label_id"], "ts", "bin_m")


def _covs(spark: SparkSession, d: str, **options) -> DataFrame:
    return m.covariances(snapshots(spark, d), BIN, **options)


@query(f"{COV}, ok AS (SELECT * FROM cov WHERE capture_id <> 2 OR abs(range_bin - 4) > 3) SELECT range_bin, i, j, R(avg(re)) AS re, R(avg(im)) AS im, count(DISTINCT capture_id) AS captures FROM ok GROUP BY range_bin, i, j")
def accumulated_covariance(spark: SparkSession, d: str) -> DataFrame:
    cells = _covs(spark, d).withColumn("sensor_id", F.lit(0))
    persons = cells.where("capture_id = 2").select("sensor_id", "capture_id", F.lit(4).alias("person_bin")).distinct()
    return sc.accumulated(cells, persons, ["sensor_id"]).drop("sensor_id")


@query(f"""{COV}, mean AS (SELECT capture_id, range_bin, a AS i, avg(re) AS mr, avg(im) AS mi FROM ant GROUP BY ALL), fl AS (SELECT c.capture_id, c.range_bin, c.i, c.j, re - p.mr * q.mr - p.mi * q.mi AS re, im - p.mi * q.mr + p.mr * q.mi AS im FROM cov c JOIN mean p ON p.capture_id = c.capture_id AND p.range_bin = c.range_bin AND p.i = c.i JOIN mean q ON q.capture_id = c.capture_id AND q.range_bin = c.range_bin AND q.i = c.j),
v AS (SELECT capture_id, range_bin, sum(re) AS v FROM fl WHERE i = j GROUP BY ALL), own AS (SELECT a.capture_id, a.range_bin, greatest(0, a.v - coalesce(b.v, 0)) AS v FROM v a LEFT JOIN v b ON b.capture_id = 3 AND a.range_bin = b.range_bin WHERE a.capture_id <> 3), kept AS (SELECT capture_id, range_bin FROM own QUALIFY v >= 0.15 * max(v) OVER (PARTITION BY capture_id))
SELECT f.capture_id, f.range_bin, f.i, f.j, R(f.re - coalesce(b.re, 0)) AS re, R(f.im - coalesce(b.im, 0)) AS im FROM fl f SEMI JOIN kept USING (capture_id, range_bin) LEFT JOIN fl b ON b.capture_id = 3 AND b.range_bin = f.range_bin AND b.i = f.i AND b.j = f.j""")
def motion_source(spark: SparkSession, d: str) -> DataFrame:
    cells = _covs(spark, d, fluctuation=True)
    return sc.motion_source(cells.where("capture_id <> 3"), cells.where("capture_id = 3").drop("capture_id"), [], captures=["capture_id"])


@query()
def changed_points(spark: SparkSession, d: str) -> DataFrame:
    """Every capture against the first; the beams have no SQL form."""
    base, event = against_first(_covs(spark, d).withColumn("range_bin", F.col("range_bin") + 100))
    return sc.changed_points(base, event, [], captures=["capture_id"])


def _energy_boxes(spark: SparkSession, d: str) -> DataFrame:
    grid = points(spark, d).groupBy((F.col("capture_id") % 5).alias("capture_id"), F.floor(F.col("x") / 0.1).cast("int").alias("ix"), F.floor(F.col("y") / 0.1).cast("int").alias("iy")).agg(F.sum("power").alias("power"))
    return sc.energy_boxes(grid, ["capture_id"])


@query(f"""{POINTS}, grid AS (SELECT capture_id % 5 AS capture_id, floor(x / 0.1)::INT AS ix, floor(y / 0.1)::INT AS iy, floor(floor(x / 0.1) / 5)::INT AS bx, floor(floor(y / 0.1) / 5)::INT AS by_, sum(power) AS power FROM points GROUP BY ALL HAVING sum(power) > 0), b AS (SELECT capture_id, bx, by_, sum(power) AS block FROM grid GROUP BY ALL),
kept AS (SELECT capture_id, bx, by_ FROM b QUALIFY coalesce(sum(block) OVER (PARTITION BY capture_id ORDER BY block DESC, bx, by_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.7 * sum(block) OVER (PARTITION BY capture_id)),
inside AS (SELECT g.* FROM grid g SEMI JOIN kept USING (capture_id, bx, by_) QUALIFY coalesce(sum(power) OVER (PARTITION BY capture_id, bx, by_ ORDER BY power DESC, ix, iy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.7 * sum(power) OVER (PARTITION BY capture_id, bx, by_))
SELECT capture_id, R(min(ix) * 0.1) AS x0, R(min(iy) * 0.1) AS y0, R((max(ix) - min(ix) + 1) * 0.1) AS sx, R((max(iy) - min(iy) + 1) * 0.1) AS sy, R(sum(power)) AS energy FROM inside GROUP BY capture_id, bx, by_""", 3)
def energy_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The boxes before any are joined."""
    return _energy_boxes(spark, d)


@query()
def energy_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Joined in the order of the pairs that touch, which SQL can't follow; the boxes before are in ``energy_blocks``."""
    return sc.merged(_energy_boxes(spark, d), ["capture_id"], gap=0.0)


@query(f"""WITH {VAR}, v AS (SELECT sensor_id, range_bin, var_pop(mag * 70) AS var FROM f GROUP BY ALL), t AS (SELECT *, CASE WHEN var >= 24000 THEN 2 WHEN var >= 100 AND var >= 6 * 3500 THEN 1 ELSE 0 END AS tier FROM v WHERE range_bin BETWEEN 4 AND 74), p AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS pos FROM t),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS grp FROM p WHERE tier > 0), bands AS (SELECT sensor_id, max(range_bin) + 1 - min(range_bin) AS w, max(tier) AS tier FROM g GROUP BY sensor_id, grp HAVING min(range_bin) < 74), per AS (SELECT sensor_id, sum(w) AS w, coalesce(sum(w) FILTER (tier = 1), 0) AS weak FROM bands GROUP BY sensor_id),
s AS (SELECT sensor_id, sum(var) AS total, coalesce(any_value(per.w), 0) AS w, coalesce(any_value(per.weak), 0) AS weak FROM v LEFT JOIN per USING (sensor_id) GROUP BY sensor_id),
u AS (SELECT *, CASE WHEN total >= 40000 THEN 0.5 ELSE 0 END + CASE WHEN w >= 5 THEN 0.5 ELSE 0 END AS up, CASE WHEN total < 40000 AND total <= 35000 THEN 0.5 ELSE 0 END + CASE WHEN w > 0 AND w < 5 AND w <= 4 THEN 0.5 ELSE 0 END + CASE WHEN weak > 0 AND total < 35000 THEN 0.3 ELSE 0 END AS down FROM s)
SELECT sensor_id, R(total) AS total, CASE WHEN total < 3000 AND w = 0 THEN 'absent' WHEN up > down THEN 'standing' WHEN down > up THEN 'lying' ELSE 'unknown' END AS posture, R(CASE WHEN total < 3000 AND w = 0 THEN 0.8 WHEN up = down THEN 0 ELSE least(greatest(up, down), 1) END) AS score FROM u""", 4)
def posture_scores(spark: SparkSession, d: str) -> DataFrame:
    var = _mags(spark, d).groupBy("sensor_id", "range_bin").agg(F.var_pop(F.col("mag") * 70).alias("var")).withColumn("cal", F.lit(3500.0))
    return ft.posture_score(b.presence_bands(var, ["sensor_id"], strong=24000.0, ratio=6.0), var.groupBy("sensor_id").agg(F.sum("var").alias("total")), ["sensor_id"])


@query()
def window_states(spark: SparkSession, d: str) -> DataFrame:
    """The whole state of each window: breathing, heart, posture and target."""
    told = ft.window_states(_slow_time(spark, d), ["capture_id"], 10.0, 10.0)
    return told.select("capture_id", "start", "present", "range_m", "body_um", "reflection", "pause_s", "quality", "breathing", "rr", "hr", "trust", "hr_apart", "pose", "tx", "ty", "tz", "target_m")


@query()
def respiration_patterns(spark: SparkSession, d: str) -> DataFrame:
    return ft.respiration(_slow_time(spark, d), ["capture_id"], 30.0, 30.0)[1]


@query()
def moving_postures(spark: SparkSession, d: str) -> DataFrame:
    on = ["capture_id", "start"]
    return ft.motion_pose(ft.moving_points(ft.moving(_slow_time(spark, d), ["capture_id"], 10.0, 10.0), on), on)


@query()
def label_cubes(spark: SparkSession, d: str) -> DataFrame:
    """Cube features of label windows."""
    return ft.per_bin(_slow_time(spark, d), ["capture_id"], ft.cube_feature, ft.CUBE, 10.0, 10.0)


@query()
def refined_angles(spark: SparkSession, d: str) -> DataFrame:
    """The direction of every snapshot, searched around the middle one."""
    from ..operators.selection import refined_angles as refined

    rows = snapshots(spark, d).withColumns({"az": F.lit(0.0), "el": F.lit(0.0)})
    return refined(rows, ["capture_id", "snap"], step=2.5)


FLOOR_LINE = "line AS (SELECT capture_id, regr_slope(level, lr) AS slope, regr_intercept(level, lr) AS intercept FROM (SELECT capture_id, log10(range_bin * 0.0234375) AS lr, 10 * log10(greatest(power, 1e-12)) AS level FROM beams) GROUP BY ALL)"


@query(f"""{BEAMS}, {FLOOR_LINE}, x AS (SELECT capture_id, range_bin, az, sum(power) AS power FROM beams WHERE el = 0 GROUP BY ALL), e AS (SELECT x.*, 10 * log10(greatest(power, 1e-12)) - slope * log10(range_bin * 0.0234375) - intercept AS excess FROM x JOIN line USING (capture_id)), p AS (SELECT *, row_number() OVER w AS pos FROM e WINDOW w AS (PARTITION BY capture_id, range_bin ORDER BY az)),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY capture_id, range_bin ORDER BY az) AS run FROM p WHERE excess >= 1.0) SELECT capture_id, range_bin, arg_max(az, (excess, -az)) AS az, R(max(excess)) AS excess, R(sum(power)) AS energy FROM h GROUP BY capture_id, range_bin, run""", 5)
def floor_objects(spark: SparkSession, d: str) -> DataFrame:
    """Directions that stand out over each capture's own floor line."""
    beams = _beams(spark, d)
    rng, level = g.bin_range(F.col("range_bin")), 10 * F.log10(F.greatest("power", F.lit(1e-12)))
    line = beams.select("capture_id", F.log10(rng).alias("lr"), level.alias("level")).groupBy("capture_id").agg(F.regr_slope("level", "lr").alias("slope"), F.regr_intercept("level", "lr").alias("intercept"))
    return sc.over_floor(beams.where("el = 0").drop("el"), line, ["capture_id"], 1.0).select("capture_id", "range_bin", "az", "excess", "energy")


@query(f"""{BEAMS}, b AS (SELECT capture_id, round_even(sqrt(greatest((range_bin * 0.0234375) ** 2 - 1.44, 0.09)) * sin(radians(az * 0.684 + 9.21)) / 0.1, 0)::INT AS ix, round_even(sqrt(greatest((range_bin * 0.0234375) ** 2 - 1.44, 0.09)) * cos(radians(az * 0.684 + 9.21)) / 0.1, 0)::INT AS iy, power FROM beams WHERE range_bin * 0.0234375 >= 0.9)
SELECT capture_id, ix, iy, R(sum(power)) AS power FROM b GROUP BY ALL""", 4)
def occlusion_grid(spark: SparkSession, d: str) -> DataFrame:
    """The floor grid of an occlusion baseline."""
    return sc.baseline_tables(_covs(spark, d), _beams(spark, d), ["capture_id"])[1]


@query(f"{ANTENNAS}, p AS (SELECT capture_id, range_bin, a, avg(re * re + im * im) AS p FROM ant GROUP BY ALL) SELECT capture_id, range_bin, R(sum(p)) AS power FROM p GROUP BY ALL")
def occlusion_power(spark: SparkSession, d: str) -> DataFrame:
    """The bins' power of an occlusion baseline."""
    return sc.baseline_tables(_covs(spark, d), _beams(spark, d), ["capture_id"])[0]


@query(f"""{ANTENNAS}, h AS (SELECT capture_id % 2 AS capture_id, (snap // 60)::BIGINT AS hour, range_bin, a, avg(re * re + im * im) AS p FROM ant GROUP BY ALL), spots AS (SELECT DISTINCT l_suppkey % 2 AS capture_id, (l_orderkey % 600) // 60 AS hour, l_linenumber * 0.03 AS range_m FROM lineitem WHERE l_quantity > 49)
SELECT capture_id, hour, range_bin, R(sum(p)) AS power, NOT EXISTS (SELECT 1 FROM spots s WHERE s.capture_id = h.capture_id AND s.hour = h.hour AND abs(s.range_m - h.range_bin * 0.0234375) < 0.02) AS usable FROM h GROUP BY ALL""")
def hourly_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots a minute apart; occupants are the points of the largest quantities."""
    entries = snapshots(spark, d).select((F.col("capture_id") % 2).alias("capture_id"), (F.col("snap") * 60).alias("ts"), "range_bin", "re", "im")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49")
    spots = lines.select((F.col("l_suppkey") % 2).alias("capture_id"), (F.col("l_orderkey") % 600 * 60).alias("ts"), (F.col("l_linenumber") * 0.03).alias("range_m"))
    return b.hourly_sweeps(entries, spots, ["capture_id"], "ts", near=0.02)


@query(f"{EVENTS}, s AS (SELECT user_id, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS bend FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, count(*) AS n, R(stddev_pop(bend)) AS rough, R(1 / (1 + stddev_pop(bend) / 10)) AS smooth FROM s GROUP BY user_id HAVING count(*) >= 4")
def ridge_smoothness(spark: SparkSession, d: str) -> DataFrame:
    return ft.ridge_smoothness(events(spark, d), ["user_id"], "event_id", "value")


@query(f"""{EVENTS}, daily AS (SELECT user_id, floor(t / 86400)::BIGINT AS day, avg(value) AS value FROM ev GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM daily), k AS (SELECT DISTINCT user_id, n FROM q WHERE n >= 5),
fam AS (SELECT user_id, n, kk % n AS r, kk // n % 2 AS back, count(*) AS w FROM k, (SELECT unnest(range(60)) AS kk) GROUP BY ALL), pos AS (SELECT f.user_id, f.r, f.back, f.w, q.day, v.value FROM fam f JOIN q ON q.user_id = f.user_id JOIN q v ON v.user_id = f.user_id AND v.i = CASE WHEN back = 1 THEN (2 * f.n - 1 - q.i - r) % f.n ELSE (q.i - r + f.n) % f.n END),
sl AS (SELECT a.user_id, a.r, a.back, any_value(a.w) AS w, median((b.value - a.value) / (b.day - a.day)) AS slope FROM pos a JOIN pos b ON a.user_id = b.user_id AND a.r = b.r AND a.back = b.back AND b.day > a.day GROUP BY ALL), own AS (SELECT user_id, slope FROM sl WHERE r = 0 AND back = 0),
p AS (SELECT user_id, sum(CASE WHEN s.slope <= o.slope THEN w ELSE 0 END) / 60.0 AS p FROM sl s JOIN own o USING (user_id) GROUP BY user_id) SELECT q.user_id, count(*) AS n, R(coalesce(any_value(p.p), 1)) AS p FROM q LEFT JOIN p USING (user_id) GROUP BY q.user_id""")
def trend_chances(spark: SparkSession, d: str) -> DataFrame:
    """How often a rotated or reversed series of daily means falls as steeply."""
    daily = events(spark, d).groupBy("user_id", F.floor(F.col("t") / 86400).alias("day")).agg(F.avg("value").alias("value"))
    return m.trend_chance(daily, ["user_id"], "day", "value", shifts=60)


@query(f"{FRAMES}, x AS (SELECT *, coalesce(h_s <= 0.45, false) AS low FROM frames), c AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY frame) - row_number() OVER (PARTITION BY tid, low ORDER BY frame) AS grp FROM x) SELECT tid, frame, role, low AND count(*) OVER (PARTITION BY tid, low, grp) >= 2 AS fallen FROM c")
def scene_rows(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows with a label from the height alone."""
    rows = frames(spark, d)
    return ft.scene_rows(rows.select("tid", "frame", "role"), rows.select("tid", "frame", "h_s"), ["tid"], "frame", least=2)


@query()
def compared_sets(spark: SparkSession, d: str) -> DataFrame:
    """Two feature sets on the same recordings."""
    rows = events(spark, d).select((F.col("user_id") % 3).alias("recording"), "value", F.col("k").cast("double").alias("k"), (F.col("value") + F.col("k") < 90).cast("int").alias("label"))
    return ml.compared(rows, {"one": ["value"], "both": ["value", "k"]}, "recording")


@query()
def room_planes(spark: SparkSession, d: str) -> DataFrame:
    """Dominant planes of each room's points; random triples, tested on planted planes."""
    p = points(spark, d).withColumn("capture_id", F.col("capture_id") % 5)
    return cl.planes(p, ["capture_id"], most=2, tries=200)


@query(f"{POINTS} SELECT capture_id, count(*) AS n, R(quantile_cont(z, 0.5)) AS z_med, R(avg(z)) AS z_mean, R(avg((z < 0.4)::INT)) AS below FROM points GROUP BY ALL")
def cloud_heights(spark: SparkSession, d: str) -> DataFrame:
    return vx.cloud_heights(points(spark, d), ["capture_id"])


@query(f"{POINTS}, u AS (SELECT capture_id, 'returned' AS scan, x, power FROM points WHERE scan = 'R' UNION ALL SELECT capture_id, 'others' AS scan, x, NULL FROM points WHERE scan <> 'R') SELECT capture_id, scan, count(*) AS n, R(avg(x)) AS x, R(avg(power)) AS power FROM u GROUP BY ALL", 4)
def scans_together(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    clouds = {"returned": p.where("scan = 'R'").select("capture_id", "x", "power"), "others": p.where("scan <> 'R'").select("capture_id", "x")}
    return vx.scans_together(clouds).groupBy("capture_id", "scan").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("power").alias("power"))


@query(f"{POINTS}, c AS (SELECT capture_id, trunc((x + 2.0) / 0.2)::INT AS ix, trunc(y / 0.2)::INT AS iy, trunc(z / 0.2)::INT AS iz FROM points) SELECT capture_id, ix, iy, iz, count(*) AS n FROM c WHERE ix BETWEEN 0 AND 19 AND iy BETWEEN 0 AND 29 AND iz BETWEEN 0 AND 14 GROUP BY ALL")
def voxel_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Cells from their numbers."""
    cells = vx.voxel_map(points(spark, d), ["capture_id"]).select("capture_id", g.voxel_number().alias("number"), F.col("hit_count").cast("long").alias("n"))
    return cells.select("capture_id", *(e.alias(n) for n, e in g.voxel_coordinates(F.col("number")).items()), "n")


@query(f"""{EVENTS}, e AS (SELECT user_id, event_id::DOUBLE AS t, value AS amp, k::DOUBLE AS refl FROM ev), b AS (SELECT *, quantile_cont(amp, 0.75) OVER (PARTITION BY user_id) AS p75, quantile_cont(refl, 0.5) OVER (PARTITION BY user_id) AS r FROM e), x AS (SELECT *, amp < 0.45 * p75 AND amp < 200 AS low FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, low ORDER BY t) AS grp FROM x), g AS (SELECT user_id, grp, min(t) AS start, max(t) AS stop, avg(refl) >= 0.5 * any_value(r) AS there FROM c WHERE low GROUP BY user_id, grp)
SELECT user_id, start, stop AS "end", stop - start AS seconds, CASE WHEN there THEN 'apnea' ELSE 'absence' END AS kind FROM g WHERE stop - start >= 10""")
def breath_pauses(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("amp"), F.col("k").cast("double").alias("refl"))
    return v.pauses(rows, ["user_id"], floor_mm=200.0)


@query(f"""{EVENTS}, m AS (SELECT user_id, event_id::DOUBLE AS t, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM ev), a AS (SELECT *, median(m) OVER (PARTITION BY user_id) AS med FROM m), b AS (SELECT *, median(abs(m - med)) OVER (PARTITION BY user_id) AS mad FROM a), x AS (SELECT *, m > med + 1.3 * mad AS on_ FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) - row_number() OVER (PARTITION BY user_id, on_ ORDER BY t) AS grp FROM x) SELECT user_id, min(t) AS start, max(t) AS "end", CASE WHEN on_ THEN 'active' ELSE 'still' END AS kind FROM c GROUP BY user_id, on_, grp HAVING max(t) - min(t) >= 1""")
def motion_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", F.col("event_id").cast("double").alias("t"), F.col("value").alias("motion"))
    return v.segments(rows, ["user_id"], k=1.3)


@query("""WITH RECURSIVE ev AS (SELECT user_id, event_id, value FROM events), r AS (SELECT user_id, event_id::DOUBLE AS start, 60 + value / 20 AS hr, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM ev),
s AS (SELECT user_id, start, hr, rn, hr AS x, 4.0::DOUBLE AS p, [hr] AS kept, []::DOUBLE[] AS odd FROM r WHERE rn = 1
UNION ALL
SELECT user_id, start, hr, rn, CASE WHEN ok THEN x + (p + 0.49) / (p + 4.49) * (hr - x) WHEN anew THEN list_avg(odd2) ELSE x END, CASE WHEN ok THEN (1 - (p + 0.49) / (p + 4.49)) * (p + 0.49) WHEN anew THEN 4.0 ELSE p END,
  CASE WHEN ok THEN kept2 WHEN anew THEN odd2 ELSE kept END, CASE WHEN ok OR anew THEN []::DOUBLE[] ELSE odd2 END
FROM (SELECT *, NOT ok AND len(odd2) = 5 AND list_stddev_pop(odd2) <= 0.1 * list_avg(odd2) AS anew FROM (
  SELECT n.user_id, n.start, n.hr, n.rn, s.x, s.p, s.kept, abs(n.hr - list_avg(s.kept)) <= 0.1 * list_avg(s.kept) AND abs(n.hr - s.kept[-1]) <= 0.2 * s.kept[-1] AS ok, list_slice(list_append(s.kept, n.hr), -5, -1) AS kept2, list_slice(list_append(s.odd, n.hr), -5, -1) AS odd2
  FROM s JOIN r n ON n.user_id = s.user_id AND n.rn = s.rn + 1)))
SELECT user_id, start, R(hr) AS hr, R(x) AS hr_smooth FROM s""")
def smoothed_rates(spark: SparkSession, d: str) -> DataFrame:
    """A gated and filtered track, value after value."""
    rows = events(spark, d).select("user_id", F.col("event_id").cast("double").alias("start"), (60 + F.col("value") / 20).alias("hr"))
    return v.smoothed_rates(rows, ["user_id"])


@query()
def clear_channels(spark: SparkSession, d: str) -> DataFrame:
    """The bins of each window whose breathing is clearest, ranked."""
    return ft.per_bin(_slow_time(spark, d), ["capture_id"], ft.clear_channels, ft.CLEAR, 10.0, 10.0)


@query()
def breath_cycles_out(spark: SparkSession, d: str) -> DataFrame:
    """Heart rates of every capture's snapshots before and after the breath's mean cycle is taken out: many captures, short windows."""
    rows = snapshots(spark, d).select("capture_id", "range_bin", (F.col("snap") * 0.05).alias("ts"), "re", "im")
    return ft.per_bin(rows, ["capture_id"], ft.breath_cycles_out, ft.CYCLES, 12.8, 12.8, least=4)
