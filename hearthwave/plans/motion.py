"""Runs, latches, windows over frames, fall evidence and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import falls as f
from ..operators import islands as i
from ..streaming import jobs, steps
from .registry import query
from .standins import EVENTS, FRAMES, POINTS, events, frames, points

USER = ["user_id"]
T = ["t", "event_id"]


@query(f"{POINTS}, r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame ORDER BY z DESC) AS at_, count(*) OVER (PARTITION BY capture_id, frame) AS n FROM (SELECT * REPLACE (frame % 50 AS frame) FROM points)) SELECT capture_id, frame, R(z) AS h_s, n FROM r WHERE at_ = 2 AND n >= 2")
def second_highest(spark: SparkSession, d: str) -> DataFrame:
    return f.second_highest(points(spark, d).withColumn("frame", F.col("frame") % 50), ["capture_id", "frame"])


@query(f"{POINTS}, r AS (SELECT capture_id % 5 AS capture_id, frame % 500 AS frame, z, power, row_number() OVER (PARTITION BY capture_id % 5, frame % 500 ORDER BY z DESC, power DESC) AS at_ FROM points) SELECT capture_id, frame, list(power ORDER BY z, power)[1] AS lowest, list(power ORDER BY z, power)[-1] AS highest, count(*)::INT AS n FROM r WHERE at_ <= 5 GROUP BY ALL")
def top5_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "frame": F.col("frame") % 500})
    top = f.top_points(p, ["capture_id", "frame"], order="power")
    return top.select("capture_id", "frame", F.col("top")[0]["o"].alias("lowest"), F.element_at("top", -1)["o"].alias("highest"), F.size("top").alias("n"))


RUNS = """r AS (SELECT *, low <> coalesce(lag(low) OVER w, NOT low) AS starts FROM x WINDOW w AS (PARTITION BY {k} ORDER BY {o})), n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY {k} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS run FROM r),
q AS (SELECT *, row_number() OVER (PARTITION BY {k}, run ORDER BY {o}) AS pos, count(*) OVER (PARTITION BY {k}, run) AS size FROM n)"""
ON_FRAMES = f"{FRAMES}, x AS (SELECT *, coalesce(h_s <= 0.45, false) AS low FROM frames), {RUNS.format(k='tid', o='frame')}"
ON_EVENTS = f"{EVENTS}, x AS (SELECT *, value < 60 AS low FROM ev), {RUNS.format(k='user_id', o='t, event_id')}"


@query(f"{ON_EVENTS}, e AS (SELECT *, CASE WHEN low AND pos = 3 THEN 1 WHEN NOT low AND pos = 3 THEN 0 END AS e FROM q) SELECT user_id, event_id, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS down FROM e")
def down_latch(spark: SparkSession, d: str) -> DataFrame:
    return i.latch(events(spark, d), USER, T, F.col("value") < 60, sustain=3, clear=3).select("user_id", "event_id", "down")


@query(f"{ON_FRAMES} SELECT tid, frame, low AND size >= 2 AS fallen FROM q")
def fallen_label(spark: SparkSession, d: str) -> DataFrame:
    return i.back_filled(frames(spark, d), ["tid"], ["frame"], F.col("h_s") <= 0.45, least=2).select("tid", "frame", "fallen")


@query(f"{ON_EVENTS} SELECT user_id, event_id, CASE WHEN low THEN pos ELSE 0 END::INT AS run FROM q")
def trigger_run(spark: SparkSession, d: str) -> DataFrame:
    return i.trigger_run(events(spark, d), USER, T, F.col("value") < 60).select("user_id", "event_id", "run")


@query(f"{ON_EVENTS} SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, list_sort(list(DISTINCT event_type)) AS reasons FROM q WHERE low GROUP BY user_id, run".replace("list_sort(list(DISTINCT event_type))", "array_to_string(list_sort(list(DISTINCT event_type)), ',')"))
def episodes(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumns({"reason": F.array("event_type"), "t": F.struct("t", "event_id")})
    found = i.episodes(e, USER, "t", F.col("value") < 60, "reason")
    return found.select("user_id", F.col("first.t").alias("first"), F.col("last.t").alias("last"), "n", F.array_join("reasons", ",").alias("reasons"))


@query(f"{EVENTS}, l AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM ev WHERE event_type = 'error'), e AS (SELECT *, sum((gap IS NULL OR gap > 86400)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS episode FROM l) SELECT user_id, event_id, episode, t - min(t) OVER (PARTITION BY user_id, episode) AS held FROM e")
def sustain_timer(spark: SparkSession, d: str) -> DataFrame:
    return i.sustained(events(spark, d), USER, "t", F.col("event_type") == "error", 86400).select("user_id", "event_id", "episode", "held")


@query(f"{EVENTS} SELECT user_id, event_id, avg((value < 60)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) >= 0.5 AS voted FROM ev")
def presence_vote(spark: SparkSession, d: str) -> DataFrame:
    return i.vote(events(spark, d), USER, T, F.col("value") < 60).select("user_id", "event_id", "voted")


@query(f"{EVENTS}, w AS (SELECT user_id, event_id, sum((value < 60)::INT) OVER w AS hits, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN 172800 PRECEDING AND CURRENT ROW)) SELECT user_id, event_id, hits >= 3 AND hits >= 0.5 * n AS present FROM w")
def presence_persistence(spark: SparkSession, d: str) -> DataFrame:
    return i.present(events(spark, d), USER, "t", F.col("value") < 60, seconds=172800, least=3).select("user_id", "event_id", "present")


@query(f"{EVENTS} SELECT user_id, R(avg((value < 60)::INT)) AS share, avg((value < 60)::INT) >= 0.4 AS present FROM ev GROUP BY user_id")
def living_gate(spark: SparkSession, d: str) -> DataFrame:
    return i.living(events(spark, d), USER, F.col("value") < 60)


CENTRES = f"{POINTS}, c AS (SELECT capture_id % 5 AS capture_id, frame % 200 AS frame, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM points WHERE frame % 200 <> 77 GROUP BY ALL)"


def _centres(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "frame": F.col("frame") % 200}).where("frame <> 77")
    return p.groupBy("capture_id", "frame").agg(*(F.avg(c).alias(c) for c in "xyz"))


@query(f"{CENTRES}, w AS (SELECT *, list(x) OVER w AS xs, list(y) OVER w AS ys, list(z) OVER w AS zs, frame - min(frame) OVER w AS span FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT capture_id, frame, R(xs[1]) AS first, R(ys[1]) AS ninth, R(zs[8]) AS last FROM w WHERE len(xs) = 8 AND span = 7")
def frame_windows(spark: SparkSession, d: str) -> DataFrame:
    w = f.frame_windows(_centres(spark, d), ["capture_id"], "frame", ["x", "y", "z"])
    return w.select("capture_id", "frame", F.element_at("vector", 1).alias("first"), F.element_at("vector", 9).alias("ninth"), F.element_at("vector", 24).alias("last"))


@query(f"{CENTRES}, v AS (SELECT *, frame - lag(frame) OVER w = 1 AS j, " + ", ".join(f"CASE WHEN frame - lag(frame) OVER w = 1 THEN ({a} - lag({a}) OVER w) * 10 ELSE 0 END AS v{a}" for a in "xyz") + " FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY frame)) SELECT capture_id, frame, R(x) AS x, R(y) AS y, R(z) AS z, R(vx) AS vx, R(vy) AS vy, R(vz) AS vz, " + ", ".join(f"R(CASE WHEN j THEN (v{a} - lag(v{a}) OVER w) * 10 ELSE 0 END) AS a{a}" for a in "xyz") + " FROM v WINDOW w AS (PARTITION BY capture_id ORDER BY frame)")
def kinematics(spark: SparkSession, d: str) -> DataFrame:
    return f.kinematics(_centres(spark, d), ["capture_id"], "frame")


@query(f"{CENTRES}, v AS (SELECT capture_id, frame, z, coalesce((z - lag(z) OVER (PARTITION BY capture_id ORDER BY frame)) * 10, 0) AS v FROM c), w AS (SELECT capture_id, frame, z, min(v) OVER w AS pk, first(z) OVER w - last(z) OVER w AS net, count(z) OVER w AS n FROM v WINDOW w AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) SELECT capture_id, frame, CASE WHEN pk < -1.5 AND net > 0.05 THEN 'falling' WHEN z > 1.2 THEN 'stood' WHEN z > 1.1 THEN 'sat' ELSE 'lying' END AS label FROM w WHERE n = 8")
def auto_label(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    moved = (F.col("z") - F.lag("z").over(W.partitionBy("capture_id").orderBy("frame"))) * 10
    return f.auto_label(_centres(spark, d).withColumn("v", F.coalesce(moved, F.lit(0.0))), ["capture_id"], "frame", "z", "v", net=0.05, stood=1.2, sat=1.1)


@query(f"{CENTRES}, s AS (SELECT capture_id, z, (z - lag(z) OVER w) / (frame - lag(frame) OVER w) AS s FROM c WINDOW w AS (PARTITION BY capture_id ORDER BY frame)) SELECT capture_id, R(min(s)) AS min_slope, R(max(z) - min(z)) AS h_range FROM s GROUP BY capture_id")
def height_trend(spark: SparkSession, d: str) -> DataFrame:
    return f.height_trend(_centres(spark, d), ["capture_id"], "frame", "z")


@query(f"{CENTRES} SELECT capture_id, frame, R(median(z) OVER (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS z_med FROM c")
def height_median(spark: SparkSession, d: str) -> DataFrame:
    return ev.rolling_median(_centres(spark, d), ["capture_id"], "frame", "z", 7, "z_med").select("capture_id", "frame", "z_med")


@query(f"""{POINTS}, c AS (SELECT capture_id % 5 AS capture_id, frame % 400 * 0.1::DOUBLE AS ts, trunc(y / 0.5)::INT AS cell, z FROM points), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, cell, ts ORDER BY z DESC) AS at_, count(*) OVER (PARTITION BY capture_id, cell, ts) AS n FROM c),
h AS (SELECT capture_id, cell, ts, z <= 1.9 AS low FROM r WHERE at_ = 2 AND n >= 2), b AS (SELECT *, lag(low) OVER w AS pl, lag(ts) OVER w AS pt FROM h WINDOW w AS (PARTITION BY capture_id, cell ORDER BY ts)),
s AS (SELECT *, sum((low AND (pl IS NULL OR NOT pl OR ts - pt > 2.0))::INT) OVER (PARTITION BY capture_id, cell ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM b), l AS (SELECT *, min(ts) OVER (PARTITION BY capture_id, cell, spell) AS since FROM s WHERE low)
SELECT capture_id, cell, R(cell * 0.5 + 0.25) AS range_m, R(min(ts) FILTER (ts - since >= 0.6)) AS burst, R(max(ts)) AS last_low FROM l GROUP BY capture_id, cell, spell HAVING min(ts) FILTER (ts - since >= 0.6) IS NOT NULL""")
def cell_trigger(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select((F.col("capture_id") % 5).alias("capture_id"), (F.col("frame") % 400 * 0.1).alias("ts"), F.col("y").alias("wy"), F.col("z").alias("wz"))
    return f.cell_trigger(p, ["capture_id"], "ts", least=2, top=1.9, clear=2.0)


@query(f"{EVENTS}, x AS (SELECT *, k < 80 AND value < 120 AS low FROM ev), {RUNS.format(k='user_id', o='t')} SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM q WHERE low GROUP BY user_id, run HAVING count(*) >= 4")
def blackouts(spark: SparkSession, d: str) -> DataFrame:
    return f.blackouts(events(spark, d).withColumn("points", F.when(F.col("k") < 80, 0).otherwise(9)), USER, "t", F.col("points"), F.col("value") < 120, least=4, ties=["event_id"])


@query(f"""{EVENTS}, h AS (SELECT user_id, t, value / 100.0::DOUBLE AS h FROM ev), fl AS (SELECT user_id, min(t) AS t_floor FROM h WHERE h <= 0.2 GROUP BY user_id), j AS (SELECT * FROM h JOIN fl USING (user_id)),
g AS (SELECT user_id, t_floor, max(t) FILTER (h >= 1.0 AND t < t_floor) AS t_up, arg_max(h, t) FILTER (h >= 1.0 AND t < t_floor) AS h_up, arg_max(h, t) FILTER (t = t_floor) AS h_floor, avg((h <= 0.2)::INT) FILTER (t >= t_floor) AS stay FROM j GROUP BY ALL)
SELECT user_id, t_floor, t_up, R(h_up) AS h_up, R(h_floor) AS h_floor, R(stay) AS stay_down, t_floor - t_up AS seconds, R(CASE WHEN t_floor > t_up THEN (h_up - h_floor) / (t_floor - t_up) END) AS rate FROM g""", 9)
def descent(spark: SparkSession, d: str) -> DataFrame:
    return f.descent(events(spark, d).withColumn("h", F.col("value") / 100.0), USER, "t", "h", floor=0.2, tie="event_id")


@query(f"""{POINTS}, c AS (SELECT capture_id % 5 AS capture_id, rint_x AS fx, rint_y AS fy, * EXCLUDE (capture_id) FROM (SELECT *, round_even(x / 0.5, 0)::INT AS rint_x, round_even(y / 0.5, 0)::INT AS rint_y FROM points)), m AS (SELECT capture_id, fx, fy, quantile_cont(z, 0.05) AS hg FROM c GROUP BY ALL HAVING count(*) >= 8),
dd AS (SELECT capture_id, quantile_cont(hg, 0.5) AS hd FROM m GROUP BY ALL) SELECT c.capture_id, c.frame, c.k, R(power) AS power, R(z - coalesce(hg, hd, 0)) AS h FROM c LEFT JOIN m USING (capture_id, fx, fy) LEFT JOIN dd ON dd.capture_id = c.capture_id""")
def floor_heights(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("capture_id", F.col("capture_id") % 5)
    return f.above_floor(p, f.floor_map(p, ["capture_id"]), ["capture_id"]).select("capture_id", "frame", "k", "power", "h")


LIE_SUM = " + ".join(f"({f'ln(1 + coalesce({n}, {i}))' if log else f'coalesce({n}, {i})'} - {m!r}::DOUBLE) / {sc!r}::DOUBLE * {w!r}::DOUBLE" for n, (m, sc, w, i, log) in f.LIE.items())


@query(f"""{POINTS}, c AS (SELECT capture_id, k, count(*) AS n, CASE WHEN k > 1 THEN quantile_cont(z, 0.9) END AS hi2, avg((z < 0.4)::INT) AS floor_frac, max(y) - min(y) AS y_span, stddev_pop(z) AS micro FROM points GROUP BY capture_id, k),
s AS (SELECT *, {f.LIE_BIAS!r}::DOUBLE + {LIE_SUM} AS s FROM c) SELECT capture_id, k, R(1 / (1 + exp(-greatest(-40, least(40, s))))) AS p_lie FROM s""")
def p_lie(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d).groupBy("capture_id", "k").agg(F.count("*").alias("n"), F.percentile("z", 0.9).alias("hi2"), F.avg((F.col("z") < 0.4).cast("double")).alias("floor_frac"), (F.max("y") - F.min("y")).alias("y_span"), F.stddev_pop("z").alias("micro"))
    return c.withColumn("hi2", F.when(F.col("k") > 1, F.col("hi2"))).select("capture_id", "k", f.lie_chance().alias("p_lie"))


@query(f"""{EVENTS}, e AS (SELECT event_id, (k % 10) / 10.0 AS p, value < 80 AS down, CASE WHEN k % 6 > 0 THEN (k % 8) / 10.0 END AS cz, (k % 9) / 10.0 AS below, k % 3 = 0 AS rr, (k % 7) / 10.0 AS flat, k % 4 = 0 AS ff FROM ev),
s AS (SELECT *, 0.22 * p + CASE WHEN down THEN 0.2 ELSE 0 END + 0.22 * coalesce(greatest(0, least(1, (0.4 - cz) / 0.7)), 0) + 0.18 * greatest(0, least(1, below / 0.8)) + 0.18 * flat AS s FROM e) SELECT event_id, R(greatest(0, least(1, CASE WHEN ff THEN greatest(s, 0.6) ELSE s END)) * CASE WHEN rr THEN 1.0 ELSE 0.7 END) AS p_fall FROM s""")
def fall_fusion(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    fused = f.fall_fusion((k % 10) / 10.0, F.col("value") < 80, F.when(k % 6 > 0, (k % 8) / 10.0), (k % 9) / 10.0, k % 3 == 0, (k % 7) / 10.0, k % 4 == 0)
    return events(spark, d).select("event_id", fused.alias("p_fall"))


EVIDENCE = {
    "w_down": "value < 80", "falling_p": "(k % 10) / 10.0", "cube": "event_type = 'error'", "cube_rr": "CASE WHEN k % 3 = 0 THEN 12.0 END", "cube_micro": "k % 5 = 0", "cube_floor_frac": "(k % 11) / 10.0", "rest_spot": "k % 13 = 0", "extra": "k % 2 = 0",
    "floor_fall": "k % 3 = 1", "lying_state": "k % 4 = 0", "cloud_below": "(k % 9) / 10.0", "cloud_z_med": "CASE WHEN k % 6 > 0 THEN (k % 8) / 10.0 END", "flat": "(k % 7) / 10.0", "h_s": "CASE WHEN k % 5 > 0 THEN (k % 12) / 10.0 END", "track_floor": "(k % 10) / 10.0",
}


FLAGS = ("w_down", "cube", "cube_micro", "rest_spot", "extra", "floor_fall", "lying_state")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("user_id", "event_id", *(F.expr(v).cast("boolean" if n in FLAGS else "double").alias(n) for n, v in EVIDENCE.items()))


CLEANED = f"""{EVENTS}, e AS (SELECT user_id, event_id, t, {', '.join(f'({v})::{"BOOLEAN" if n in FLAGS else "DOUBLE"} AS {n}' for n, v in EVIDENCE.items())} FROM ev), x AS (SELECT *, w_down OR falling_p >= 0.5 AS low FROM e), {RUNS.format(k='user_id', o='event_id')},
s AS (SELECT *, CASE WHEN low THEN pos ELSE 0 END AS held, CASE WHEN extra THEN CASE WHEN floor_fall THEN 0.25 ELSE 0 END + CASE WHEN lying_state THEN 0.15 ELSE 0 END + CASE WHEN cloud_below >= 0.7 THEN 0.15 ELSE 0 END + CASE WHEN cloud_z_med < 0.4 THEN 0.1 ELSE 0 END + CASE WHEN flat >= 0.55 THEN 0.1 ELSE 0 END + CASE WHEN h_s < 0.4 THEN 0.05 ELSE 0 END + CASE WHEN track_floor >= 0.7 THEN 0.05 ELSE 0 END ELSE 0 END::DOUBLE AS score,
  (CASE WHEN w_down THEN 0.5 ELSE 0 END + CASE WHEN falling_p >= 0.5 THEN 0.3 ELSE 0 END)::DOUBLE AS base FROM q),
c1 AS (SELECT *, CASE WHEN extra THEN least(0.98, base + score) ELSE base END AS c FROM s), c2 AS (SELECT * REPLACE (CASE WHEN cube THEN least(0.98, c + 0.4) ELSE c END AS c) FROM c1), c3 AS (SELECT * REPLACE (CASE WHEN rest_spot THEN c * 0.4 ELSE c END AS c) FROM c2),
o AS (SELECT *, cube AND cube_floor_frac < 0.7 AS rejected, low AND held >= 2 AND (cube OR round(score, 9) >= 0.45) AND c >= 0.5 AS f FROM c3)
SELECT user_id, event_id, held::INT AS run, NOT rejected AND f AS fall, NOT rejected AND f AND cube AND NOT (coalesce(cube_rr, 0) <> 0 OR cube_micro) AS collapse, NOT rejected AND low AND NOT f AS suspected, R(CASE WHEN rejected THEN 0 ELSE c END) AS confidence FROM o"""


@query(CLEANED, 2)
def cleaner(spark: SparkSession, d: str) -> DataFrame:
    return f.cleaned(_evidence(spark, d), USER, "event_id", persist=2).select("user_id", "event_id", "run", "fall", "collapse", "suspected", "confidence")


@query(CLEANED, 2)
def clean_steps(spark: SparkSession, d: str) -> DataFrame:
    """The stream's step function over whole tables; the SQL is that of the windowed form."""
    kinds = "user_id long, event_id long, run int, fall boolean, collapse boolean, suspected boolean, confidence double"
    return jobs.in_batch(_evidence(spark, d), USER, ["event_id"], lambda s, r: steps.clean_step(s, r, persist=2), kinds)


COLLAPSE = {"down": "k % 3 > 0", "red": "value < 300", "fallen": "k % 4 > 0", "rr": "k % 29 = 0", "micro": "k % 23 = 0", "measured": "k % 17 = 0"}
SUSPECTS = f"""{EVENTS}, e AS (SELECT user_id, event_id, event_id * 2.0::DOUBLE AS t, (k % 20)::DOUBLE AS down_s, {", ".join(f"({v}) AS {n}" for n, v in COLLAPSE.items())} FROM ev),
l AS (SELECT *, last_value(CASE WHEN down THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e), n AS (SELECT *, sum((last IS NULL OR t - last > 400)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS ep FROM l),
o AS (SELECT *, bool_or(rr) OVER w AS had_rr, bool_or(rr OR micro) OVER w AS living, bool_or(measured) OVER w AS measured_yet FROM n WINDOW w AS (PARTITION BY user_id, ep ORDER BY t ROWS UNBOUNDED PRECEDING)), s AS (SELECT *, red AND down_s >= 12 AND fallen AND NOT living AS suspect FROM o)
SELECT user_id, t, had_rr, living, measured_yet, suspect, CASE WHEN suspect THEN CASE WHEN measured_yet THEN 'strong' ELSE 'weak' END END AS confidence FROM s"""


def _signs(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames: two seconds for each number between, so that quiet spells are there."""
    return events(spark, d).select("user_id", (F.col("event_id") * 2.0).alias("t"), (F.col("k") % 20).cast("double").alias("down_s"), *(F.expr(v).alias(n) for n, v in COLLAPSE.items()))


@query(SUSPECTS)
def collapse_suspects(spark: SparkSession, d: str) -> DataFrame:
    return f.collapse(_signs(spark, d), USER, "t", quiet=400.0).select("user_id", "t", "had_rr", "living", "measured_yet", "suspect", "confidence")


@query(SUSPECTS)
def collapse_steps(spark: SparkSession, d: str) -> DataFrame:
    """The stream's step function over whole tables; the SQL is that of the windowed form."""
    kinds = "user_id long, t double, had_rr boolean, living boolean, measured_yet boolean, suspect boolean, confidence string"
    return jobs.in_batch(_signs(spark, d), USER, ["t"], lambda s, r: steps.collapse_step(s, r, quiet=400.0), kinds)


LABEL_TARGET = "CASE WHEN label IN ('lie', 'collapse') THEN 1 WHEN label IN ('empty', 'upright') THEN 0 ELSE -1 END"


LABELS = "SELECT doc_id, CASE WHEN t LIKE '%empty%' OR t LIKE '%无人%' OR t LIKE '%空%' THEN 'empty' WHEN t LIKE '%half-kneel%' OR t LIKE '%半跪%' OR t LIKE '%kneel-halfside%' OR t LIKE '%跪式半侧%' THEN 'boundary' WHEN t LIKE '%curl-sidefall%' OR t LIKE '%侧倒%' THEN 'collapse' WHEN t LIKE '%lie%' OR t LIKE '%躺%' THEN 'lie' WHEN t LIKE '%stand%' OR t LIKE '%站%' OR t LIKE '%sit%' OR t LIKE '%坐%' THEN 'upright' ELSE 'unknown' END AS label FROM (SELECT doc_id, lower(text) AS t FROM documents)"


@query(LABELS)
def label_class(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", f.label_class(F.col("text")).alias("label"))


@query(f"SELECT label, {LABEL_TARGET} AS target, count(*) AS n FROM ({LABELS}) GROUP BY ALL")
def label_targets(spark: SparkSession, d: str) -> DataFrame:
    named = spark.read.parquet(f"{d}/documents.parquet").select(f.label_class(F.col("text")).alias("label"))
    return named.groupBy("label", f.label_target(F.col("label")).alias("target")).agg(F.count("*").alias("n"))


@query(f"{EVENTS} SELECT event_id, CASE WHEN hr IS NULL THEN 'none' WHEN s < 0.3 THEN 'weak' WHEN rr IS NOT NULL AND round_even(hr / rr, 0) >= 1 AND abs(hr - round_even(hr / rr, 0) * rr) <= 5 THEN 'harmonic' ELSE 'ok' END AS trust FROM (SELECT event_id, CASE WHEN k > 5 THEN 40 + k END AS hr, value / 490 AS s, CASE WHEN k % 4 > 0 THEN 10 + k % 17 END AS rr FROM ev)")
def heart_trust(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return events(spark, d).select("event_id", f.heart_trust(F.when(k > 5, 40 + k), F.col("value") / 490, F.when(k % 4 > 0, 10 + k % 17)).alias("trust"))


@query(f"{EVENTS} SELECT event_id, CASE WHEN rr AND s >= 0.3 THEN true WHEN m >= 0.5 THEN true WHEN r IS NOT NULL THEN r >= 0.4 WHEN fr IS NOT NULL THEN false END AS lying FROM (SELECT event_id, k % 4 = 0 AS rr, value / 490 AS s, (k % 10) / 15.0 AS m, CASE WHEN k % 3 > 0 THEN (k % 9) / 10.0 END AS r, CASE WHEN k % 2 = 0 THEN 1 END AS fr FROM ev)")
def cube_verdict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return events(spark, d).select("event_id", f.cube_verdict(F.when(k % 4 == 0, 1), F.col("value") / 490, (k % 10) / 15.0, F.when(k % 3 > 0, (k % 9) / 10.0), F.when(k % 2 == 0, 1)).alias("lying"))


@query(f"""{POINTS}, r AS (SELECT capture_id % 5 AS capture_id, frame % 300 AS frame, x, z, doppler, row_number() OVER (PARTITION BY capture_id % 5, frame % 300 ORDER BY z DESC, x) AS at_ FROM points), p AS (SELECT capture_id, frame, stddev_pop(z) FILTER (at_ <= 5) AS top_spread, stddev_pop(doppler) AS dop_std, (max(doppler) > 0 AND min(doppler) < 0)::INT AS bipolar, avg(x) AS cx, avg(z) AS cz FROM r GROUP BY ALL)
SELECT capture_id, frame, R(avg(top_spread) OVER w) AS top_spread, R(avg(dop_std) OVER w) AS dop_std, R(avg(bipolar) OVER w) AS bipolar, R(stddev_pop(cx) OVER w) AS wander, R(stddev_pop(cz) OVER w) AS z_spread FROM p WINDOW w AS (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""", 5)
def ghost_probe(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "frame": F.col("frame") % 300})
    return f.ghost_probe(p, ["capture_id"], "frame")


@query(f"{EVENTS} SELECT user_id, event_type AS state, count(*) AS n, min(t) AS first FROM ev GROUP BY ALL")
def state_dwell(spark: SparkSession, d: str) -> DataFrame:
    return f.dwell(events(spark, d).withColumnRenamed("event_type", "state"), USER, "state", "t")


@query(f"{EVENTS}, g AS (SELECT event_type AS segment, value / 4 - k AS d FROM ev) SELECT coalesce(segment, 'all') AS segment, count(*) AS n, R(avg(abs(d))) AS mae, R(avg(d)) AS bias, R(median(d)) AS med, R(100.0 * avg((abs(d) <= 10)::INT)) AS in_range FROM g GROUP BY ROLLUP (segment)")
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    return ev.errors(events(spark, d).select(F.col("event_type").alias("segment"), (F.col("value") / 4 - F.col("k")).alias("d")), "segment", "d", 10.0)


@query(f"{EVENTS} SELECT event_type AS label, count(*) AS n, R(avg((value < 60)::INT)) AS rate FROM ev GROUP BY ALL")
def trigger_rates(spark: SparkSession, d: str) -> DataFrame:
    return ev.trigger_rates(events(spark, d).withColumnRenamed("event_type", "label"), "label", F.col("value") < 60)


@query("SELECT quality AS truth, toxic AS guess, count(*) AS n, R(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY quality)) AS share FROM labels GROUP BY quality, toxic")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return ev.confusion(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic").withColumnsRenamed({"quality": "truth", "toxic": "guess"})
