"""Interval, as-of and nearest joins between recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as j
from .registry import query
from .standins import EVENTS, POINTS, events, points

USER = ["user_id"]

#: Windows are clicks, the watch's samples are views of the same user.
PAIR = f"{EVENTS}, win AS (SELECT user_id, event_id, t FROM ev WHERE event_type = 'click'), watch AS (SELECT user_id, t AS ts, avg(value) AS bpm FROM ev WHERE event_type = 'view' GROUP BY ALL)"
BACK = "b AS (SELECT w.*, p.ts AS prev_ts, p.bpm AS prev FROM win w ASOF LEFT JOIN watch p ON w.user_id = p.user_id AND w.t >= p.ts), n AS (SELECT b.*, x.ts AS next_ts, x.bpm AS next FROM b ASOF LEFT JOIN watch x ON b.user_id = x.user_id AND b.t <= x.ts)"


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = events(spark, d)
    watch = e.where("event_type = 'view'").groupBy("user_id", F.col("t").alias("ts")).agg(F.avg("value").alias("bpm"))
    return e.where("event_type = 'click'").select("user_id", "event_id", "t"), watch


LINE = "CASE WHEN prev_ts IS NULL THEN next WHEN next_ts IS NULL THEN prev WHEN next_ts > prev_ts THEN prev + (next - prev) * (t - prev_ts) / (next_ts - prev_ts)::DOUBLE ELSE prev END"


@query(f"{PAIR}, {BACK} SELECT user_id, event_id, t, R(prev) AS prev, R(next) AS next, R({LINE}) AS interp, R(CASE WHEN least(t - prev_ts, next_ts - t) < 20000 THEN CASE WHEN next_ts IS NULL OR t - prev_ts <= next_ts - t THEN prev ELSE next END END) AS nearest FROM n")
def watch_asof(spark: SparkSession, d: str) -> DataFrame:
    win, watch = _pair(spark, d)
    pairs = j.nearest(j.interpolated(j.as_of(win, watch, USER, "t", "ts", "bpm"), "t"), "t", 20000)
    return pairs.select("user_id", "event_id", "t", "prev", "next", "interp", "nearest")


@query(f"{PAIR}, {BACK}, m AS (SELECT w.user_id, w.t, avg(bpm) AS mean FROM (SELECT DISTINCT user_id, t FROM win) w JOIN watch ON watch.user_id = w.user_id AND watch.ts BETWEEN w.t - 20000 AND w.t + 20000 GROUP BY ALL), ln AS (SELECT *, {LINE} AS line FROM n) SELECT n.user_id, n.event_id, n.t, R(coalesce(mean, line)) AS ref FROM ln n LEFT JOIN m ON m.user_id = n.user_id AND m.t = n.t")
def watch_reference(spark: SparkSession, d: str) -> DataFrame:
    win, watch = _pair(spark, d)
    return j.watch_reference(win, watch, USER, "t", 20000.0).select("user_id", "event_id", "t", "ref")


CHUNKS = "chunk AS (SELECT user_id, event_id AS chunk_id, t AS start, t + 40000 AS end_ FROM ev WHERE event_type = 'purchase'), lab AS (SELECT user_id, event_id AS label_id, t FROM ev WHERE event_type = 'signup')"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'signup'").select("user_id", F.col("event_id").alias("label_id"), "t")


@query(f"{EVENTS}, {CHUNKS} SELECT l.user_id, l.label_id, l.t, min(chunk_id) AS chunk_id FROM lab l JOIN chunk c ON c.user_id = l.user_id AND l.t >= c.start - 1 AND l.t <= c.end_ + 1 GROUP BY ALL")
def label_interval(spark: SparkSession, d: str) -> DataFrame:
    chunks = events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("chunk_id"), F.col("t").alias("start"), (F.col("t") + 40000).alias("end"))
    return j.chunk_of(_labels(spark, d), chunks, USER, "label_id", "t", "chunk_id", bucket=86400.0)


@query(f"{EVENTS}, {CHUNKS} SELECT l.user_id, l.label_id, count(*) AS n, R(avg(value)) AS value FROM lab l JOIN ev e ON e.user_id = l.user_id AND e.t >= l.t - 20000 AND e.t <= l.t + 60000 AND e.event_type = 'view' GROUP BY ALL")
def label_window(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'view'").select("user_id", F.col("t").alias("ts"), "value")
    met = j.around(_labels(spark, d), rows, USER, "t", "ts", 20000, 60000, 86400.0)
    return met.groupBy("user_id", "label_id").agg(F.count("*").alias("n"), F.avg("value").alias("value"))


TRACKS = "cl AS (SELECT capture_id % 10 AS capture_id, frame % 50 AS frame, k AS cluster_id, avg(x) AS x, avg(y) AS y FROM points WHERE scan = 'R' GROUP BY ALL), tr AS (SELECT capture_id % 10 AS capture_id, frame % 50 AS frame, k AS tid, avg(x) AS x, avg(y) AS y FROM points WHERE scan = 'N' GROUP BY ALL)"
FRAME = ["capture_id", "frame"]


def _groups(spark: SparkSession, d: str, scan: str, name: str) -> DataFrame:
    p = points(spark, d).where(F.col("scan") == scan).withColumns({"capture_id": F.col("capture_id") % 10, "frame": F.col("frame") % 50})
    return p.groupBy("capture_id", "frame", F.col("k").alias(name)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query(f"{POINTS}, {TRACKS}, m AS (SELECT c.*, tid, (c.x - t.x) ** 2 + (c.y - t.y) ** 2 AS d2 FROM cl c JOIN tr t USING (capture_id, frame)), b AS (SELECT capture_id, frame, cluster_id, arg_min(tid, (d2, tid)) AS tid, sqrt(min(d2)) AS distance FROM m WHERE d2 < 0.64 GROUP BY ALL) SELECT capture_id, frame, cluster_id, R(x) AS x, R(y) AS y, tid, R(distance) AS distance FROM cl LEFT JOIN b USING (capture_id, frame, cluster_id)")
def nearest_track(spark: SparkSession, d: str) -> DataFrame:
    return j.nearest_track(_groups(spark, d, "R", "cluster_id"), _groups(spark, d, "N", "tid"), FRAME)


@query(f"{POINTS}, {TRACKS} SELECT capture_id, frame, tid, count(*) AS n FROM cl c JOIN tr t USING (capture_id, frame) WHERE (c.x - t.x) ** 2 + (c.y - t.y) ** 2 <= 0.5625 GROUP BY ALL")
def points_near_tracks(spark: SparkSession, d: str) -> DataFrame:
    return j.points_of_tracks(_groups(spark, d, "R", "cluster_id"), _groups(spark, d, "N", "tid"), FRAME).groupBy(*FRAME, "tid").agg(F.count("*").alias("n"))


DEATHS = "seen AS (SELECT capture_id, frame % 50 AS frame, k AS tid, avg(x) AS x, avg(y) AS y FROM points WHERE power < 60000 GROUP BY ALL), fr AS (SELECT DISTINCT capture_id, frame FROM seen), dead AS (SELECT s.*, f.frame AS died FROM seen s JOIN fr f ON f.capture_id = s.capture_id AND f.frame = s.frame + 1 WHERE NOT EXISTS (SELECT 1 FROM seen n WHERE n.capture_id = s.capture_id AND n.tid = s.tid AND n.frame = s.frame + 1))"


def _deaths(spark: SparkSession, d: str, which: str = "power < 60000") -> DataFrame:
    p = points(spark, d).where(which).withColumns({"frame": F.col("frame") % 50})
    seen = p.groupBy("capture_id", "frame", F.col("k").alias("tid")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return j.track_deaths(seen, seen.select(*FRAME).distinct(), ["capture_id"], "frame", "tid")


@query(f"{POINTS}, {DEATHS.replace(' WHERE power < 60000', '')} SELECT capture_id, frame, tid, R(x) AS x, R(y) AS y, died FROM dead")
def track_deaths(spark: SparkSession, d: str) -> DataFrame:
    return _deaths(spark, d, "true").select("capture_id", "frame", "tid", "x", "y", "died")


@query(f"{POINTS}, {DEATHS}, bl AS (SELECT capture_id, frame % 50 AS frame, k AS blob, avg(x) AS x, avg(y) AS y FROM points WHERE power >= 60000 GROUP BY ALL), m AS (SELECT b.*, dd.tid, dd.died FROM bl b JOIN dead dd ON dd.capture_id = b.capture_id AND b.frame BETWEEN dd.died AND dd.died + 8 WHERE (b.x - dd.x) ** 2 + (b.y - dd.y) ** 2 <= 1.6::DOUBLE * 1.6::DOUBLE) SELECT capture_id, frame, blob, R(x) AS x, R(y) AS y, arg_max(tid, (died, tid)) AS tid, frame - arg_max(died, (died, tid)) AS age FROM m GROUP BY capture_id, frame, blob, x, y")
def recent_deaths(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).where("power >= 60000").withColumns({"frame": F.col("frame") % 50})
    blobs = p.groupBy("capture_id", "frame", F.col("k").alias("blob")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    deaths = _deaths(spark, d).select("capture_id", "tid", "x", "y", F.col("died").alias("frame"))
    return j.recent_deaths(blobs, deaths, ["capture_id"], "frame", gate=1.6)


@query(f"{POINTS}, {TRACKS} SELECT capture_id, frame, tid, R(x) AS x, R(y) AS y FROM tr WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.capture_id = tr.capture_id AND cl.frame = tr.frame AND (cl.x - tr.x) ** 2 + (cl.y - tr.y) ** 2 <= 0.25)")
def not_walked_off(spark: SparkSession, d: str) -> DataFrame:
    return j.not_walked_off(_groups(spark, d, "N", "tid"), _groups(spark, d, "R", "cluster_id"), FRAME, gate=0.5)


BURST = "q AS (SELECT DISTINCT capture_id, frame, k * 20 AS range_bin FROM points WHERE scan = 'A'), b AS (SELECT DISTINCT capture_id, frame AS b_frame, k * 20 + 3 AS b_bin FROM points WHERE scan <> 'A')"


@query(f"{POINTS}, {BURST}, m AS (SELECT q.*, b_frame, b_bin, row_number() OVER (PARTITION BY q.capture_id, frame, range_bin ORDER BY (b_frame < frame)::INT, abs(b_frame - frame), abs(range_bin - b_bin), b_bin) AS place FROM q JOIN b ON b.capture_id = q.capture_id AND abs(b_frame - frame) <= 150 AND abs(range_bin - b_bin) <= 10) SELECT capture_id, frame, range_bin, b_frame, b_bin FROM m WHERE place = 1")
def nearest_burst(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    q = p.where("scan = 'A'").select("capture_id", "frame", (F.col("k") * 20).alias("range_bin")).distinct()
    b = p.where("scan <> 'A'").select("capture_id", "frame", (F.col("k") * 20 + 3).alias("range_bin")).distinct()
    return j.nearest_burst(q, b, ["capture_id"])


@query(f"{POINTS}, bx AS (SELECT capture_id, k AS cluster_id, avg(x) AS cx, avg(y) AS cy, 0.4 + k * 0.1 AS sx, 0.3 + k * 0.1 AS sy FROM points GROUP BY ALL), an AS (SELECT capture_id, scan AS kind, avg(x) AS x, avg(y) AS y FROM points GROUP BY ALL), s AS (SELECT capture_id, cluster_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS support FROM bx JOIN an USING (capture_id) WHERE abs(x - cx) <= sx / 2 + 0.3 AND abs(y - cy) <= sy / 2 + 0.3 GROUP BY ALL) SELECT capture_id, cluster_id, support FROM bx LEFT JOIN s USING (capture_id, cluster_id)")
def supported_boxes(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    bx = p.groupBy("capture_id", F.col("k").alias("cluster_id")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumns({"sx": 0.4 + F.col("cluster_id") * 0.1, "sy": 0.3 + F.col("cluster_id") * 0.1})
    an = p.groupBy("capture_id", F.col("scan").alias("kind")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return j.supported(bx, an, ["capture_id"], "cluster_id").select("capture_id", "cluster_id", F.array_join("support", ",").alias("support"))


@query(f"{POINTS}, v AS (SELECT scan, capture_id, avg(power) AS p FROM points GROUP BY ALL) SELECT a.capture_id, a.scan, b.scan AS scan_b, R(a.p) AS p, R(b.p) AS p_b FROM v a JOIN v b ON a.capture_id = b.capture_id AND a.scan < b.scan", 3)
def capture_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = points(spark, d).groupBy("scan", "capture_id").agg(F.avg("power").alias("p"))
    return j.capture_pairs(v, "scan", ["capture_id"])


@query(f"{POINTS} SELECT capture_id, k FROM points WHERE scan = 'R' INTERSECT SELECT capture_id, k FROM points WHERE scan = 'N'")
def common_bins(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return j.common_bins(p.where("scan = 'R'"), p.where("scan = 'N'"), ["capture_id", "k"])
