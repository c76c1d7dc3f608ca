"""Choices among clusters, boxes and labels, over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as c
from ..operators import geometry as g
from ..operators import mldata as ml
from ..operators import selection as s
from ..operators import voxels as v
from .registry import query
from .standins import EVENTS, POINTS, events, points

CLUSTERS = f"""{POINTS}, c AS (SELECT capture_id % 10 AS capture_id, frame % 100 AS frame, k AS cluster_id, count(*) AS n, avg(y) AS wy, avg((z < 0.8)::INT) AS floor_frac, quantile_cont(z, 0.9) AS z90, quantile_cont(z, 0.5) AS z_med, min(x) AS x0, max(x) AS x1, max(y) AS y1 FROM points GROUP BY ALL)"""
FRAME = ["capture_id", "frame"]


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 10, "frame": F.col("frame") % 100})
    return p.groupBy(*FRAME, F.col("k").alias("cluster_id")).agg(
        F.count("*").alias("n"), F.avg("y").alias("wy"), F.avg((F.col("z") < 0.8).cast("double")).alias("floor_frac"), F.percentile("z", 0.9).alias("z90"), F.percentile("z", 0.5).alias("z_med"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    )


@query(f"{CLUSTERS} SELECT capture_id, frame, cluster_id, floor_frac >= 0.3 AND n >= 3 AND z90 < 1.8 + 0.12 * greatest(0, wy - 2.0) AS lies, n >= 12 AND abs((x0 + x1) / 2) < 3.5 AND y1 < 6.5 AS person, CASE WHEN wy < 1.8 THEN 'near' WHEN wy < 3.2 THEN 'mid' ELSE 'far' END AS zone, CASE WHEN z_med > 0.9 THEN 'stand' WHEN z_med > 0.35 THEN 'sit' ELSE 'lie' END AS posture FROM c")
def cluster_verdicts(spark: SparkSession, d: str) -> DataFrame:
    lies = s.lies_by_shape(F.col("floor_frac"), F.col("n"), F.col("z90"), F.col("wy"), 0.3, 3, 1.8)
    place = s.track_place(F.col("wy"), F.col("z_med"))
    return _clusters(spark, d).select(*FRAME, "cluster_id", lies.alias("lies"), s.is_person(F.col("n"), F.col("x0"), F.col("x1"), F.col("y1")).alias("person"), *(e.alias(n) for n, e in place.items()))


@query(f"{CLUSTERS} SELECT capture_id, frame, arg_max(cluster_id, (floor_frac, n, -cluster_id)) AS cluster_id FROM c WHERE n >= 2 AND floor_frac >= 0.4 AND z_med < 1.0 GROUP BY ALL")
def fall_clusters(spark: SparkSession, d: str) -> DataFrame:
    return s.fall_cluster(_clusters(spark, d), FRAME, 2, 0.4, 1.0)


@query(f"{CLUSTERS} SELECT capture_id, frame, arg_max(cluster_id, (n, -cluster_id)) AS cluster_id FROM c WHERE n >= 2 AND floor_frac >= 0.3 GROUP BY ALL")
def floor_targets(spark: SparkSession, d: str) -> DataFrame:
    return s.floor_target(_clusters(spark, d), FRAME, 2, 0.3)


@query(f"{CLUSTERS} SELECT capture_id, frame, arg_max(cluster_id, ((coalesce(CASE WHEN cluster_id > 2 THEN cluster_id - 3 END, -1) = 0)::INT, n, -cluster_id)) AS cluster_id FROM c GROUP BY ALL")
def primary_boxes(spark: SparkSession, d: str) -> DataFrame:
    return s.primary_box(_clusters(spark, d).withColumn("tid", F.when(F.col("cluster_id") > 2, F.col("cluster_id") - 3)), FRAME)


@query("SELECT doc_id, CASE WHEN t LIKE '%near%' OR t LIKE '%近%' THEN 'near' WHEN t LIKE '%mid%' OR t LIKE '%中%' THEN 'mid' WHEN t LIKE '%far%' OR t LIKE '%远%' THEN 'far' END AS zone, CASE WHEN t LIKE '%stand%' OR t LIKE '%站%' THEN 'stand' WHEN t LIKE '%sit%' OR t LIKE '%坐%' THEN 'sit' WHEN t LIKE '%lie%' OR t LIKE '%lay%' OR t LIKE '%躺%' THEN 'lie' END AS posture FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def label_places(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", s.zone_of(F.col("text")).alias("zone"), s.posture_of(F.col("text")).alias("posture"))


@query("WITH t AS (SELECT o_orderkey % 500 AS frame, o_custkey % 20 AS tid, count(*) AS n FROM orders GROUP BY ALL), p AS (SELECT l_orderkey % 500 AS frame, l_suppkey % 20 AS tid, min(l_linenumber) AS pose, max(l_discount) AS falling_prob, bool_or(l_returnflag = 'R') AS down, max(l_quantity)::INT AS h FROM lineitem GROUP BY ALL) SELECT t.frame, t.tid, t.n, coalesce(pose, 255) AS pose, R(coalesce(falling_prob, 0)) AS falling_prob, coalesce(down, false) AS down, h AS h_s_cm FROM t LEFT JOIN p USING (frame, tid)")
def tracks_with_poses(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").groupBy((F.col("o_orderkey") % 500).alias("frame"), (F.col("o_custkey") % 20).alias("tid")).agg(F.count("*").alias("n"))
    p = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") % 500).alias("frame"), (F.col("l_suppkey") % 20).alias("tid")).agg(
        F.min("l_linenumber").alias("pose"), F.max("l_discount").alias("falling_prob"), F.bool_or(F.col("l_returnflag") == "R").alias("down"), F.max("l_quantity").cast("int").alias("h_s_cm"),
    )
    return s.with_poses(t, p, ["frame", "tid"])


@query(f"{POINTS}, p AS (SELECT capture_id % 10 AS capture_id, frame % 100 AS frame, z FROM points), f AS (SELECT DISTINCT capture_id, frame FROM p) SELECT f.capture_id, f.frame, count(*) AS n, R(max(z)) AS top FROM f JOIN p ON p.capture_id = f.capture_id AND p.frame BETWEEN f.frame - 3 AND f.frame GROUP BY ALL")
def recent_clouds(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select((F.col("capture_id") % 10).alias("capture_id"), (F.col("frame") % 100).alias("frame"), "z")
    return s.recent_points(p, p, ["capture_id"], "frame").groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("z").alias("top"))


@query(f"{EVENTS} SELECT user_id, event_id, R(CASE WHEN avg(value) OVER w > 0 THEN value / avg(value) OVER w ELSE 1 END) AS trend FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def variance_trend(spark: SparkSession, d: str) -> DataFrame:
    return s.variance_trend(events(spark, d), ["user_id"], "event_id", "value").select("user_id", "event_id", "trend")


@query("SELECT l_suppkey, l_linenumber, count(*) AS n, R(avg(2.0 - l_linenumber * 0.5 * cos(radians(35.0)))) AS height FROM lineitem GROUP BY ALL")
def range_heights(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.avg(g.range_height(F.col("l_linenumber") * 0.5)).alias("height"))


@query(f"{EVENTS}, w AS (SELECT user_id % 7 AS recording, event_type AS label, count(*) AS n FROM ev GROUP BY ALL) SELECT recording, label, n, R(n::DOUBLE / sum(n) OVER (PARTITION BY recording)) AS share FROM w")
def window_balance(spark: SparkSession, d: str) -> DataFrame:
    return ml.balance(events(spark, d).select((F.col("user_id") % 7).alias("recording"), F.col("event_type").alias("label")), ["recording"])


@query(f"{EVENTS}, t AS (SELECT user_id AS file, value / 100 - 2.0 AS posz, k * 15.0 AS velx FROM ev), g AS (SELECT file FROM t GROUP BY file HAVING max(abs(posz)) >= 2.0) SELECT file, count(*) AS n FROM t SEMI JOIN g USING (file) WHERE posz BETWEEN -1.9 AND 2.0 AND abs(velx) <= 1000 GROUP BY file")
def sane_tracks(spark: SparkSession, d: str) -> DataFrame:
    zero = {c: F.lit(0.0) for c in ("vely", "velz", "accx", "accy", "accz")}
    t = events(spark, d).select(F.col("user_id").alias("file"), (F.col("value") / 100 - 2.0).alias("posz"), (F.col("k") * 15.0).alias("velx")).withColumns(zero)
    return ml.sane_tracks(ml.live_files(t, least=2.0), (-1.9, 2.0)).groupBy("file").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {POINTS}, r AS (SELECT capture_id % 5 AS capture_id, floor(x / 0.3)::INT AS ix, floor(y / 0.3)::INT AS iy, coalesce(sum(power) FILTER (scan = 'R'), 0) / sum(power) AS ratio FROM points GROUP BY ALL), hot AS (SELECT *, row_number() OVER () AS id FROM r WHERE ratio >= 0.6),
e AS (SELECT p.id AS a, q.id AS b FROM hot p JOIN hot q ON p.capture_id = q.capture_id AND abs(p.ix - q.ix) + abs(p.iy - q.iy) = 1), reach AS (SELECT id, id AS root FROM hot UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT capture_id, count(*) AS n_cells, R(max(ratio)) AS peak, R(avg(ix)) AS cx, R(avg(iy)) AS cy FROM hot JOIN lab USING (id) GROUP BY capture_id, root""")
def hot_regions(spark: SparkSession, d: str) -> DataFrame:
    """Hot floor regions of the change between two kinds of points."""
    cells = points(spark, d).groupBy((F.col("capture_id") % 5).alias("capture_id"), F.floor(F.col("x") / 0.3).cast("int").alias("ix"), F.floor(F.col("y") / 0.3).cast("int").alias("iy"))
    ratio = cells.agg((F.sum(F.when(F.col("scan") == "R", F.col("power")).otherwise(0.0)) / F.sum("power")).alias("ratio"))
    return c.hot_regions(ratio, ["capture_id"], F.col("ratio") >= 0.6, 1)


@query(f"{POINTS} SELECT capture_id, k AS p, count(*) AS n, R(min(z)) AS low FROM points WHERE y - 3.0 BETWEEN -1.0 AND 2.0 AND z BETWEEN 0.0 AND 2.0 AND capture_id IN (SELECT capture_id FROM points WHERE y - 3.0 BETWEEN -1.0 AND 2.0 AND z BETWEEN 0.0 AND 2.0 GROUP BY capture_id HAVING count(*) >= 5) GROUP BY ALL")
def gated_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    tracks = p.select("capture_id").distinct().withColumn("posy", F.lit(3.0))
    kept = ml.gated_points(p, tracks, ["capture_id"], (-1.0, 2.0), (0.0, 2.0))
    return kept.groupBy("capture_id", F.col("k").alias("p")).agg(F.count("*").alias("n"), F.min("z").alias("low"))


@query(f"{POINTS} SELECT capture_id, count(*) AS occupied, sum(n)::BIGINT AS n_points FROM (SELECT capture_id, trunc((x + 2.0) / 0.2)::INT AS ix, trunc(y / 0.2)::INT AS iy, trunc(z / 0.2)::INT AS iz, count(*) AS n FROM points GROUP BY ALL) WHERE ix BETWEEN 0 AND 19 AND iy BETWEEN 0 AND 29 AND iz BETWEEN 0 AND 14 GROUP BY capture_id")
def occupied_totals(spark: SparkSession, d: str) -> DataFrame:
    return v.voxel_map(points(spark, d), ["capture_id"]).groupBy("capture_id").agg(F.count("*").alias("occupied"), F.sum("hit_count").alias("n_points"))
