"""Moments of antenna snapshots and comparisons of captures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import moments as m
from .registry import query
from .standins import ANTENNAS, EVENTS, POINTS, events, points, snapshots

BIN = ["capture_id", "range_bin"]


@query(f"{ANTENNAS}, p AS (SELECT capture_id, range_bin, a, count(*) AS n, avg(re) AS mr, avg(im) AS mi, avg(re * re + im * im) AS p FROM ant GROUP BY ALL) SELECT capture_id, range_bin, max(n) AS n, R(sum(p)) AS power, R(sum(mr * mr + mi * mi)) AS mean_power, R(sum(p) - sum(mr * mr + mi * mi)) AS variance FROM p GROUP BY capture_id, range_bin")
def bin_moments(spark: SparkSession, d: str) -> DataFrame:
    return m.bin_moments(snapshots(spark, d), BIN)


COV = f"{ANTENNAS}, cov AS (SELECT x.capture_id, x.range_bin, x.a::INT AS i, y.a::INT AS j, avg(x.re * y.re + x.im * y.im) AS re, avg(x.im * y.re - x.re * y.im) AS im, count(*) AS n FROM ant x JOIN ant y USING (capture_id, range_bin, snap) GROUP BY ALL)"


@query(f"{COV} SELECT capture_id, range_bin, i, j, R(re) AS re, R(im) AS im, n FROM cov")
def covariance(spark: SparkSession, d: str) -> DataFrame:
    return m.covariances(snapshots(spark, d), BIN)


@query(f"{COV}, mean AS (SELECT capture_id, range_bin, a AS i, avg(re) AS mr, avg(im) AS mi FROM ant GROUP BY ALL) SELECT c.capture_id, c.range_bin, c.i, c.j, R(re - p.mr * q.mr - p.mi * q.mi) AS re, R(-(im - p.mi * q.mr + p.mr * q.mi)) AS im, n FROM cov c JOIN mean p ON p.capture_id = c.capture_id AND p.range_bin = c.range_bin AND p.i = c.i JOIN mean q ON q.capture_id = c.capture_id AND q.range_bin = c.range_bin AND q.i = c.j")
def fluctuation_covariance(spark: SparkSession, d: str) -> DataFrame:
    return m.covariances(snapshots(spark, d), BIN, conjugate=True, fluctuation=True)


REL = f"{COV}, rel AS (SELECT b.capture_id, a.range_bin, sqrt(sum((b.re - a.re) ** 2 + (b.im - a.im) ** 2)) / sqrt(sum(a.re ** 2 + a.im ** 2)) AS rel FROM cov a JOIN cov b ON a.range_bin = b.range_bin AND a.i = b.i AND a.j = b.j AND a.capture_id = 0 AND b.capture_id <> 0 GROUP BY ALL)"


def against_first(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first capture's cells, without its id, and those of all others."""
    return cells.where("capture_id = 0").drop("capture_id", "n"), cells.where("capture_id <> 0")


def _rel(spark: SparkSession, d: str) -> DataFrame:
    return m.relative_change(*against_first(m.covariances(snapshots(spark, d), BIN)), ["range_bin"], ["capture_id"])


@query(f"{REL} SELECT capture_id, range_bin, R(rel) AS rel, R(median(rel) OVER w) AS med, count(*) OVER w AS bins, R(rel / median(rel) OVER w) AS scaled FROM rel WINDOW w AS (PARTITION BY capture_id)")
def relative_change(spark: SparkSession, d: str) -> DataFrame:
    return m.change_by_capture(_rel(spark, d), ["capture_id"])


@query(f"{REL}, t AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rel DESC, range_bin)::INT AS place FROM rel) SELECT capture_id, range_bin, R(rel) AS rel, place FROM t WHERE place <= 5")
def top_changed_bins(spark: SparkSession, d: str) -> DataFrame:
    return m.top_changed(_rel(spark, d), ["capture_id"])


@query(f"{COV} SELECT range_bin, i, j, R(median(re)) AS re, R(median(im)) AS im FROM cov GROUP BY range_bin, i, j HAVING count(*) > 0.5 * (SELECT count(DISTINCT capture_id) FROM cov)")
def robust_base(spark: SparkSession, d: str) -> DataFrame:
    cov = m.covariances(snapshots(spark, d), BIN)
    return m.robust_base(cov.withColumnRenamed("capture_id", "round"), ["range_bin"])


@query(f"{ANTENNAS}, mean AS (SELECT capture_id, range_bin, a, avg(re) AS re, avg(im) AS im FROM ant GROUP BY ALL), s AS (SELECT p.capture_id, q.capture_id AS capture_id_b, p.range_bin, sqrt(sum(p.re * q.re + p.im * q.im) ** 2 + sum(p.im * q.re - p.re * q.im) ** 2) / (sqrt(sum(p.re ** 2 + p.im ** 2)) * sqrt(sum(q.re ** 2 + q.im ** 2))) AS sim FROM mean p JOIN mean q ON p.range_bin = q.range_bin AND p.a = q.a AND p.capture_id < q.capture_id GROUP BY ALL) SELECT capture_id, capture_id_b, R(median(sim)) AS sim, count(*) AS bins FROM s GROUP BY ALL")
def direction_similarity(spark: SparkSession, d: str) -> DataFrame:
    per = m.by_antenna(snapshots(spark, d), BIN).groupBy(*BIN, "a").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    means = per.groupBy(*BIN).agg(F.sort_array(F.collect_list(F.struct("a", "re", "im"))).alias("v")).select(*BIN, F.col("v.re").alias("re"), F.col("v.im").alias("im"))
    return m.direction_similarity(means, "capture_id", ["range_bin"])


@query(f"{ANTENNAS}, r AS (SELECT DISTINCT capture_id, range_bin, snap FROM ant), q AS (SELECT *, row_number() OVER (PARTITION BY capture_id, range_bin ORDER BY snap) AS at_, count(*) OVER (PARTITION BY capture_id, range_bin) AS n FROM r) SELECT capture_id, range_bin, count(*) AS kept, max(snap) AS last FROM q WHERE at_ <= 8 AND n >= 4 GROUP BY ALL")
def capped_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return m.capped(snapshots(spark, d), BIN, ["snap"], 8, 4).groupBy(*BIN).agg(F.count("*").alias("kept"), F.max("snap").alias("last"))


@query(f"{EVENTS}, p AS (SELECT user_id, t / 86400.0::DOUBLE AS x, avg(value) AS y FROM ev GROUP BY ALL), s AS (SELECT a.user_id, median((b.y - a.y) / (b.x - a.x)) AS slope FROM p a JOIN p b ON a.user_id = b.user_id AND b.x > a.x GROUP BY ALL), md AS (SELECT user_id, median(x) AS mx, median(y) AS my FROM p GROUP BY ALL) SELECT user_id, R(slope) AS slope, R(my - slope * mx) AS intercept FROM s JOIN md USING (user_id)", 4)
def theil_sen(spark: SparkSession, d: str) -> DataFrame:
    p = events(spark, d).groupBy("user_id", (F.col("t") / 86400.0).alias("x")).agg(F.avg("value").alias("y"))
    return m.theil_sen(p, ["user_id"], "x", "y")


@query(f"{POINTS}, c AS (SELECT capture_id, k, scan, count(*) AS n FROM points GROUP BY ALL), p AS (SELECT capture_id, k, coalesce(sum(n) FILTER (scan = 'R'), 0) AS a, coalesce(sum(n) FILTER (scan = 'N'), 0) AS b FROM c WHERE scan IN ('R', 'N') GROUP BY ALL) SELECT capture_id, R(sum(abs(b - a)) / greatest(sum(a), 1e-12)) AS rel FROM p GROUP BY capture_id")
def grid_change(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d).groupBy("capture_id", "k", "scan").agg(F.count("*").alias("n"))
    a, b = (c.where(F.col("scan") == s).drop("scan") for s in ("R", "N"))
    return m.grid_change(a, b, ["capture_id"], ["k"])


@query(f"""{ANTENNAS}, r AS (SELECT DISTINCT capture_id, range_bin, snap FROM ant), sp AS (SELECT *, ntile(4) OVER (PARTITION BY capture_id, range_bin ORDER BY snap) AS part FROM r), ap AS (SELECT ant.*, part FROM ant JOIN sp USING (capture_id, range_bin, snap)),
cov AS (SELECT x.capture_id, x.range_bin, x.part, x.a AS i, y.a AS j, avg(x.re * y.re + x.im * y.im) AS re, avg(x.im * y.re - x.re * y.im) AS im FROM ap x JOIN ap y USING (capture_id, range_bin, part, snap) GROUP BY ALL),
rel AS (SELECT p.capture_id, p.range_bin, p.part, q.part AS part_b, sqrt(sum((q.re - p.re) ** 2 + (q.im - p.im) ** 2)) / sqrt(sum(p.re ** 2 + p.im ** 2)) AS rel FROM cov p JOIN cov q ON p.capture_id = q.capture_id AND p.range_bin = q.range_bin AND p.i = q.i AND p.j = q.j AND p.part < q.part GROUP BY ALL)
SELECT capture_id, range_bin, R(avg(rel)) AS score FROM rel GROUP BY ALL""")
def motion_score(spark: SparkSession, d: str) -> DataFrame:
    """Change between the covariances of four spans of a capture."""
    return m.motion_score(snapshots(spark, d), BIN, "snap")
