"""Baselines: statistics of sweeps, drift, and changes of range profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline as b
from .registry import query
from .standins import PROFILE, SWEEPS, TWO_PROFILES, profile, sweeps, two_profiles

SENSOR = ["sensor_id"]
USABLE = f"{SWEEPS}, u AS (SELECT *, hour(ts) AS hour, ts::DATE AS day, ln(power) AS v FROM sweeps WHERE usable AND power > 0)"


@query(f"""{USABLE}, enough AS (SELECT sensor_id, range_bin, hour FROM u GROUP BY ALL HAVING count(*) >= 3), daily AS (SELECT sensor_id, range_bin, hour, day, median(v) AS v FROM u SEMI JOIN enough USING (sensor_id, range_bin, hour) GROUP BY ALL),
m AS (SELECT *, median(v) OVER (PARTITION BY sensor_id, range_bin, hour) AS med FROM daily)
SELECT sensor_id, range_bin, hour::INT AS hour, count(*) AS days, R(exp(any_value(med))) AS level, R(exp(1.4826 * median(abs(v - med))) - 1) AS cv FROM m GROUP BY sensor_id, range_bin, hour HAVING count(*) >= 3""")
def hour_stats(spark: SparkSession, d: str) -> DataFrame:
    return b.hour_stats(sweeps(spark, d))


@query(f"""{USABLE}, bins AS (SELECT DISTINCT sensor_id, range_bin FROM sweeps), n AS (SELECT sensor_id, range_bin, hour, count(*) AS n FROM u GROUP BY ALL)
SELECT sensor_id, range_bin, h::INT AS hour, coalesce(n, 0) AS n FROM bins CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN n USING (sensor_id, range_bin) WHERE false
UNION ALL SELECT b.sensor_id, b.range_bin, h.h::INT, coalesce(n.n, 0) FROM bins b CROSS JOIN (SELECT unnest(range(24)) AS h) h LEFT JOIN n ON n.sensor_id = b.sensor_id AND n.range_bin = b.range_bin AND n.hour = h.h""".replace("SELECT sensor_id, range_bin, h::INT AS hour, coalesce(n, 0) AS n FROM bins CROSS JOIN (SELECT unnest(range(24)) AS h) LEFT JOIN n USING (sensor_id, range_bin) WHERE false\nUNION ALL SELECT b.sensor_id, b.range_bin, h.h::INT, coalesce(n.n, 0)", "SELECT b.sensor_id, b.range_bin, h.h::INT AS hour, coalesce(n.n, 0) AS n"))
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return b.coverage(sweeps(spark, d))


@query(f"""{USABLE}, daily AS (SELECT sensor_id, range_bin, day, median(v) AS lvl FROM u GROUP BY ALL), steps AS (SELECT *, lvl - lag(lvl) OVER (PARTITION BY sensor_id, range_bin ORDER BY day) AS d, count(*) OVER (PARTITION BY sensor_id, range_bin) AS n FROM daily),
m AS (SELECT *, median(d) OVER (PARTITION BY sensor_id, range_bin) AS med FROM steps WHERE d IS NOT NULL AND n >= 4), s AS (SELECT *, 1.4826 * median(abs(d - med)) OVER (PARTITION BY sensor_id, range_bin) AS s FROM m)
SELECT sensor_id, range_bin, day, R(d) AS d, R(exp(d)) AS jump_x FROM s WHERE abs(d) > 2 * CASE WHEN s = 0 THEN 1e-9 ELSE s END AND abs(d) >= 0.2""")
def furniture_events(spark: SparkSession, d: str) -> DataFrame:
    return b.furniture_events(sweeps(spark, d), k=2.0)


BIN_STATS = "m AS (SELECT *, median(power) OVER (PARTITION BY sensor_id, range_bin) AS med FROM u), st AS (SELECT sensor_id, range_bin, any_value(med) AS med, count(*) AS n, 1.4826 * median(abs(power - med)) AS sigma FROM m GROUP BY ALL)"


@query(f"{USABLE}, {BIN_STATS} SELECT sensor_id, range_bin, R(med) AS med, n, R(sigma) AS sigma FROM st")
def bin_stats(spark: SparkSession, d: str) -> DataFrame:
    return b.bin_stats(sweeps(spark, d))


@query(f"""{USABLE}, {BIN_STATS}, r AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY sigma / med DESC, range_bin) AS at FROM st), w AS (SELECT sensor_id, string_agg(range_bin::VARCHAR, ',' ORDER BY pos) AS worst_bins FROM (SELECT *, at AS pos FROM r) WHERE pos <= 8 GROUP BY sensor_id)
SELECT s.sensor_id, count(DISTINCT ts) AS sweeps, R((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS span_s, R(avg(usable::INT)) AS usable_frac, any_value(worst_bins) AS worst_bins FROM sweeps s LEFT JOIN w USING (sensor_id) GROUP BY s.sensor_id""".replace(") AS at FROM st", ") AS place FROM st").replace("SELECT *, at AS pos", "SELECT *, place AS pos"), 4)
def sweep_health(spark: SparkSession, d: str) -> DataFrame:
    return b.health(sweeps(spark, d))


@query(f"{SWEEPS} SELECT sensor_id, range_bin, count(*) AS n FROM (SELECT *, max(ts) OVER (PARTITION BY sensor_id) AS last FROM sweeps) WHERE ts >= last - INTERVAL 7 DAY GROUP BY ALL")
def recent_sweeps(spark: SparkSession, d: str) -> DataFrame:
    return b.recent(sweeps(spark, d)).groupBy("sensor_id", "range_bin").agg(F.count("*").alias("n"))


@query(f"{SWEEPS} SELECT sensor_id, range_bin, count(*) AS n, R(sum(power)) AS power FROM (SELECT *, max(ts) OVER (PARTITION BY sensor_id) AS last FROM sweeps) WHERE ts >= last - INTERVAL 3 DAY GROUP BY ALL", 4)
def archived_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """The last days of an archive by day, written in two parts and read with the days' files alone."""
    from ..sources.tables import scratch

    path, rows = scratch(spark, "archive"), sweeps(spark, d)
    for half in (0, 1):
        b.archive(rows.where(F.pmod(F.hash("ts"), F.lit(2)) == half), path)
    return b.recent_archived(spark, path, 3).groupBy("sensor_id", "range_bin").agg(F.count("*").alias("n"), F.sum("power").alias("power"))


@query(f"{SWEEPS} SELECT sensor_id, (epoch(ts)::BIGINT - epoch(ts)::BIGINT % 300) AS bucket, count(*) AS n, R(sum(power)) AS power FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM sweeps) GROUP BY ALL", 3)
def five_minute_buckets(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import bucket_start

    s = sweeps(spark, d)
    return s.groupBy("sensor_id", bucket_start(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("bucket")).agg(F.count("*").alias("n"), F.sum("power").alias("power"))


RATIO = f"{TWO_PROFILES}, ratio AS (SELECT sensor_id, range_bin, l.range_m, l.power, (l.power - e.power) / (e.power + 1e-12) AS ratio FROM live l JOIN (SELECT sensor_id, range_bin, power FROM empty_) e USING (sensor_id, range_bin))"


def _ratio(spark: SparkSession, d: str) -> DataFrame:
    live, empty = two_profiles(spark, d)
    return b.occupancy_ratio(live, empty.drop("range_m"), ["sensor_id", "range_bin"])


@query(f"{RATIO} SELECT sensor_id, range_bin, R(range_m) AS range_m, R(power) AS power, R(ratio) AS ratio FROM ratio")
def occupancy_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _ratio(spark, d)


@query(f"""{RATIO}, p AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS pos, coalesce(least(lag(ratio, 1) OVER w, lag(ratio, 2) OVER w, lag(ratio, 3) OVER w), 0) AS lead3, range_m >= 0.9 AND ratio >= 0.02 AS hot FROM ratio WINDOW w AS (PARTITION BY sensor_id ORDER BY range_bin)),
h AS (SELECT *, pos - row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS grp FROM p WHERE hot)
SELECT sensor_id, R(min(range_m)) AS r0, R(max(range_m)) AS r1, count(*)::INT AS n_bins, R(max(ratio)) AS peak_ratio, R(arg_max(range_m, (ratio, -range_bin))) AS peak_range, arg_max(range_bin, (ratio, -range_bin)) AS peak_bin, R(arg_min(lead3, range_bin)) AS shadow,
  arg_max(range_m, (ratio, -range_bin)) < 5.8 AND arg_min(lead3, range_bin) < -0.2 AS confirmed FROM h GROUP BY sensor_id, grp""")
def hot_blocks(spark: SparkSession, d: str) -> DataFrame:
    return b.hot_blocks(_ratio(spark, d), SENSOR, least=0.02)


@query(f"""{TWO_PROFILES}, l AS (SELECT *, power - median(power) OVER (PARTITION BY sensor_id) AS l FROM live), e AS (SELECT sensor_id, range_bin, power - median(power) OVER (PARTITION BY sensor_id) AS e FROM empty_),
dl AS (SELECT sensor_id, range_bin, range_m, l - e AS delta FROM l JOIN e USING (sensor_id, range_bin)), p AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS pos FROM dl),
g AS (SELECT *, pos - row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS grp FROM p WHERE range_m >= 0.9 AND delta > 3),
r AS (SELECT sensor_id, grp, max(range_m) - min(range_m) AS span_m, avg(delta) AS excess_db, count(*) AS n, min(range_bin) AS first_bin FROM g GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY span_m DESC, first_bin) AS place FROM r)
SELECT sensor_id, R(span_m) AS span_m, R(excess_db) AS excess_db, n, first_bin, R(span_m * greatest(excess_db, 0)) AS lying_score FROM b WHERE place = 1""")
def longest_rise(spark: SparkSession, d: str) -> DataFrame:
    live, empty = (x.withColumnRenamed("power", "power_db") for x in two_profiles(spark, d))
    return b.longest_rise(live, empty, SENSOR)


@query(f"""{TWO_PROFILES}, c AS (SELECT sensor_id, range_bin, l.range_m, CASE WHEN l.range_m >= 0.9 THEN 10 * log10(l.power + 1e-9) - 10 * log10(e.power + 1e-9) ELSE -99.0 END AS ch FROM live l JOIN (SELECT sensor_id, range_bin, power FROM empty_) e USING (sensor_id, range_bin))
SELECT sensor_id, R(coalesce(max(range_m) FILTER (ch > -3) - min(range_m) FILTER (ch > -3), 0)) AS span_m, R(max(ch)) AS peak_db, R(arg_max(range_m, (ch, -range_bin))) AS peak_range, count(*) FILTER (ch > -3) AS n_hot FROM c GROUP BY sensor_id""")
def motion_span(spark: SparkSession, d: str) -> DataFrame:
    live, empty = (x.withColumnRenamed("power", "motion") for x in two_profiles(spark, d))
    return b.motion_span(live, empty, SENSOR, above_db=-3.0)


AROUND = "list_concat(list(power) OVER (PARTITION BY sensor_id ORDER BY range_bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), list(power) OVER (PARTITION BY sensor_id ORDER BY range_bin ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING))"


@query(f"""{PROFILE}, a AS (SELECT *, list_median({AROUND}) AS local, coalesce(lag(power) OVER (PARTITION BY sensor_id ORDER BY range_bin), -1) AS pre, coalesce(lead(power) OVER (PARTITION BY sensor_id ORDER BY range_bin), -1) AS post FROM prof)
SELECT sensor_id, range_bin, R(power) AS power, R(range_m) AS range_m, R(local) AS local, coalesce(power > 1.1 * local AND power > pre AND power >= post, false) AS peak FROM a""")
def range_cfar(spark: SparkSession, d: str) -> DataFrame:
    return b.range_cfar(profile(spark, d), SENSOR, factor=1.1)


@query(f"""{PROFILE}, r AS (SELECT *, power - quantile_cont(power, 0.5) OVER (PARTITION BY sensor_id ORDER BY range_bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS resid FROM prof), q AS (SELECT *, quantile_cont(resid, 0.8) OVER (PARTITION BY sensor_id) AS hi, quantile_cont(resid, 0.3) OVER (PARTITION BY sensor_id) AS lo FROM r)
SELECT sensor_id, range_bin, R(resid) AS resid, CASE WHEN resid >= hi THEN 'glint' WHEN resid <= lo THEN 'void' ELSE 'surface' END AS kind FROM q""")
def surface_kind(spark: SparkSession, d: str) -> DataFrame:
    return b.surface_kind(profile(spark, d), SENSOR).select("sensor_id", "range_bin", "resid", "kind")


VAR = """f AS (SELECT l_suppkey % 5 AS sensor_id, (l_partkey % 75)::INT AS range_bin, l_orderkey AS frame, sum(l_quantity) / 7.0::DOUBLE AS mag FROM lineitem GROUP BY ALL)"""


def _mags(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    return rows.groupBy((F.col("l_suppkey") % 5).alias("sensor_id"), (F.col("l_partkey") % 75).cast("int").alias("range_bin"), F.col("l_orderkey").alias("frame")).agg((F.sum("l_quantity") / 7.0).alias("mag"))


@query(f"WITH {VAR} SELECT sensor_id, range_bin, frame, R(mag) AS mag, R(CASE WHEN count(mag) OVER w >= 5 THEN var_pop(mag) OVER w ELSE 0 END) AS var FROM f WINDOW w AS (PARTITION BY sensor_id, range_bin ORDER BY frame ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def range_variance(spark: SparkSession, d: str) -> DataFrame:
    return b.range_variance(_mags(spark, d), SENSOR)


@query(f"""WITH {VAR}, v AS (SELECT sensor_id, range_bin, var_pop(mag * 70) AS var, 3500.0 + 10 * range_bin AS cal FROM f GROUP BY ALL), t AS (SELECT *, CASE WHEN var >= 24000 THEN 2 WHEN var >= 100 AND var >= 6 * greatest(cal, 1) THEN 1 ELSE 0 END AS tier FROM v WHERE range_bin BETWEEN 4 AND 74),
p AS (SELECT *, row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS pos FROM t), g AS (SELECT *, pos - row_number() OVER (PARTITION BY sensor_id ORDER BY range_bin) AS grp FROM p WHERE tier > 0)
SELECT sensor_id, min(range_bin) AS bin_start, max(range_bin) + 1 AS bin_end, arg_max(range_bin, (var, -range_bin)) AS peak_bin, R(max(var) / 7) AS peak_var, CASE WHEN max(tier) = 2 THEN 'strong' ELSE 'weak' END AS tier FROM g GROUP BY sensor_id, grp HAVING min(range_bin) < 74""")
def presence_bands(spark: SparkSession, d: str) -> DataFrame:
    var = _mags(spark, d).groupBy("sensor_id", "range_bin").agg(F.var_pop(F.col("mag") * 70).alias("var")).withColumn("cal", 3500.0 + 10 * F.col("range_bin"))
    return b.presence_bands(var, SENSOR, strong=24000.0, ratio=6.0).withColumn("peak_var", F.col("peak_var") / 7)


@query("""WITH m AS (SELECT l_suppkey % 5 AS sensor_id, (l_partkey % 75)::INT AS range_bin, avg(l_quantity) FILTER (l_returnflag = 'R') AS mean_a, var_pop(l_quantity) FILTER (l_returnflag = 'R') AS var_a, avg(l_quantity) FILTER (l_returnflag = 'N') AS mean_b, var_pop(l_quantity) FILTER (l_returnflag = 'N') AS var_b FROM lineitem GROUP BY ALL)
SELECT sensor_id, range_bin, R(mean_a) AS mean_a, R(var_a) AS var_a, R(mean_b) AS mean_b, R(var_b) AS var_b, R(mean_b - mean_a) AS d_mean, R(var_b - var_a) AS d_var, R(CASE WHEN mean_a > 10 THEN mean_b / mean_a END) AS ratio FROM m WHERE mean_a IS NOT NULL AND mean_b IS NOT NULL""")
def compare_profiles(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_suppkey") % 5).alias("sensor_id"), (F.col("l_partkey") % 75).cast("int").alias("range_bin"), F.col("l_quantity").alias("mag"), "l_returnflag")
    return b.compare_profiles(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'N'"), SENSOR)


def _line(table: str) -> str:
    return f"SELECT sensor_id, regr_slope(power, x) AS slope, regr_intercept(power, x) AS intercept, count(*) AS n FROM {table} GROUP BY sensor_id"


@query(f"""{PROFILE}, r0 AS (SELECT sensor_id, log10(range_m) AS x, power / 500 AS power FROM prof WHERE range_bin > 0), f0 AS ({_line("r0")}), r1 AS (SELECT r.* FROM r0 r JOIN f0 USING (sensor_id) WHERE abs(power - slope * x - intercept) < 2), f1 AS ({_line("r1")}),
r2 AS (SELECT r.* FROM r1 r JOIN f1 USING (sensor_id) WHERE abs(power - slope * x - intercept) < 2), f2 AS ({_line("r2")}) SELECT sensor_id, R(slope) AS slope, R(intercept) AS intercept, n FROM f2""", 5)
def robust_line(spark: SparkSession, d: str) -> DataFrame:
    p = profile(spark, d).where("range_bin > 0").withColumn("power", F.col("power") / 500)
    return b.robust_line(p, SENSOR, "range_m", "power")


@query(f"{PROFILE} SELECT sensor_id, R(arg_max(range_m, (power, -range_m))) AS wall_m, R(max(power)) AS power FROM prof WHERE range_m BETWEEN 4.0 AND 6.8 GROUP BY sensor_id")
def front_wall(spark: SparkSession, d: str) -> DataFrame:
    return b.front_wall(profile(spark, d), SENSOR)


@query(f"""{TWO_PROFILES}, o AS (SELECT sensor_id, range_m FROM empty_ WHERE range_bin % 25 = 3) SELECT sensor_id, range_bin, R(range_m) AS range_m, R(power) AS power, NOT EXISTS (SELECT 1 FROM o WHERE o.sensor_id = l.sensor_id AND abs(o.range_m - l.range_m) < 1.0) AS usable FROM live l""")
def mask_occupied(spark: SparkSession, d: str) -> DataFrame:
    live, empty = two_profiles(spark, d)
    return b.mask_occupied(live, empty.where(F.col("range_bin") % 25 == 3), SENSOR)
