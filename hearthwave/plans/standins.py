"""The given tables as a fleet's recordings, in Spark and in SQL.

points: ``lineitem``, one detected point a row. sweeps: ``events``, powers of range bins. frames: ``conversations``,
turns as frames of a track. snapshots: ``embeddings``, two snapshots of 16 complex antennas a vector. watch and
labels: ``events`` of two kinds, with times in seconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _read(spark, d, "lineitem").select(
        c("l_suppkey").alias("capture_id"), c("l_orderkey").alias("frame"), c("l_linenumber").alias("k"), ((c("l_partkey") % 600) / 100.0 - 2.995).alias("x"), (c("l_quantity") * 0.139).alias("y"),
        (c("l_tax") * 25 + c("l_discount") * 5 - 0.1).alias("z"), c("l_extendedprice").alias("power"), (c("l_discount") * 10 - 0.5).alias("doppler"), c("l_returnflag").alias("scan"),
    )


POINTS = """points AS (SELECT l_suppkey AS capture_id, l_orderkey AS frame, l_linenumber AS k, (l_partkey % 600) / 100.0 - 2.995 AS x, l_quantity * 0.139 AS y,
  l_tax * 25 + l_discount * 5 - 0.1 AS z, l_extendedprice AS power, l_discount * 10 - 0.5 AS doppler, l_returnflag AS scan FROM lineitem)"""


def sweeps(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select((F.col("user_id") % 3).alias("sensor_id"), "ts", (F.col("user_id") % 4).alias("range_bin"), F.col("value").alias("power"), (F.col("event_type") != "error").alias("usable"))


SWEEPS = "sweeps AS (SELECT user_id % 3 AS sensor_id, ts, user_id % 4 AS range_bin, value AS power, event_type <> 'error' AS usable FROM events)"


def events(spark: SparkSession, d: str) -> DataFrame:
    """user_id, event_id, t (whole seconds), event_type, value, k (from the properties)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return _read(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_type", "value", k.alias("k"))


EVENTS = "ev AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS t, event_type, value, (props->>'$.k')::INT AS k FROM events)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    """conv_id as track, turn as frame, the height h_s from the text's length."""
    return _read(spark, d, "conversations").select(F.col("conv_id").alias("tid"), F.col("turn").alias("frame"), (F.length("text") / 800.0).alias("h_s"), "role")


FRAMES = "frames AS (SELECT conv_id AS tid, turn AS frame, length(text) / 800.0::DOUBLE AS h_s, role FROM conversations)"


def profile(spark: SparkSession, d: str) -> DataFrame:
    """A range profile per sensor (supplier % 5): mean power of the points by range bin (part % 75)."""
    rows = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("sensor_id"), (F.col("l_partkey") % 75).cast("int").alias("range_bin"), "l_quantity")
    return rows.groupBy("sensor_id", "range_bin").agg(F.sum("l_quantity").alias("power")).withColumn("range_m", F.col("range_bin") * 0.1)


PROFILE = """prof AS (SELECT l_suppkey % 5 AS sensor_id, (l_partkey % 75)::INT AS range_bin, sum(l_quantity) AS power, (l_partkey % 75)::INT * 0.1::DOUBLE AS range_m FROM lineitem GROUP BY ALL)"""


def two_profiles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Live (returned lines) and empty (other lines) profiles of the same sensors."""
    rows = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("sensor_id"), (F.col("l_partkey") % 75).cast("int").alias("range_bin"), "l_quantity", "l_returnflag")
    base = rows.withColumn("range_m", F.col("range_bin") * 0.1)
    live, empty = (base.where(c).groupBy("sensor_id", "range_bin", "range_m").agg(F.sum("l_quantity").alias("power")) for c in (F.col("l_returnflag") == "R", F.col("l_returnflag") == "N"))
    return live, empty


TWO_PROFILES = """rows_ AS (SELECT l_suppkey % 5 AS sensor_id, (l_partkey % 75)::INT AS range_bin, (l_partkey % 75)::INT * 0.1::DOUBLE AS range_m, l_quantity, l_returnflag FROM lineitem),
live AS (SELECT sensor_id, range_bin, range_m, sum(l_quantity) AS power FROM rows_ WHERE l_returnflag = 'R' GROUP BY ALL),
empty_ AS (SELECT sensor_id, range_bin, range_m, sum(l_quantity) AS power FROM rows_ WHERE l_returnflag = 'N' GROUP BY ALL)"""


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """capture_id, range_bin, snap, re, im: snapshot s of a vector has re[a] = e[32 s + 2 a] and im[a] = e[32 s + 2 a + 1]."""
    e = _read(spark, d, "embeddings").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.col("s") * 32
    part = {n: F.transform(F.sequence(at + o, at + 30 + o, F.lit(2)), lambda i: F.col("embedding")[i]) for n, o in (("re", 0), ("im", 1))}
    return e.select((F.col("vec_id") % 4).alias("capture_id"), F.col("label").alias("range_bin"), (F.col("vec_id") * 2 + F.col("s")).alias("snap"), part["re"].alias("re"), part["im"].alias("im"))


#: One row per antenna: capture_id, range_bin, snap, a, re, im.
ANTENNAS = """ant AS (SELECT vec_id % 4 AS capture_id, label AS range_bin, vec_id * 2 + s AS snap, a, embedding[32 * s + 2 * a + 1]::DOUBLE AS re, embedding[32 * s + 2 * a + 2]::DOUBLE AS im
  FROM embeddings, (SELECT unnest(range(2)) AS s), (SELECT unnest(range(16)) AS a))"""
