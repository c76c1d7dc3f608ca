"""Tables of recordings: reading the variants there are, and writing them by day and sensor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; a temporary one only where all runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucket_start(epoch: Column, seconds: int = 300) -> Column:
    """Start of the wall-clock bucket a time falls into."""
    return (epoch - F.pmod(epoch, F.lit(seconds))).cast("long")


def seconds_of(ts: Column) -> Column:
    """Epoch seconds from a number that may be milliseconds."""
    return F.when(ts > 1e12, ts / 1000).otherwise(ts)


def parsed_time(text: Column) -> Column:
    """A timestamp from either of two written forms, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def write_recordings(df: DataFrame, path: str) -> None:
    """Parquet by day and sensor; ``ts`` is a timestamp."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day", "sensor_id").parquet(path)


def read_watch_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ts in epoch seconds, bpm) of CSV files whose header names a time and a rate in one of several ways."""
    raw = spark.read.option("header", True).csv(path)

    def named(*parts: str) -> str:
        for part in parts:
            for c in raw.columns:
                if part in c.lower():
                    return c
        raise ValueError(f"no column like {parts[0]} among {raw.columns}")

    at, rate = named("epoch", "time", "date", "ts"), named("bpm", "heart", "hr", "value")
    number = F.expr(f"try_cast(`{at}` AS double)")
    ts = F.coalesce(seconds_of(number), F.unix_seconds(parsed_time(F.col(at))).cast("double"))
    return raw.select(ts.alias("ts"), F.expr(f"try_cast(`{rate}` AS double)").alias("bpm")).where("ts IS NOT NULL AND bpm IS NOT NULL")


def read_health_xml(spark: SparkSession, path: str) -> DataFrame:
    """(ts, bpm) of the heart-rate records of health exports."""
    schema = "_type string, _startDate string, _value string"
    raw = spark.read.format("xml").option("rowTag", "Record").schema(schema).load(path)
    kept = raw.where(F.col("_type").endswith("HeartRate"))
    return kept.select(F.unix_seconds(parsed_time(F.col("_startDate"))).cast("double").alias("ts"), F.expr("try_cast(_value AS double)").alias("bpm")).where("ts IS NOT NULL AND bpm IS NOT NULL")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Handshake labels (JSON lines) that had entries."""
    return spark.read.json(path).where(F.coalesce(F.col("entries"), F.lit(0)) > 0)


def posture_points(frames: DataFrame, first: int, keys: list[str], most: int = 64) -> DataFrame:
    """Wide posture rows as one row per point: keys, p (from 0), x (null where there is none), y, z, snr.

    first: the number of the first point's columns, 0 in one schema and 1 in the other.
    """
    there = [i for i in range(first, first + most) if f"pointy{i}" in frames.columns]
    parts = [F.struct(F.lit(i - first).alias("p"), *((F.col(f"{c}{i}") if f"{c}{i}" in frames.columns else F.lit(None)).cast("double").alias(n) for c, n in (("pointx", "x"), ("pointy", "y"), ("pointz", "z"), ("snr", "snr")))) for i in there]
    long = frames.select(*keys, F.explode(F.array(*parts)).alias("v"))
    return long.select(*keys, "v.*").where("y IS NOT NULL AND z IS NOT NULL")


def write_csv(df: DataFrame, path: str) -> None:
    """Rows of vitals or of a comparison with the watch, with a header; nulls are empty."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_scene(models: DataFrame, path: str) -> None:
    """Scene models, one nested JSON row per sensor."""
    models.write.mode("overwrite").partitionBy("sensor_id").json(path)


def ply_rows(points: DataFrame, keys: list[str]) -> DataFrame:
    """Vertex lines of a PLY text per key, in a fixed order: keys, line."""
    values = [F.format_string("%.4f", F.col(c)) for c in ("x", "y", "z", "mag")]
    return points.select(*keys, F.concat_ws(" ", *values).alias("line")).orderBy(*keys, "line")


def write_ply(points: DataFrame, key: str, path: str) -> None:
    """One PLY text per key below ``path``: the header with the number of vertices, then their lines in order."""
    lines = ply_rows(points, [key])
    counts = lines.groupBy(key).agg(F.count("*").alias("n"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.col("n"), *(F.lit(f"\nproperty float {c}") for c in ("x", "y", "z", "mag")), F.lit("\nend_header"))
    both = counts.select(key, F.lit(0).alias("part"), head.alias("line")).unionByName(lines.withColumn("part", F.lit(1)))
    both.repartition(key).sortWithinPartitions(key, "part", "line").select(key, "line").write.mode("overwrite").partitionBy(key).text(path)


def write_occlusion_baseline(power: DataFrame, grid: DataFrame, path: str) -> None:
    """The two tables of an occlusion baseline, by sensor: power per bin, and energy per floor cell."""
    for name, table in (("power", power), ("grid", grid)):
        table.write.mode("overwrite").partitionBy("sensor_id").parquet(f"{path}/{name}")
