"""Streaming jobs run to the end of a given table and read back from what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch
from ..streaming import jobs, live
from .registry import query


def _stream(spark: SparkSession, path: str) -> DataFrame:
    # a pattern, since a stream's path may else be no single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _drained(out: DataFrame, name: str, **trigger) -> DataFrame:
    """What a stream of all that is there has written in the end."""
    spark, path = out.sparkSession, scratch(out.sparkSession, name)
    run = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", scratch(spark, f"{name}-log")).trigger(**trigger).start(path)
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("""WITH e AS (SELECT user_id, epoch_us(ts)::BIGINT // 300000000 * 300 AS start, value FROM events), b AS (SELECT user_id, start, count(*) AS n, sum(value) AS value FROM e GROUP BY user_id, start) SELECT user_id, start, n, R(value) AS value FROM b WHERE (start + 300) * 1000000 <= (SELECT max(epoch_us(ts)) FROM events) - 10000000""", 3)
def streamed_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Five-minute blocks of a stream of events, each given out once the watermark has passed its end."""
    rows = _stream(spark, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = jobs.blocks(rows, ["user_id"], "ts", [F.count("*").alias("n"), F.sum("value").alias("value")])
    return _drained(out, "blocks", availableNow=True).select("user_id", F.unix_seconds("start").alias("start"), "n", "value")


@query("""WITH e AS (SELECT user_id % 10 AS sensor_id, user_id AS range_bin, max(epoch_us(ts)) / 1e6 AS t FROM events GROUP BY ALL), n AS (SELECT *, max(t) OVER (PARTITION BY sensor_id) AS now FROM e) SELECT sensor_id, range_bin, R(t) AS t, R(now) AS now, t >= now - 20000 AS fresh FROM n WHERE t >= now - 400000""", 3)
def live_bins(spark: SparkSession, d: str) -> DataFrame:
    """The bins that each sensor still has after all events, and which of them are fresh; their state has a time to live."""
    rows = _stream(spark, f"{d}/events.parquet").select((F.col("user_id") % 10).alias("sensor_id"), F.col("user_id").alias("range_bin"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return _drained(live.live_bins(rows, ["sensor_id"], 400_000.0, 20_000.0), "bins", once=True)
