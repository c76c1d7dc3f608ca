"""How estimates compare with what is known, and small rolling statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def errors(df: DataFrame, segment: str, d: str, limit: float) -> DataFrame:
    """Per segment and over all: n, mean absolute error, bias, median, percent within ``limit``."""
    found = df.rollup(segment).agg(
        F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.percentile(F.col(d), 0.5).alias("med"), (F.avg((F.abs(d) <= limit).cast("double")) * 100).alias("in_range"), F.grouping(segment).alias("_all")
    )
    return found.withColumn(segment, F.when(F.col("_all") == 1, "all").otherwise(F.col(segment))).drop("_all")


def trigger_rates(df: DataFrame, label: str, trigger: Column) -> DataFrame:
    """Per class: rows and the share that triggers (recall for falls, false positives for the others)."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.avg(trigger.cast("double")).alias("rate"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows of each pair of classes, and their share of the true class."""
    counts = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(truth)))


def rolling_median(df: DataFrame, keys: list[str], order: str, value: str, rows: int, name: str) -> DataFrame:
    return df.withColumn(name, F.percentile(value, 0.5).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)))


def trimmed_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean without a quarter of the values (one at least) at each end; of fewer than three values, of all."""
    placed = df.withColumns({"_at": F.row_number().over(W.partitionBy(*keys).orderBy(value)), "_n": F.count(value).over(W.partitionBy(*keys))})
    cut = F.when(F.col("_n") < 3, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") / 4)))
    return placed.where((F.col("_at") > cut) & (F.col("_at") <= F.col("_n") - cut)).groupBy(*keys).agg(F.avg(value).alias("trimmed"))


def rate_vote(df: DataFrame, keys: list[str], rate: str, weight: str, width: float = 1.0) -> DataFrame:
    """The middle of the histogram bar with most weight; the lower one on a tie."""
    bars = df.groupBy(*keys, F.floor(F.col(rate) / width).alias("_bar")).agg(F.sum(weight).alias("_w"))
    return bars.groupBy(*keys).agg(((F.max_by("_bar", F.struct("_w", -F.col("_bar"))) + 0.5) * width).alias("mode"), F.max("_w").alias("weight"))
