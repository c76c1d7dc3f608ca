"""Runs of rows with an equal flag, and what is made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: list[str], order: list[str], flag: Column, breaks: Column | None = None) -> DataFrame:
    """Adds ``run`` (a number within the keys) and ``run_pos`` (from 1): consecutive rows of equal flag.

    breaks: a condition that starts a new run even where the flag doesn't change (a gap in time, say).
    """
    ordered = W.partitionBy(*keys).orderBy(*order)
    with_flag = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    starts = (F.col("_flag") != F.lag("_flag", 1).over(ordered)) | F.lag("_flag", 1).over(ordered).isNull()
    if breaks is not None:
        starts = starts | F.coalesce(breaks, F.lit(False))
    numbered = with_flag.withColumn("_starts", starts.cast("int")).withColumn("run", F.sum("_starts").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.withColumn("run_pos", F.row_number().over(W.partitionBy(*keys, "run").orderBy(*order))).withColumnRenamed("_flag", "run_flag").drop("_starts")


def latch(df: DataFrame, keys: list[str], order: list[str], low: Column, sustain: int = 5, clear: int = 5) -> DataFrame:
    """Adds ``down``: on from the ``sustain``-th low row of a run, off from the ``clear``-th other one; null is not low."""
    found = runs(df, keys, order, low)
    event = F.when(F.col("run_flag") & (F.col("run_pos") == sustain), 1).when(~F.col("run_flag") & (F.col("run_pos") == clear), 0)
    down = F.last(event, ignorenulls=True).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return found.withColumn("down", F.coalesce(down, F.lit(0)) == 1).drop("run", "run_pos", "run_flag")


def back_filled(df: DataFrame, keys: list[str], order: list[str], flag: Column, least: int = 5, name: str = "fallen") -> DataFrame:
    """Adds ``name``: true on all rows of runs of the flag that are ``least`` rows long or longer."""
    found = runs(df, keys, order, flag)
    size = F.count("*").over(W.partitionBy(*keys, "run"))
    return found.withColumn(name, F.col("run_flag") & (size >= least)).drop("run", "run_pos", "run_flag")


def trigger_run(df: DataFrame, keys: list[str], order: list[str], trigger: Column) -> DataFrame:
    """Adds ``run``: how many rows the trigger has held, 0 where it doesn't."""
    found = runs(df, keys, order, trigger)
    return found.withColumn("run", F.when(F.col("run_flag"), F.col("run_pos")).otherwise(0)).drop("run_pos", "run_flag")


def episodes(df: DataFrame, keys: list[str], order: str, flag: Column, reasons: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """One row per run of the flag: first, last, rows, and the union of the rows' ``reasons`` (an array column).

    ties: what orders rows of equal ``order``; without it they may come in any order.
    """
    found = runs(df, keys, [order, *(ties or [])], flag).where("run_flag")
    extra = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(reasons)))).alias("reasons")] if reasons else []
    return found.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), *extra).drop("run")


def sustained(df: DataFrame, keys: list[str], ts: str, flag: Column, gap: float) -> DataFrame:
    """Rows of the flag with ``held``: seconds since the first one, dropouts of up to ``gap`` seconds being bridged."""
    rows = df.where(flag)
    before = F.lag(ts).over(W.partitionBy(*keys).orderBy(ts))
    marked = rows.withColumn("_new", (before.isNull() | (F.col(ts) - before > gap)).cast("int"))
    held = marked.withColumn("episode", F.sum("_new").over(W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)))
    return held.withColumn("held", F.col(ts) - F.min(ts).over(W.partitionBy(*keys, "episode"))).drop("_new")


def vote(df: DataFrame, keys: list[str], order: list[str], flag: Column, rows: int = 15, share: float = 0.5, name: str = "voted") -> DataFrame:
    """Adds ``name``: whether the flag holds for a share of the last ``rows`` rows."""
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn(name, F.avg(flag.cast("double")).over(window) >= share)


def present(df: DataFrame, keys: list[str], ts: str, flag: Column, seconds: int = 25, least: int = 5, share: float = 0.5) -> DataFrame:
    """Adds ``present``: of the last ``seconds``' rows, ``least`` or more have the flag, and a share of them."""
    window = W.partitionBy(*keys).orderBy(ts).rangeBetween(-seconds, 0)
    hits = F.sum(flag.cast("int")).over(window)
    return df.withColumn("present", (hits >= least) & (hits >= share * F.count("*").over(window)))


def living(windows: DataFrame, keys: list[str], flag: Column, share: float = 0.4) -> DataFrame:
    """Per capture: whether a share of its windows has the flag."""
    return windows.groupBy(*keys).agg(F.avg(flag.cast("double")).alias("share")).withColumn("present", F.col("share") >= share)
