"""Exact quantiles of long histories: selection by counts per value range, so that no task holds a key's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clusters import checkpointed

#: Ranges that the values between a rank's bounds are counted in, each time; rounds until the bounds meet.
RANGES, ROUNDS = 1024, 400


def _magnitude(v: Column) -> Column:
    """Grows with the value, as its logarithm does on either side of 0."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 746))


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key: n (values that count) and the exact quantile of each name, interpolated between the two ranks around it.

    Each round counts the values between the bounds of each rank in RANGES ranges, equal in the values or in their
    magnitudes by turns, each with its least and greatest value; the range that holds the rank gives the next bounds.
    Four or five rounds do for a billion values, however they are spread. A round reads
    the two columns and shuffles counts only. Null and not-a-number values don't count; a key of none of them gives no
    row; keys may be null.
    """
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    whole = rows.groupBy("_key").agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in shares.items()))
    place = whole.withColumn("_w", F.explode(wanted)).withColumn("_at", F.col("_w.q") * (F.col("_n") - 1))
    ranks = place.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))))
    now = checkpointed(ranks.select("_key", "_n", F.col("_w.name").alias("_name"), "_at", "_rank", "_low", "_high", F.lit(0).cast("long").alias("_below")))
    for time in range(ROUNDS):
        open_ = now.where("_low < _high")
        if open_.isEmpty():
            break
        bounds = open_.select("_key", "_low", "_high").distinct()
        inside = rows.join(bounds, "_key").where(F.col("_v").between(F.col("_low"), F.col("_high")))
        v, low, high = (_magnitude(F.col(c)) if time % 2 == 0 else F.col(c) for c in ("_v", "_low", "_high"))
        half = F.when(high - low > 1e308, 0.5).otherwise(1.0)  # so that no difference is infinite
        share = F.coalesce(F.try_divide(v * half - low * half, high * half - low * half), F.lit(0.0))
        bins = inside.groupBy("_key", "_low", "_high", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("_bin")).agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = F.sum("_c").over(W.partitionBy("_key", "_low", "_high").orderBy("_bin")) - F.col("_c")
        placed = open_.join(bins.withColumn("_before", before), ["_key", "_low", "_high"])
        here = (F.col("_below") + F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_below") + F.col("_before") + F.col("_c"))
        moved = placed.where(here).select("_key", "_n", "_name", "_at", "_rank", F.col("_least").alias("_low"), F.col("_most").alias("_high"), (F.col("_below") + F.col("_before")).alias("_below"))
        now = checkpointed(now.where("_low >= _high").unionByName(moved))
    else:
        raise RuntimeError(f"the quantiles weren't found within {ROUNDS} rounds")
    low, high = F.min_by("_low", "_rank"), F.max_by("_low", "_rank")
    over = F.first("_at") - F.min("_rank")
    value_of = F.when(low == high, low).otherwise(low * (1 - over) + high * over)
    found = now.groupBy("_key", "_name").agg(F.first("_n").alias("n"), value_of.alias("_q"))
    wide = found.groupBy("_key").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("_name") == name, F.col("_q"))).alias(name) for name in shares))
    return wide.select("_key.*", "n", *shares)


def spread(df: DataFrame, keys: list[str], value: str, scale: float) -> DataFrame:
    """Per key: med (median), n, and sigma (``scale`` times the median absolute deviation); keys must not be null."""
    middle = checkpointed(quantiles(df, keys, value, {"med": 0.5}))
    away = df.join(middle.select(*keys, "med"), keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    deviation = quantiles(away, keys, "_d", {"mad": 0.5})
    return middle.join(deviation.drop("n"), keys).select(*keys, "med", "n", (scale * F.col("mad")).alias("sigma"))
