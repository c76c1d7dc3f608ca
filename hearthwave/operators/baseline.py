"""Empty-room baselines: sweeps of power per range bin, their statistics, drift and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quantiles

#: Fixed value: from a median absolute deviation to a standard deviation.
MAD = 1.4826


def usable(sweeps: DataFrame) -> DataFrame:
    """Sweeps (sensor_id, ts, range_bin, power, usable) with hour and day, without masked and empty ones."""
    return sweeps.where(F.col("usable") & (F.col("power") > 0)).withColumns({"hour": F.hour("ts"), "day": F.to_date("ts")})


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key of some hundreds of rows (days, not samples): med (median), n, and sigma (scaled median absolute deviation); one shuffle, on the keys."""
    rows = df.withColumn("_med", F.median(value).over(W.partitionBy(*keys)))
    return rows.groupBy(*keys).agg(F.first("_med").alias("med"), F.count(value).alias("n"), (MAD * F.median(F.abs(F.col(value) - F.col("_med")))).alias("sigma"))


def bin_stats(sweeps: DataFrame, hour: int | None = None, since: Column | None = None) -> DataFrame:
    """Per sensor and bin: median, scaled deviation and number of the usable powers of its whole history, by selection."""
    rows = usable(sweeps)
    if hour is not None:
        rows = rows.where(F.col("hour") == hour)
    if since is not None:
        rows = rows.where(F.col("ts") >= since)
    return quantiles.spread(rows, ["sensor_id", "range_bin"], "power", MAD)


def hour_stats(sweeps: DataFrame, min_days: int = 3, min_samples: int = 3) -> DataFrame:
    """Dispersion over the days of each bin's level at one hour of the day, in log space: cv = exp(sigma) - 1.

    A day counts once, with its median; cells of fewer than ``min_samples`` samples or ``min_days`` days are left out.
    """
    cell = ["sensor_id", "range_bin", "hour"]
    daily = usable(sweeps).groupBy(*cell, "day").agg(F.median(F.ln("power")).alias("v"), F.count("*").alias("samples"))
    enough = daily.withColumn("samples", F.sum("samples").over(W.partitionBy(*cell))).where(F.col("samples") >= min_samples)
    found = spread(enough, cell, "v").where(F.col("n") >= min_days)
    return found.select(*cell, F.col("n").alias("days"), F.exp("med").alias("level"), (F.exp("sigma") - 1).alias("cv"))


def coverage(sweeps: DataFrame) -> DataFrame:
    """Usable samples of each bin of a sensor in each hour of the day, zeros included."""
    bins = sweeps.select("sensor_id", "range_bin").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    counts = usable(sweeps).groupBy("sensor_id", "range_bin", "hour").agg(F.count("*").alias("n"))
    return bins.join(counts, ["sensor_id", "range_bin", "hour"], "left").fillna(0, ["n"])


def furniture_events(sweeps: DataFrame, k: float = 4.0, least: float = 0.2, min_days: int = 4) -> DataFrame:
    """Days on which a bin's level jumped: |d| above k deviations of its daily steps, and above ``least``.

    A bin needs ``min_days`` days (its sensor then has them too).
    """
    cell = ["sensor_id", "range_bin"]
    by_day = W.partitionBy(*cell).orderBy("day")
    whole = W.partitionBy(*cell)
    daily = usable(sweeps).groupBy(*cell, "day").agg(F.median(F.ln("power")).alias("lvl"))
    steps = daily.withColumns({"_days": F.count("*").over(whole), "d": F.col("lvl") - F.lag("lvl").over(by_day)}).where((F.col("_days") >= min_days) & F.col("d").isNotNull())
    middle = steps.withColumn("_med", F.median("d").over(whole)).withColumns({"_n": F.count("*").over(whole), "_s": MAD * F.median(F.abs(F.col("d") - F.col("_med"))).over(whole)})
    scale = F.when(F.col("_s") == 0, 1e-9).otherwise(F.col("_s"))
    hits = middle.where((F.col("_n") >= 2) & (F.abs("d") > k * scale) & (F.abs("d") >= least))
    return hits.select(*cell, "day", "d", F.exp("d").alias("jump_x"))


def health(sweeps: DataFrame, worst: int = 8) -> DataFrame:
    """Per sensor: sweeps, span in seconds, usable share, and its ``worst`` least stable bins."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) / 1e6 - F.unix_micros(F.min("ts").cast("timestamp")) / 1e6
    whole = sweeps.groupBy("sensor_id").agg(F.countDistinct("ts").alias("sweeps"), span.alias("span_s"), F.avg(F.col("usable").cast("double")).alias("usable_frac"))
    ratio = bin_stats(sweeps).withColumn("rel", F.col("sigma") / F.col("med"))
    place = F.row_number().over(W.partitionBy("sensor_id").orderBy(F.desc("rel"), "range_bin"))
    top = ratio.withColumn("_at", place).where(F.col("_at") <= worst).groupBy("sensor_id")
    return whole.join(top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "range_bin"))), lambda s: s["range_bin"].cast("string")), ",").alias("worst_bins")), "sensor_id", "left")


def recent(sweeps: DataFrame, days: int = 7) -> DataFrame:
    """The sweeps of each sensor's last days."""
    last = sweeps.groupBy("sensor_id").agg(F.max("ts").alias("_last"))
    return sweeps.join(last, "sensor_id").where(F.col("ts") >= F.col("_last") - F.make_dt_interval(F.lit(days))).drop("_last")


def archive(sweeps: DataFrame, path: str) -> None:
    """Adds sweeps (sensor_id, ts, ...) to the archive: files by day that are never rewritten, and a row of each sensor's last time.

    The times are a table of their own, of a row per sensor and call.
    """
    sweeps.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(f"{path}/sweeps")
    sweeps.groupBy("sensor_id").agg(F.max("ts").alias("last")).write.mode("append").parquet(f"{path}/last")


def recent_archived(spark: SparkSession, path: str, days: int = 7) -> DataFrame:
    """``recent`` of the archive: only files of days that some sensor's window needs are read.

    Which days these are comes from the small table of last times, so that a sensor that is silent adds its own old days
    and not all since then.
    """
    last = spark.read.parquet(f"{path}/last").groupBy("sensor_id").agg(F.max("last").alias("_last"))
    start = F.col("_last") - F.make_dt_interval(F.lit(days))
    wanted = last.select(F.explode(F.sequence(F.to_date(start), F.to_date("_last"))).alias("day")).distinct().collect()
    stored = spark.read.parquet(f"{path}/sweeps").where(F.col("day").isin([r["day"] for r in wanted]))
    return stored.join(last, "sensor_id").where(F.col("ts") >= start).drop("_last", "day")


def mask_occupied(bins: DataFrame, occupants: DataFrame, keys: list[str], near: float = 1.0) -> DataFrame:
    """Adds ``usable``: false for bins (range_m) within ``near`` metres of an occupant (range_m) of the same sweep."""
    spots = occupants.groupBy(*keys).agg(F.collect_set("range_m").alias("_spots"))
    joined = bins.join(spots, keys, "left")
    hit = F.coalesce(F.exists("_spots", lambda r: F.abs(r - F.col("range_m")) < near), F.lit(False))
    return joined.withColumn("usable", ~hit).drop("_spots")


def hourly_sweeps(entries: DataFrame, occupants: DataFrame, keys: list[str], ts: str, near: float = 1.0) -> DataFrame:
    """The hourly job: power of each bin of an hour's snapshots, and whether nobody was near it then.

    entries: keys, ts (seconds), range_bin, re, im. occupants: keys, ts, range_m.
    """
    from .geometry import bin_range
    from .moments import bin_moments

    hour = F.floor(F.col(ts) / 3600).alias("hour")
    power = bin_moments(entries.select(*keys, hour, "range_bin", "re", "im"), [*keys, "hour", "range_bin"]).withColumn("range_m", bin_range(F.col("range_bin")))
    return mask_occupied(power, occupants.select(*keys, hour, "range_m"), [*keys, "hour"], near).select(*keys, "hour", "range_bin", "power", "usable")


def occupancy_ratio(live: DataFrame, empty: DataFrame, keys: list[str], value: str = "power") -> DataFrame:
    """(live - empty) / empty over the bins both have; keys name the bin too."""
    pair = live.join(empty.withColumnRenamed(value, "_empty"), keys)
    return pair.withColumn("ratio", (F.col(value) - F.col("_empty")) / (F.col("_empty") + 1e-12)).drop("_empty")


def hot_blocks(ratio: DataFrame, keys: list[str], near: float = 0.9, least: float = 1.0, min_block: int = 1, wall: float = 5.8, shadow: float = -0.2) -> DataFrame:
    """Contiguous blocks of hot bins, by position among the bins there are.

    ratio: keys, range_bin, range_m, ratio. A block is confirmed if its peak is nearer than the wall and one of the
    three positions before it is dark (ratio below ``shadow``).
    """
    from .islands import runs

    by_bin = W.partitionBy(*keys).orderBy("range_bin")
    lead = F.least(*(F.lag("ratio", i).over(by_bin) for i in (1, 2, 3)))
    marked = ratio.withColumn("_lead", F.coalesce(lead, F.lit(0.0)))
    hot = runs(marked, keys, ["range_bin"], (F.col("range_m") >= near) & (F.col("ratio") >= least)).where("run_flag")
    peak = F.max_by(F.struct("range_m", "range_bin"), F.struct("ratio", -F.col("range_bin")))
    found = hot.groupBy(*keys, "run").agg(
        F.min("range_m").alias("r0"), F.max("range_m").alias("r1"), F.count("*").cast("int").alias("n_bins"), F.max("ratio").alias("peak_ratio"),
        peak.alias("_peak"), F.min_by("_lead", "range_bin").alias("shadow"),
    ).where(F.col("n_bins") >= min_block)
    confirmed = (F.col("_peak.range_m") < wall) & (F.col("shadow") < shadow)
    return found.select(*keys, "r0", "r1", "n_bins", "peak_ratio", F.col("_peak.range_m").alias("peak_range"), F.col("_peak.range_bin").alias("peak_bin"), "shadow", confirmed.alias("confirmed"))


def longest_rise(live: DataFrame, empty: DataFrame, keys: list[str], above_db: float = 3.0, near: float = 0.9) -> DataFrame:
    """The widest contiguous rise of the live profile over the empty one, each less its own median, and its lying score.

    live, empty: keys, range_bin, range_m (live), power_db.
    """
    from .islands import runs

    def flat(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.col("power_db") - F.median("power_db").over(W.partitionBy(*keys))).drop("power_db")

    pair = flat(live, "_l").join(flat(empty, "_e").drop("range_m"), [*keys, "range_bin"])
    delta = pair.withColumn("delta", F.col("_l") - F.col("_e"))
    rises = runs(delta, keys, ["range_bin"], (F.col("range_m") >= near) & (F.col("delta") > above_db)).where("run_flag")
    per = rises.groupBy(*keys, "run").agg((F.max("range_m") - F.min("range_m")).alias("span_m"), F.avg("delta").alias("excess_db"), F.count("*").alias("n"), F.min("range_bin").alias("first_bin"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("span_m", "excess_db", "n", "first_bin"), F.struct("span_m", -F.col("first_bin"))).alias("b"))
    return best.select(*keys, "b.span_m", "b.excess_db", "b.n", "b.first_bin", (F.col("b.span_m") * F.greatest(F.col("b.excess_db"), F.lit(0.0))).alias("lying_score"))


def motion_span(live: DataFrame, empty: DataFrame, keys: list[str], above_db: float = 15.0, near: float = 0.9) -> DataFrame:
    """Span and peak of the bins whose motion rose; live, empty: keys, range_bin, range_m (live), motion."""
    pair = live.join(empty.select(*keys, "range_bin", F.col("motion").alias("_e")), [*keys, "range_bin"])
    change = F.when(F.col("range_m") >= near, 10 * F.log10(F.col("motion") + 1e-9) - 10 * F.log10(F.col("_e") + 1e-9)).otherwise(-99.0)
    rows = pair.withColumn("change_db", change)
    hot = F.when(F.col("change_db") > above_db, F.col("range_m"))
    peak = F.max_by("range_m", F.struct("change_db", -F.col("range_bin")))
    return rows.groupBy(*keys).agg(F.coalesce(F.max(hot) - F.min(hot), F.lit(0.0)).alias("span_m"), F.max("change_db").alias("peak_db"), peak.alias("peak_range"), F.count(hot).alias("n_hot"))


def range_cfar(profile: DataFrame, keys: list[str], half: int = 4, factor: float = 2.0) -> DataFrame:
    """Bins above ``factor`` times the median of their neighbours (itself left out), and local maxima: column ``peak``."""
    by_bin = W.partitionBy(*keys).orderBy("range_bin")
    around = F.concat(F.collect_list("power").over(by_bin.rowsBetween(-half, -1)), F.collect_list("power").over(by_bin.rowsBetween(1, half)))
    sorted_ = F.array_sort("_around")
    n = F.size("_around")
    middle = (F.element_at(sorted_, F.floor((n + 1) / 2).cast("int")) + F.element_at(sorted_, F.floor((n + 2) / 2).cast("int"))) / 2
    rows = profile.withColumn("_around", around).withColumn("local", F.when(n > 0, middle)).drop("_around")
    above = F.col("power") > factor * F.col("local")
    top = (F.col("power") > F.coalesce(F.lag("power").over(by_bin), F.lit(-1.0))) & (F.col("power") >= F.coalesce(F.lead("power").over(by_bin), F.lit(-1.0)))
    return rows.withColumn("peak", F.coalesce(above & top, F.lit(False)))


def surface_kind(profile: DataFrame, keys: list[str], half: int = 5) -> DataFrame:
    """glint, surface or void by a bin's level less its rolling median, against the capture's 80th and 30th percentile."""
    by_bin = W.partitionBy(*keys).orderBy("range_bin").rowsBetween(-half, half)
    rows = profile.withColumn("resid", F.col("power") - F.percentile("power", 0.5).over(by_bin))
    high, low = (F.percentile("resid", q).over(W.partitionBy(*keys)) for q in (0.8, 0.3))
    return rows.withColumn("kind", F.when(F.col("resid") >= high, "glint").when(F.col("resid") <= low, "void").otherwise("surface"))


def range_variance(profiles: DataFrame, keys: list[str], frames: int = 50, least: int = 5) -> DataFrame:
    """Adds ``var``: each bin's variance over the last ``frames`` profiles (0 before ``least`` are there)."""
    window = W.partitionBy(*keys, "range_bin").orderBy("frame").rowsBetween(-(frames - 1), 0)
    return profiles.withColumn("var", F.when(F.count("mag").over(window) >= least, F.var_pop("mag").over(window)).otherwise(0.0))


def presence_bands(var: DataFrame, keys: list[str], strong: float = 1000.0, weak: float = 100.0, ratio: float = 5.0, first: int = 4, last: int = 74) -> DataFrame:
    """Runs of bins with a strong variance, or a weak one well above its calibration (column cal).

    A run that reaches the last bin ends after it; one that starts there is not given out.
    """
    from .islands import runs

    rows = var.where(F.col("range_bin").between(first, last))
    tier = F.when(F.col("var") >= strong, 2).when((F.col("var") >= weak) & (F.col("var") >= ratio * F.greatest(F.col("cal"), F.lit(1.0))), 1).otherwise(0)
    hot = runs(rows.withColumn("_tier", tier), keys, ["range_bin"], F.col("_tier") > 0).where("run_flag")
    peak = F.max_by("range_bin", F.struct("var", -F.col("range_bin")))
    per = hot.groupBy(*keys, "run").agg(F.min("range_bin").alias("bin_start"), (F.max("range_bin") + 1).alias("bin_end"), peak.alias("peak_bin"), F.max("var").alias("peak_var"), F.max("_tier").alias("_t"))
    return per.where(F.col("bin_start") < last).select(*keys, "bin_start", "bin_end", "peak_bin", "peak_var", F.when(F.col("_t") == 2, "strong").otherwise("weak").alias("tier"))


def compare_profiles(a: DataFrame, b: DataFrame, keys: list[str], floor: float = 10.0) -> DataFrame:
    """Of two range-profile recordings, per bin: change of mean and variance, and their ratio where a's is above ``floor``."""

    def moments(df: DataFrame, n: str) -> DataFrame:
        return df.groupBy(*keys, "range_bin").agg(F.avg("mag").alias(f"mean_{n}"), F.var_pop("mag").alias(f"var_{n}"))

    pair = moments(a, "a").join(moments(b, "b"), [*keys, "range_bin"])
    return pair.withColumns({"d_mean": F.col("mean_b") - F.col("mean_a"), "d_var": F.col("var_b") - F.col("var_a"), "ratio": F.when(F.col("mean_a") > floor, F.col("mean_b") / F.col("mean_a"))})


def robust_line(points: DataFrame, keys: list[str], x: str, y: str, rounds: int = 3, limit: float = 2.0) -> DataFrame:
    """Slope and intercept of y over log10(x), fitted again without what is ``limit`` or more off."""
    rows = points.withColumn("_x", F.log10(x))
    fitted = None
    for _ in range(rounds):
        fitted = rows.groupBy(*keys).agg(F.regr_slope(y, "_x").alias("slope"), F.regr_intercept(y, "_x").alias("intercept"), F.count("*").alias("n"))
        rows = rows.join(fitted.drop("n"), keys).where(F.abs(F.col(y) - F.col("slope") * F.col("_x") - F.col("intercept")) < limit).drop("slope", "intercept")
    return fitted


def front_wall(profile: DataFrame, keys: list[str], low: float = 4.0, high: float = 6.8) -> DataFrame:
    """Range of the strongest bin between two ranges."""
    inside = profile.where(F.col("range_m").between(low, high))
    return inside.groupBy(*keys).agg(F.max_by("range_m", F.struct("power", -F.col("range_m"))).alias("wall_m"), F.max("power").alias("power"))
