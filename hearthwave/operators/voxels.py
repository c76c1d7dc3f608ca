"""Occupancy and energy over voxels: sparse rows per cell, absent cells being zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import geometry as g

CELLS = ["ix", "iy", "iz"]


def voxel_map(points: DataFrame, keys: list[str], intensity: Column | None = None) -> DataFrame:
    """Per cell: log_odds (20 a hit, 2000 at most), hit_count and intensity (65535 at most), lowest and highest layer.

    All increments are positive, so the capped sum is the same as capping at each step.
    """
    value = F.lit(100) if intensity is None else intensity
    cells = points.withColumns(g.voxel_index(F.col("x"), F.col("y"), F.col("z"))).where(g.in_grid())
    n = F.count("*")
    return cells.groupBy(*keys, *CELLS).agg(
        F.least(20 * n, F.lit(2000)).cast("int").alias("log_odds"), F.least(n, F.lit(65535)).cast("int").alias("hit_count"),
        F.least(F.sum(value), F.lit(65535)).cast("int").alias("intensity"), F.min("iz").alias("z_min"), F.max("iz").alias("z_max"),
    )


def point_counts(points: DataFrame, keys: list[str], cell: float = 0.2, low: tuple = (-3.0, 0.0, 0.0), high: tuple = (3.0, 7.0, 2.5)) -> DataFrame:
    """Points per cell within bounds (lower included, upper not)."""
    return _cells(points, cell, low, high).groupBy(*keys, *CELLS).agg(F.count("*").alias("n"))


def _cells(points: DataFrame, cell: float, low: tuple, high: tuple) -> DataFrame:
    inside = points
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside.where((F.col(c) >= a) & (F.col(c) < b))
    last = [round((b - a) / cell) - 1 for a, b in zip(low, high, strict=True)]
    return inside.withColumns({i: F.least(((F.col(c) - a) / cell).cast("int"), F.lit(n)) for i, c, a, n in zip(CELLS, "xyz", low, last, strict=True)})


def energy_density(cloud: DataFrame, keys: list[str], cell: float = 0.3, low: tuple = (-3.0, 0.0, -0.1), high: tuple = (3.0, 7.0, 2.5), normalize: bool = True) -> DataFrame:
    """Power per cell (column e); with normalize, a cloud's cells sum to 1."""
    sums = _cells(cloud, cell, low, high).groupBy(*keys, *CELLS).agg(F.sum("power").alias("e"))
    if not normalize:
        return sums
    total = F.sum("e").over(W.partitionBy(*keys))  # over a capture's cells, of which there are few
    return sums.withColumn("_total", total).withColumn("e", F.when(F.col("_total") > 0, F.col("e") / F.col("_total")).otherwise(F.col("e"))).drop("_total")


def energy_change(base: DataFrame, event: DataFrame, keys: list[str]) -> DataFrame:
    """Event minus base (column d) over the cells of either."""
    zero = F.lit(0.0)
    pair = event.withColumnRenamed("e", "_e").join(base.withColumnRenamed("e", "_b"), [*keys, *CELLS], "full")
    return pair.select(*keys, *CELLS, (F.coalesce("_e", zero) - F.coalesce("_b", zero)).alias("d"))


def stable_voxels(points: DataFrame, keys: list[str], cell: float = 0.1, least: int = 10, floor: float = 0.0) -> DataFrame:
    """Centres of cells (floor division) with so many points, those below the floor left out first."""
    index = {i: F.floor(F.col(c) / cell).cast("int") for i, c in zip(CELLS, "xyz", strict=True)}
    dense = points.where(F.col("z") >= floor).withColumns(index).groupBy(*keys, *CELLS).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return dense.withColumns({c: (F.col(i) + 0.5) * cell for i, c in zip(CELLS, "xyz", strict=True)})


def votes(counts: DataFrame, keys: list[str], scan: str, occupied: int, least: int) -> DataFrame:
    """Cells that hold ``occupied`` points or more in at least ``least`` scans."""
    return counts.where(F.col("n") >= occupied).groupBy(*keys, *CELLS).agg(F.countDistinct(scan).alias("scans")).where(F.col("scans") >= least)


def floor_plan(counts: DataFrame, keys: list[str], least: int = 1, low_layers: int = 2) -> DataFrame:
    """Per column of cells: occupied layers near the floor and above."""
    low = F.col("iz") < low_layers
    taken = counts.where(F.col("n") >= least)
    return taken.groupBy(*keys, "ix", "iy").agg(F.count_if(low).alias("floor_layers"), F.count_if(~low).alias("upper_layers"))


def appeared(change: DataFrame, keys: list[str], share: float = 0.3) -> DataFrame:
    """Cells whose gain is above a share of the capture's peak gain, with their centres."""
    gain = F.greatest(F.col("d"), F.lit(0.0))
    return change.withColumn("_peak", F.max(gain).over(W.partitionBy(*keys))).where((gain > share * F.col("_peak")) & (F.col("_peak") > 0)).drop("_peak").withColumns(g.voxel_centre(0.3, -3.0))


def clarity(energy: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """Occupied cells, total, Gini index over all ``cells`` of the grid (absent ones are zero), energy per cell."""
    by_energy = W.partitionBy(*keys).orderBy("e", *CELLS)
    n = F.count("*").over(W.partitionBy(*keys))
    ranked = energy.where("e > 0").withColumn("_i", F.row_number().over(by_energy) + cells - n)
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("occupied"), F.sum("e").alias("total"), F.sum(F.col("_i") * F.col("e")).alias("_weighted"))
    gini = 2 * F.col("_weighted") / (cells * F.col("total")) - (cells + 1) / cells
    return sums.select(*keys, "occupied", "total", gini.alias("gini"), (F.col("total") / F.col("occupied")).alias("density"))


def column_spread(energy: DataFrame, keys: list[str], cell: float = 0.3) -> DataFrame:
    """Energy-weighted spread of height in each column of cells, averaged."""
    z = (F.col("iz") + 0.5) * cell
    sums = energy.groupBy(*keys, "ix", "iy").agg(F.sum("e").alias("s"), F.sum(F.col("e") * z).alias("m"), F.sum(F.col("e") * z * z).alias("q")).where("s > 0")
    spread = F.sqrt(F.greatest(F.col("q") / F.col("s") - (F.col("m") / F.col("s")) ** 2, F.lit(0.0)))
    return sums.groupBy(*keys).agg(F.avg(spread).alias("z_spread"))


def floor_anomaly(change: DataFrame, keys: list[str], layers: int = 2) -> DataFrame:
    """New energy near the floor: total, and the column of cells with most of it."""
    new = change.where((F.col("iz") < layers) & (F.col("d") > 0)).groupBy(*keys, "ix", "iy").agg(F.sum("d").alias("s"))
    peak = F.max_by(F.struct("ix", "iy"), F.struct("s", -F.col("ix"), -F.col("iy")))
    return new.groupBy(*keys).agg(F.sum("s").alias("total"), peak.alias("_p"), F.max("s").alias("peak")).select(*keys, "total", F.col("_p.ix").alias("ix"), F.col("_p.iy").alias("iy"), "peak")


def ema_difference(energy: DataFrame, keys: list[str], alpha: float, frames: str, window: int) -> DataFrame:
    """Per cell: the mean of the last ``window`` frames minus a slow baseline A <- (1 - alpha) A + alpha e, A first 0.

    In closed form, so that no frame waits for another: each frame's energy counts alpha (1 - alpha)^(frames after it).
    energy: keys, cells, the frame's number from 1 (column ``frames``), e. A frame without the cell adds nothing.
    """
    last = energy.groupBy(*keys).agg(F.max(frames).alias("_last"))
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("_last") - F.col(frames))
    sums = energy.join(last, keys).groupBy(*keys, *CELLS).agg(F.sum(weight * F.col("e")).alias("slow"), (F.sum(F.when(F.col(frames) > F.col("_last") - window, F.col("e")).otherwise(0.0)) / window).alias("now"))
    return sums.withColumn("d", F.col("now") - F.col("slow"))


def day_maps(energy: DataFrame, counts: DataFrame, keys: list[str], alpha: float, day: str, frames: str) -> DataFrame:
    """(keys, day, cells, s): what each day alone adds to the slow baseline by its end.

    energy: keys, day, cells, the frame's number within its day from 1, e. counts: keys, day, n (frames of the day).
    With the factor (1 - alpha)^n that a day leaves of what was before, these pairs combine in any grouping of days.
    """
    weight = alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col(frames))
    return energy.join(counts, [*keys, day]).groupBy(*keys, day, *CELLS).agg(F.sum(weight * F.col("e")).alias("s"))


def slow_map(parts: DataFrame, counts: DataFrame, keys: list[str], alpha: float, day: str) -> DataFrame:
    """(keys, cells, slow): the baseline after all days from ``day_maps``; only the days' numbers of frames are added up in order."""
    after = F.sum("n").over(W.partitionBy(*keys).orderBy(F.desc(day))) - F.col("n")
    left = counts.select(*keys, day, F.pow(F.lit(1 - alpha), after).alias("_f"))
    return parts.join(left, [*keys, day]).groupBy(*keys, *CELLS).agg(F.sum(F.col("s") * F.col("_f")).alias("slow"))


def advanced_map(before: DataFrame, parts: DataFrame, counts: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """The baseline (keys, cells, slow) a day later, from the stored one and that day's part alone: no earlier day is read.

    parts: keys, cells, s; counts: keys, n. A sensor without frames that day keeps its map.
    """
    met = before.join(parts, [*keys, *CELLS], "full").join(counts, keys, "left")
    left = F.pow(F.lit(1 - alpha), F.coalesce("n", F.lit(0)))
    return met.select(*keys, *CELLS, (F.coalesce("slow", F.lit(0.0)) * left + F.coalesce("s", F.lit(0.0))).alias("slow"))


def boxes(points: DataFrame, keys: list[str], cluster: str = "cluster_id", least: int = 4) -> DataFrame:
    """Axis-aligned box of each cluster (noise is cluster -1), sides 0.05 m at least, with its label."""
    ranges = [f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))]
    found = points.where(F.col(cluster) >= 0).groupBy(*keys, cluster).agg(F.count("*").alias("n"), *ranges).where(F.col("n") >= least)
    centre = {f"c{c}": (F.col(f"_a{c}") + F.col(f"_b{c}")) / 2 for c in "xyz"}
    size = {f"s{c}": F.greatest(F.col(f"_b{c}") - F.col(f"_a{c}"), F.lit(0.05)) for c in "xyz"}
    labelled = found.withColumns(centre | size).withColumn("label", g.box_label(F.col("cz") + F.col("sz") / 2, F.greatest("sx", "sy")))
    return labelled.select(*keys, cluster, "n", *centre, *size, "label")


def percentile_boxes(points: DataFrame, keys: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Box between the 5th and 95th percentile of each cluster."""
    parts = [F.percentile(F.col(c), p).alias(f"{c}{n}") for c in "xyz" for n, p in ((0, 0.05), (1, 0.95))]
    return points.groupBy(*keys, cluster).agg(F.count("*").alias("n"), *parts)


def merged_boxes(parts: DataFrame, keys: list[str], track: str = "tid") -> DataFrame:
    """The boxes of one track's fragments as one."""
    edges = [f(f"{c}{n}").alias(f"{c}{n}") for c in "xyz" for n, f in ((0, F.min), (1, F.max))]
    return parts.groupBy(*keys, track).agg(F.sum("n").alias("n"), *edges)


def cluster_features(points: DataFrame, keys: list[str], floor_z: float = 0.4) -> DataFrame:
    """Centroid, share below ``floor_z``, 90th percentile and median of height, extent along y."""
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), *(F.avg(c).alias(f"c{c}") for c in "xyz"), F.avg((F.col("z") < floor_z).cast("double")).alias("floor_frac"),
        F.percentile("z", 0.9).alias("z90"), F.percentile("z", 0.5).alias("z_med"), (F.max("y") - F.min("y")).alias("y_span"),
    )


def weighted_height(energy: DataFrame, keys: list[str], z: str, weight: str, q: float = 0.9, floor_z: float = 0.4) -> DataFrame:
    """The first height at which the cumulative weight reaches ``q``, the share below ``floor_z``, the mean height."""
    by_z = W.partitionBy(*keys).orderBy(z, weight).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.sum(weight).over(W.partitionBy(*keys))
    summed = energy.where(F.col(weight) > 0).withColumns({"_up": F.sum(weight).over(by_z), "_all": total})
    return summed.groupBy(*keys).agg(
        F.min(F.when(F.col("_up") >= q * F.col("_all"), F.col(z))).alias("z_q"), (F.sum(F.when(F.col(z) < floor_z, F.col(weight)).otherwise(0.0)) / F.sum(weight)).alias("floor_frac"),
        (F.sum(F.col(z) * F.col(weight)) / F.sum(weight)).alias("z_mean"),
    )


def cloud_heights(points: DataFrame, keys: list[str], floor_z: float = 0.4) -> DataFrame:
    """Of each whole cloud: points, median and mean height, and the share of points below ``floor_z``."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("z", 0.5).alias("z_med"), F.avg("z").alias("z_mean"), F.avg((F.col("z") < floor_z).cast("double")).alias("below"))


def scans_together(scans: dict[str, DataFrame], name: str = "scan") -> DataFrame:
    """The clouds of several scans as one table, each row with its scan's name; columns that one lacks are null there."""
    found = None
    for scan, cloud in scans.items():
        own = cloud.withColumn(name, F.lit(scan))
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found
