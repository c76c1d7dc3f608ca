"""Interval, as-of and nearest joins. Both sides of an interval join are put into time buckets, so that Spark joins on equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, start: str, end: str, bucket: float) -> DataFrame:
    """Pairs where ``start <= at <= end``; right's intervals are repeated in each bucket that they touch."""
    a = left.withColumn("_b", F.floor(F.col(at) / bucket))
    b = right.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return a.join(b, [*keys, "_b"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def chunk_of(labels: DataFrame, chunks: DataFrame, keys: list[str], label_id: str, at: str, chunk_id: str, slack: float = 1.0, bucket: float = 3600.0) -> DataFrame:
    """The first recording chunk (start, end) whose span, with ``slack`` seconds, holds a label's time."""
    wide = chunks.select(*keys, chunk_id, (F.col("start") - slack).alias("_from"), (F.col("end") + slack).alias("_to"))
    met = interval_join(labels, wide, keys, at, "_from", "_to", bucket)
    return met.groupBy(*keys, label_id, at).agg(F.min(chunk_id).alias(chunk_id))


def around(labels: DataFrame, rows: DataFrame, keys: list[str], at: str, ts: str, before: float, after: float, bucket: float = 60.0) -> DataFrame:
    """Rows whose ``ts`` is within [at - before, at + after] of a label."""
    wide = labels.withColumns({"_from": F.col(at) - before, "_to": F.col(at) + after})
    return interval_join(rows, wide, keys, ts, "_from", "_to", bucket).drop("_from", "_to")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, ts: str, value: str) -> DataFrame:
    """Adds prev_ts, prev, next_ts, next: right's last row at or before ``at`` and its first at or after it.

    The two tables are laid into one order per key; no pair is formed.
    """
    own = left.select("*", F.lit(None).cast("double").alias("_v"), F.col(at).cast("double").alias("_t"), F.lit(1).alias("_left"))
    other = right.select(*keys, F.col(value).cast("double").alias("_v"), F.col(ts).cast("double").alias("_t"), F.lit(0).alias("_left"))
    both = own.unionByName(other, allowMissingColumns=True)
    mark = F.when(F.col("_left") == 0, F.struct("_t", "_v"))
    back = F.last(mark, ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", "_left").rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(mark, ignorenulls=True).over(W.partitionBy(*keys).orderBy("_t", F.desc("_left")).rowsBetween(0, W.unboundedFollowing))
    found = both.withColumns({"_p": back, "_n": ahead}).where("_left = 1")
    return found.select(*left.columns, F.col("_p._t").alias("prev_ts"), F.col("_p._v").alias("prev"), F.col("_n._t").alias("next_ts"), F.col("_n._v").alias("next"))


def interpolated(pairs: DataFrame, at: str, name: str = "interp") -> DataFrame:
    """From ``as_of``: the value at ``at`` on the line between its neighbours; beyond the ends the end's value."""
    t = F.col(at).cast("double")
    gap = F.col("next_ts") - F.col("prev_ts")
    inner = F.when(gap > 0, F.col("prev") + (F.col("next") - F.col("prev")) * (t - F.col("prev_ts")) / gap).otherwise(F.col("prev"))
    return pairs.withColumn(name, F.when(F.col("prev_ts").isNull(), F.col("next")).when(F.col("next_ts").isNull(), F.col("prev")).otherwise(inner))


def nearest(pairs: DataFrame, at: str, limit: float, name: str = "nearest") -> DataFrame:
    """From ``as_of``: the nearer neighbour's value (the earlier on a tie) if it is within ``limit`` seconds."""
    t = F.col(at).cast("double")
    back, ahead = t - F.col("prev_ts"), F.col("next_ts") - t
    first = ahead.isNull() | (back <= ahead)
    gap, value = F.when(first, back).otherwise(ahead), F.when(first, F.col("prev")).otherwise(F.col("next"))
    return pairs.withColumn(name, F.when(gap < limit, value))


def watch_reference(windows: DataFrame, watch: DataFrame, keys: list[str], at: str, half: float = 15.0) -> DataFrame:
    """Adds ``ref``: the watch's mean within ``half`` seconds of a window's time, else its value on the line there."""
    met = around(windows.select(*keys, at).distinct(), watch.select(*keys, "ts", "bpm"), keys, at, "ts", half, half, max(4 * half, 1.0))
    mean = met.groupBy(*keys, at).agg(F.avg("bpm").alias("_mean"))
    line = interpolated(as_of(windows, watch, keys, at, "ts", "bpm"), at, "_line").drop("prev_ts", "prev", "next_ts", "next")
    return line.join(mean, [*keys, at], "left").withColumn("ref", F.coalesce("_mean", "_line")).drop("_mean", "_line")


def with_distance(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "t") -> DataFrame:
    """Pairs of the same key with their squared distance on the floor (column d2); right's x and y get a prefix."""
    other = right.withColumnsRenamed({"x": f"{prefix}x", "y": f"{prefix}y"})
    return left.join(other, keys).withColumn("d2", (F.col("x") - F.col(f"{prefix}x")) ** 2 + (F.col("y") - F.col(f"{prefix}y")) ** 2)


def nearest_track(clusters: DataFrame, tracks: DataFrame, keys: list[str], cluster: str = "cluster_id", gate: float = 0.8) -> DataFrame:
    """Each cluster with the nearest track of its frame within the gate (strictly), else null (an orphan)."""
    met = with_distance(clusters, tracks.select(*keys, "tid", "x", "y"), keys).where(F.col("d2") < gate * gate)
    best = met.groupBy(*keys, cluster).agg(F.min_by("tid", F.struct("d2", "tid")).alias("tid"), F.sqrt(F.min("d2")).alias("distance"))
    return clusters.join(best, [*keys, cluster], "left")


def points_of_tracks(points: DataFrame, tracks: DataFrame, keys: list[str], gate: float = 0.75) -> DataFrame:
    return with_distance(points, tracks.select(*keys, "tid", "x", "y"), keys).where(F.col("d2") <= gate * gate)


def track_deaths(tracks: DataFrame, frames: DataFrame, keys: list[str], order: str, track: str) -> DataFrame:
    """Tracks that are in a frame and not in the next one: the last row of each, with the frame that misses it.

    ``order`` numbers frames without gaps per key.
    """
    following = frames.select(*keys, (F.col(order) - 1).alias(order), F.col(order).alias("died"))
    seen = tracks.select(*keys, track, (F.col(order) - 1).alias(order))
    return tracks.join(following, [*keys, order]).join(seen, [*keys, track, order], "left_anti")


def recent_deaths(blobs: DataFrame, deaths: DataFrame, keys: list[str], ts: str, within: float = 8.0, gate: float = 1.6) -> DataFrame:
    """Blobs near which a track died lately: adds tid and age of the latest death."""
    lately = deaths.select(*keys, "tid", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col(ts).alias("died_ts")).withColumn("_to", F.col("died_ts") + within)
    met = interval_join(blobs, lately, keys, ts, "died_ts", "_to", within).where((F.col("x") - F.col("dx")) ** 2 + (F.col("y") - F.col("dy")) ** 2 <= gate * gate)
    best = F.max_by(F.struct("tid", "died_ts"), F.struct("died_ts", "tid"))
    return met.groupBy(*blobs.columns).agg(best.alias("_d")).select(*blobs.columns, F.col("_d.tid").alias("tid"), (F.col(ts) - F.col("_d.died_ts")).alias("age"))


def not_walked_off(deaths: DataFrame, upright: DataFrame, keys: list[str], gate: float = 1.5) -> DataFrame:
    """Deaths without an upright cluster of the same frame near them."""
    other = upright.select(*keys, F.col("x").alias("_ux"), F.col("y").alias("_uy"))
    cond = [deaths[k] == other[k] for k in keys]
    near = (deaths["x"] - other["_ux"]) ** 2 + (deaths["y"] - other["_uy"]) ** 2 <= gate * gate
    return deaths.join(other, [*cond, near], "left_anti")


def nearest_burst(queries: DataFrame, bursts: DataFrame, keys: list[str], max_bins: int = 10, max_frames: int = 150) -> DataFrame:
    """For each query (frame, range_bin): the recorded burst near in bin and frame, a later one first, then the nearest."""
    b = bursts.select(*keys, F.col("frame").alias("b_frame"), F.col("range_bin").alias("b_bin")).withColumns({"_from": F.col("b_frame") - max_frames, "_to": F.col("b_frame") + max_frames})
    met = interval_join(queries, b, keys, "frame", "_from", "_to", max_frames).where(F.abs(F.col("range_bin") - F.col("b_bin")) <= max_bins)
    order = F.struct((F.col("b_frame") < F.col("frame")).cast("int"), F.abs(F.col("b_frame") - F.col("frame")), F.abs(F.col("range_bin") - F.col("b_bin")), "b_bin")
    best = met.groupBy(*keys, "frame", "range_bin").agg(F.min_by(F.struct("b_frame", "b_bin"), order).alias("_b"))
    return best.select(*keys, "frame", "range_bin", F.col("_b.b_frame").alias("b_frame"), F.col("_b.b_bin").alias("b_bin"))


def supported(boxes: DataFrame, anchors: DataFrame, keys: list[str], box: str, margin: float = 0.3) -> DataFrame:
    """Adds ``support``: the kinds of corner or motion anchor (kind, x, y) inside a box's footprint with a margin, sorted."""
    a = anchors.select(*keys, "kind", F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    inside = (F.abs(F.col("_ax") - F.col("cx")) <= F.col("sx") / 2 + margin) & (F.abs(F.col("_ay") - F.col("cy")) <= F.col("sy") / 2 + margin)
    met = boxes.join(a, keys).where(inside).groupBy(*keys, box).agg(F.array_sort(F.collect_set("kind")).alias("support"))
    return boxes.join(met, [*keys, box], "left")


def capture_pairs(values: DataFrame, capture: str, keys: list[str]) -> DataFrame:
    """Every two captures, the lesser first, on their common keys; columns of the second end in _b."""
    other = values.withColumnsRenamed({c: f"{c}_b" for c in values.columns if c not in keys})
    return values.join(other, keys).where(F.col(capture) < F.col(f"{capture}_b"))


def common_bins(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))
