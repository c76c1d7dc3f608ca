"""Choices among clusters, boxes, tracks and labels, and short looks back over frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..helpers import angles as a


def lies_by_shape(floor_frac: Column, n: Column, z90: Column, wy: Column, least_frac: float = 0.7, least_n: int = 6, top: float = 0.4, per_m: float = 0.12) -> Column:
    """Whether a cluster lies: low enough, points enough, and a top that may be higher the farther it is beyond 2 m."""
    return (floor_frac >= least_frac) & (n >= least_n) & (z90 < top + per_m * F.greatest(F.lit(0.0), wy - 2.0))


def is_person(n: Column, x0: Column, x1: Column, y1: Column) -> Column:
    """A box with points enough inside the room."""
    return (n >= 12) & (F.abs((x0 + x1) / 2) < 3.5) & (y1 < 6.5)


def zone_of(text: Column) -> Column:
    """near, mid or far as a label says it; the first that is found. English and Chinese words are fixed values."""
    t = F.lower(text)
    return F.when(t.contains("near") | t.contains("近"), "near").when(t.contains("mid") | t.contains("中"), "mid").when(t.contains("far") | t.contains("远"), "far")


def posture_of(text: Column) -> Column:
    """stand, sit or lie as a label says it."""
    t = F.lower(text)
    return F.when(t.contains("stand") | t.contains("站"), "stand").when(t.contains("sit") | t.contains("坐"), "sit").when(t.contains("lie") | t.contains("lay") | t.contains("躺"), "lie")


def track_place(wy: Column, wz: Column) -> dict[str, Column]:
    """Zone and posture of a track from its ground range and height."""
    return {"zone": F.when(wy < 1.8, "near").when(wy < 3.2, "mid").otherwise("far"), "posture": F.when(wz > 0.9, "stand").when(wz > 0.35, "sit").otherwise("lie")}


def with_poses(tracks: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """Tracks with their frame's pose and window legs; unknown (255) and not down where there is none."""
    legs = poses.select(*keys, "pose", "falling_prob", "down", "h_s_cm")
    return tracks.join(legs, keys, "left").withColumns({"pose": F.coalesce("pose", F.lit(255)), "falling_prob": F.coalesce("falling_prob", F.lit(0.0)), "down": F.coalesce("down", F.lit(False))})


def recent_points(points: DataFrame, frames: DataFrame, keys: list[str], frame: str, back: int = 4) -> DataFrame:
    """For each frame the points of its last ``back`` frames: ``frame`` is the one that looks, ``from_frame`` the point's own."""
    moved = points.withColumnRenamed(frame, "from_frame").withColumn(frame, F.explode(F.sequence(F.col("from_frame"), F.col("from_frame") + (back - 1))))
    return moved.join(frames.select(*keys, frame).distinct(), [*keys, frame], "left_semi")


def fall_cluster(clusters: DataFrame, keys: list[str], least_n: int = 8, least_frac: float = 0.8, below: float = 0.15) -> DataFrame:
    """Per frame the cluster that is most on the floor, then largest, among those that may be a fallen body."""
    able = clusters.where((F.col("n") >= least_n) & (F.col("floor_frac") >= least_frac) & (F.col("z_med") < below))
    return able.groupBy(*keys).agg(F.max_by("cluster_id", F.struct("floor_frac", "n", -F.col("cluster_id"))).alias("cluster_id"))


def floor_target(clusters: DataFrame, keys: list[str], least_n: int = 8, least_frac: float = 0.7) -> DataFrame:
    """Per frame the largest cluster that is mostly on the floor."""
    able = clusters.where((F.col("floor_frac") >= least_frac) & (F.col("n") >= least_n))
    return able.groupBy(*keys).agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("cluster_id"))


def primary_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Per frame the box of the first track (tid 0), else the one with most points."""
    order = F.struct((F.coalesce(F.col("tid"), F.lit(-1)) == 0).cast("int"), "n", -F.col("cluster_id"))
    return boxes.groupBy(*keys).agg(F.max_by("cluster_id", order).alias("cluster_id"))


def variance_trend(totals: DataFrame, keys: list[str], order: str, value: str, frames: int = 60) -> DataFrame:
    """Adds ``trend``: a frame's total over the mean of the last ``frames`` totals, its own included; 1 where that is 0."""
    mean = F.avg(value).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-(frames - 1), 0))
    return totals.withColumn("trend", F.when(mean > 0, F.col(value) / mean).otherwise(1.0))


def breathing_pattern(summary: DataFrame) -> DataFrame:
    """Adds ``pattern`` from present, apneas, absences and the breath intervals' variation (cv); the first rule that fits."""
    pattern = F.when(~F.col("present"), "NO_BREATHING").when(F.col("apneas") > 0, "APNEA").when(F.col("absences") > 0, "LEFT").when(F.col("cv") > 0.55, "ERRATIC").otherwise("REGULAR")
    return summary.withColumn("pattern", pattern)


def refined_angles(detections: DataFrame, keys: list[str], half: float = 15.0, step: float = 0.5) -> DataFrame:
    """The strongest direction near each detection's coarse one, from its own antenna vector: adds az_fine, el_fine.

    detections: keys, az, el (degrees), re, im (one vector each). A row's search is one small grid; rows come in batches.
    """
    offsets = np.arange(-half, half + step / 2, step)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                x = np.array(r.re, dtype=float) + 1j * np.array(r.im, dtype=float)
                az, el = np.radians(r.az + offsets)[:, None, None], np.radians(r.el + offsets)[None, :, None]
                grid = np.exp(1j * np.pi * (np.array(a.IDEAL_AZ) * np.sin(az) * np.cos(el) + np.array(a.IDEAL_EL) * np.sin(el)))
                i, j = np.unravel_index((np.abs(grid.conj() @ x) ** 2).argmax(), grid.shape[:2])
                out.append((float(r.az + offsets[i]), float(r.el + offsets[j])))
            yield pdf.assign(az_fine=[o[0] for o in out], el_fine=[o[1] for o in out])[[*keys, "az", "el", "az_fine", "el_fine"]]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.select(*keys).schema.fields)
    return detections.select(*keys, "az", "el", "re", "im").mapInPandas(work, f"{kinds}, az double, el double, az_fine double, el_fine double")
