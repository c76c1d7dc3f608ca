"""Projections between radar, room and voxel coordinates. All are column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metres per range bin, and the voxel grid: cell size and cells along x, y, z; x runs from -3 m.
RANGE_STEP = 0.0234375
CELL, GRID = 0.20, (20, 30, 15)


def to_room(df: DataFrame, tilt_deg: float = 35.0, height: float = 2.0) -> DataFrame:
    """Room coordinates for a tilt measured downward from the horizontal; rows that are not finite go."""
    t = math.radians(tilt_deg)
    y, z = F.col("y"), F.col("z")
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (F.col("x"), y, z)]
    return df.where(finite[0] & finite[1] & finite[2]).withColumns({"y": y * math.cos(t) + z * math.sin(t), "z": -y * math.sin(t) + z * math.cos(t) + height})


def to_room_from_vertical(df: DataFrame, tilt_deg: float = 35.0, height: float = 2.0) -> DataFrame:
    """Room coordinates for a tilt measured from the vertical."""
    t = math.radians(tilt_deg)
    y, z = F.col("y"), F.col("z")
    return df.withColumns({"y": y * math.sin(t) + z * math.cos(t), "z": height - y * math.cos(t) + z * math.sin(t)})


def to_room_by_sensor(df: DataFrame, mounts: DataFrame) -> DataFrame:
    """Like ``to_room``, with tilt_deg and height of each sensor from ``mounts`` (one row per sensor_id)."""
    joined = df.join(mounts.select("sensor_id", F.radians("tilt_deg").alias("_t"), F.col("height").alias("_h")), "sensor_id")
    y, z, t = F.col("y"), F.col("z"), F.col("_t")
    return joined.withColumns({"y": y * F.cos(t) + z * F.sin(t), "z": -y * F.sin(t) + z * F.cos(t) + F.col("_h")}).drop("_t", "_h")


def spherical(rng: Column, az: Column, el: Column) -> dict[str, Column]:
    """x, y, z of a range and two angles in radians: azimuth to the right, elevation upward."""
    return {"x": rng * F.cos(el) * F.sin(az), "y": rng * F.cos(el) * F.cos(az), "z": rng * F.sin(el)}


def bin_range(range_bin: Column, step: float = RANGE_STEP) -> Column:
    return range_bin * step


def ground_range(slant: Column, drop: float = 1.2) -> Column:
    """Range on the floor under a slant range to something ``drop`` metres below the sensor, 0.3 m at least."""
    return F.sqrt(F.greatest(slant * slant - drop * drop, F.lit(0.09)))


def to_floor(slant: Column, az_deg: Column, scale: float = 0.684, offset_deg: float = 9.21, drop: float = 1.2) -> dict[str, Column]:
    """x and y on the floor, after the azimuth's calibration."""
    g, a = ground_range(slant, drop), F.radians(az_deg * scale + offset_deg)
    return {"x": g * F.sin(a), "y": g * F.cos(a)}


def range_height(rng: Column, height: float = 2.0, tilt_deg: float = 35.0) -> Column:
    """Height at that slant range along the sensor's axis, the tilt being measured from the vertical."""
    return height - rng * math.cos(math.radians(tilt_deg))


def voxel_index(x: Column, y: Column, z: Column, cell: float = CELL, x0: float = -2.0) -> dict[str, Column]:
    """Cell numbers, cut toward zero, so that a point just outside the lower border is in cell 0."""
    return {"ix": ((x - x0) / cell).cast("int"), "iy": (y / cell).cast("int"), "iz": (z / cell).cast("int")}


def in_grid(grid: tuple[int, int, int] = GRID) -> Column:
    return F.col("ix").between(0, grid[0] - 1) & F.col("iy").between(0, grid[1] - 1) & F.col("iz").between(0, grid[2] - 1)


def voxel_centre(cell: float = CELL, x0: float = -2.0) -> dict[str, Column]:
    return {"x": (F.col("ix") + 0.5) * cell + x0, "y": (F.col("iy") + 0.5) * cell, "z": (F.col("iz") + 0.5) * cell}


def voxel_number(grid: tuple[int, int, int] = GRID) -> Column:
    """One number for a cell, x fastest; ``voxel_coordinates`` undoes it."""
    return F.col("ix") + grid[0] * (F.col("iy") + grid[1] * F.col("iz"))


def voxel_coordinates(number: Column, grid: tuple[int, int, int] = GRID) -> dict[str, Column]:
    return {"ix": number % grid[0], "iy": F.floor(number / grid[0]).cast("int") % grid[1], "iz": F.floor(number / (grid[0] * grid[1])).cast("int")}


def static_points(points: DataFrame, limit: float = 0.5) -> DataFrame:
    return points.where(F.abs("doppler") < limit)


def height_band(z: Column) -> Column:
    """floor, bed_low, table_chair, standing or wall_high."""
    return F.when(z < 0.4, "floor").when(z < 0.7, "bed_low").when(z < 1.1, "table_chair").when(z < 1.8, "standing").otherwise("wall_high")


def box_label(top: Column, foot: Column) -> Column:
    """What a box may be, from its upper edge and its larger side on the floor; the first rule that fits."""
    return (
        F.when(top < 0.35, "floor").when(top >= 1.5, "wall/person").when((foot >= 1.4) & (top < 0.7), "bed/sofa")
        .when(top.between(0.65, 1.15) & (foot >= 0.5), "table").when(top.between(0.4, 1.1) & (foot < 0.7), "chair").otherwise("object")
    )


def pose(length: Column, vertical: Column, energy_z: Column | None = None) -> Column:
    """LIE, SIT or STAND from a box's longer side and height; then the energy's height, except for LIE."""
    slim = vertical / F.greatest(length, F.lit(0.05))
    first = F.when((length >= 0.9) & (vertical < 0.6), "LIE").when(vertical >= 1.0, "STAND").when(slim > 1.5, "STAND").when(slim < 0.7, "LIE").otherwise("SIT")
    if energy_z is None:
        return first
    return F.when(first == "LIE", "LIE").when(energy_z >= 0.85, "STAND").when(energy_z <= 0.55, "SIT").otherwise(first)


def side(deg: Column, limit: float = 6.0) -> Column:
    return F.when(deg < -limit, "LEFT").when(deg > limit, "RIGHT").otherwise("CENTER")


def coverage(spans: DataFrame, keys: list[str], step: float = RANGE_STEP, az_deg: float = 60.0, el_deg: float = 30.0, tilt_deg: float = 35.0, height: float = 2.0) -> DataFrame:
    """The box around what a sensor sees: its corners (first and last bin, both scan limits) in the room.

    spans: keys, bin_min, bin_max.
    """
    signs = F.array(F.lit(-1.0), F.lit(1.0))
    corners = spans.withColumn("_r", F.explode(F.array("bin_min", "bin_max"))).withColumn("_a", F.explode(signs)).withColumn("_e", F.explode(signs))
    xyz = corners.withColumns(spherical(bin_range(F.col("_r"), step), F.col("_a") * math.radians(az_deg), F.col("_e") * math.radians(el_deg)))
    room = to_room(xyz, tilt_deg, height)
    return room.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))))
