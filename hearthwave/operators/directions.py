"""Directions of arrival and beam energy from covariances, a batch of covariances at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..helpers import angles as a
from . import geometry as g


def matrices(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Long covariance rows (keys, i, j, re, im) as one row per key with row-major arrays re and im."""
    packed = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "re", "im"))).alias("_c"))
    return packed.select(*keys, F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))


def _stack(pdf: pd.DataFrame) -> np.ndarray:
    flat = np.stack(pdf["re"].to_numpy()) + 1j * np.stack(pdf["im"].to_numpy())
    n = round(flat.shape[1] ** 0.5)
    return flat.reshape(-1, n, n)


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)


def doa_points(
    packed: DataFrame, keys: list[str], method: str = "music", signals: int | None = None, snapshots: int = 50, az: tuple[float, float] = (-45.0, 45.0), el: tuple[float, float] = (-45.0, 20.0), most: int = 3, within_db: float = -6.0
) -> DataFrame:
    """Per covariance (keys with range_bin): up to ``most`` directions within ``within_db`` of the strongest, as points."""
    azs, els = a.scan(*az), a.scan(*el)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = a.steering(azs, els)
        for pdf in it:
            out = []
            for (_, row), r in zip(pdf.iterrows(), _stack(pdf) if len(pdf) else [], strict=True):
                power = a.beam(r[None], grid)[0] if method == "beam" else a.subspace(r, grid, signals, snapshots)
                found = a.peaks(power, azs, els)
                for az_deg, el_deg, p in found[:most]:
                    if 10 * np.log10(p / found[0][2]) >= within_db:
                        out.append([*(row[k] for k in keys), az_deg, el_deg, p])
            yield pd.DataFrame(out, columns=[*keys, "az", "el", "power"])

    found = packed.select(*keys, "re", "im").mapInPandas(work, f"{_kinds(packed, keys)}, az double, el double, power double")
    xyz = g.spherical(g.bin_range(F.col("range_bin")), F.radians("az"), F.radians("el"))
    return found.withColumns(xyz | {"range_m": g.bin_range(F.col("range_bin"))})


def beam_cells(packed: DataFrame, keys: list[str], az: tuple[float, ...], el: tuple[float, ...] = (0.0,), board: bool = True) -> DataFrame:
    """Beam power of each covariance in each direction, as rows: keys, az, el, power."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grid = a.steering(az, el, *((a.BOARD_AZ, a.BOARD_EL) if board else ()))
        at = np.array([(x, y) for x in az for y in el])
        for pdf in it:
            if not len(pdf):
                continue
            power = a.beam(_stack(pdf), grid).reshape(len(pdf), -1)
            n = len(at)
            out = pdf[keys].loc[pdf.index.repeat(n)].reset_index(drop=True)
            yield out.assign(az=np.tile(at[:, 0], len(pdf)), el=np.tile(at[:, 1], len(pdf)), power=power.ravel())

    return packed.select(*keys, "re", "im").mapInPandas(work, f"{_kinds(packed, keys)}, az double, el double, power double")


def floor_energy(cells: DataFrame, keys: list[str], top: float = 0.40, tilt_deg: float = 25.0, height: float = 2.0) -> DataFrame:
    """Per key: beam power in directions that end below ``top``, its share of all power, and the strongest bin there."""
    rng = g.bin_range(F.col("range_bin"))
    room = g.to_room(cells.withColumns(g.spherical(rng, F.radians("az"), F.radians("el"))), tilt_deg, height)
    low = F.when(F.col("z") <= top, F.greatest("power", F.lit(0.0))).otherwise(0.0)
    per_bin = room.groupBy(*keys, "range_bin").agg(F.sum(low).alias("floor"), F.sum(F.greatest("power", F.lit(0.0))).alias("total"))
    peak = F.max_by("range_bin", F.struct("floor", -F.col("range_bin")))
    return per_bin.groupBy(*keys).agg(F.sum("floor").alias("floor"), (F.sum("floor") / F.greatest(F.sum("total"), F.lit(1e-12))).alias("floor_frac"), peak.alias("peak_bin"))


def energy_volume(cells: DataFrame, keys: list[str], cell: float = 0.3, tilt_deg: float = 25.0, height: float = 2.0) -> DataFrame:
    """Unit-sum energy grid from beam cells: every (bin, azimuth, elevation) adds its power to the voxel it ends in."""
    from .voxels import energy_density

    rng = g.bin_range(F.col("range_bin"))
    room = g.to_room(cells.withColumns(g.spherical(rng, F.radians("az"), F.radians("el"))), tilt_deg, height)
    return energy_density(room, keys, cell)


def floor_grid(cells: DataFrame, keys: list[str], cell: float = 0.1, near: float = 0.9) -> DataFrame:
    """Beam power summed in floor cells (ix, iy), from ``near`` metres on."""
    rng = g.bin_range(F.col("range_bin"))
    xy = g.to_floor(rng, F.col("az"))
    placed = cells.where(rng >= near).withColumns({"ix": F.rint(xy["x"] / cell).cast("int"), "iy": F.rint(xy["y"] / cell).cast("int")})
    return placed.groupBy(*keys, "ix", "iy").agg(F.sum("power").alias("power"))


def symmetry_levels(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per bin: the part of the beam power that is the same on both sides (floor) and the part that is not (objects)."""
    other = cells.select(*keys, (-F.col("az")).alias("az"), "el", F.col("power").alias("_p"))
    both = cells.join(other, [*keys, "az", "el"])
    return both.groupBy(*keys).agg(F.avg(F.least("power", "_p")).alias("floor_level"), F.avg(F.abs(F.col("power") - F.col("_p")) / 2).alias("object_level"))


def edges(cells: DataFrame, keys: list[str], least: float = 0.2) -> DataFrame:
    """Bins whose spectrum turns away from the bin's before: 1 - cosine of the two above ``least``."""
    from pyspark.sql import Window as W

    packed = cells.groupBy(*keys, "range_bin").agg(F.transform(F.sort_array(F.collect_list(F.struct("az", "el", "power"))), lambda x: x["power"]).alias("v"))
    before = packed.withColumn("_b", F.lag("v").over(W.partitionBy(*keys).orderBy("range_bin")))

    return before.where("_b IS NOT NULL").select(*keys, "range_bin", (1 - cosine("v", "_b")).alias("turn")).withColumn("edge", F.col("turn") >= least)
