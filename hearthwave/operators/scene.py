"""Static scenes: accumulated captures, motion sources, changed covariances, boxes, and the scene model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import directions as dr
from . import geometry as g
from .moments import relative_change


def accumulated(cells: DataFrame, persons: DataFrame, keys: list[str], capture: str = "capture_id", guard: int = 3) -> DataFrame:
    """Element-wise mean of covariances over captures, without the bins near each capture's person.

    cells: keys, capture, range_bin, i, j, re, im. persons: keys, capture, person_bin (captures without one may be absent).
    """
    joined = cells.join(persons, [*keys, capture], "left")
    clean = joined.where(F.col("person_bin").isNull() | (F.abs(F.col("range_bin") - F.col("person_bin")) > guard))
    return clean.groupBy(*keys, "range_bin", "i", "j").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.countDistinct(capture).alias("captures"))


def motion_source(fluctuation: DataFrame, base: DataFrame | None, keys: list[str], gate: float = 0.15, captures: list[str] | None = None) -> DataFrame:
    """Fluctuation covariances less the empty room's, of bins whose own variance is ``gate`` of the largest or more.

    Both: keys, range_bin, i, j, re, im; the first may have ``captures`` besides, each of which counts for itself.
    """
    def variance(cells: DataFrame, by: list[str]) -> DataFrame:
        return cells.where("i = j").groupBy(*by, "range_bin").agg(F.sum("re").alias("v"))

    base_keys, keys = keys, [*(captures or []), *keys]
    own = variance(fluctuation, keys)
    cells = fluctuation.select(*keys, "range_bin", "i", "j", "re", "im")
    if base is not None:
        own = own.join(variance(base, base_keys).withColumnRenamed("v", "_b"), [*base_keys, "range_bin"], "left").withColumn("v", F.greatest(F.lit(0.0), F.col("v") - F.coalesce("_b", F.lit(0.0)))).drop("_b")
        b = base.select(*base_keys, "range_bin", "i", "j", F.col("re").alias("_re"), F.col("im").alias("_im"))
        zero = F.lit(0.0)
        cells = cells.join(b, [*base_keys, "range_bin", "i", "j"], "left").select(*keys, "range_bin", "i", "j", (F.col("re") - F.coalesce("_re", zero)).alias("re"), (F.col("im") - F.coalesce("_im", zero)).alias("im"))
    top = own.groupBy(*keys).agg(F.max("v").alias("_top"))
    kept = own.join(top, keys).where(F.col("v") >= gate * F.col("_top")).select(*keys, "range_bin")
    return cells.join(kept, [*keys, "range_bin"], "left_semi")


def changed_points(base: DataFrame, event: DataFrame, keys: list[str], gate: float = 0.3, az: tuple[float, float] = (-45.0, 45.0), el: tuple[float, float] = (-45.0, 20.0), step: int = 3, captures: list[str] | None = None) -> DataFrame:
    """Points where energy appeared: the difference of the covariances, of bins that changed enough, in its best direction.

    Both: keys, range_bin, i, j, re, im; events may have ``captures`` besides, each of which counts for itself.
    """
    at, on = [*keys, "range_bin"], [*(captures or []), *keys, "range_bin"]
    rel = relative_change(base, event, at, captures).where(F.col("rel") >= gate)
    b = base.select(*at, "i", "j", F.col("re").alias("_re"), F.col("im").alias("_im"))
    diff = event.join(b, [*at, "i", "j"]).select(*on, "i", "j", (F.col("re") - F.col("_re")).alias("re"), (F.col("im") - F.col("_im")).alias("im")).join(rel, on, "left_semi")
    azs, els = tuple(range(int(az[0]), int(az[1]) + 1, step)), tuple(range(int(el[0]), int(el[1]) + 1, step))
    beams = dr.beam_cells(dr.matrices(diff, on), on, tuple(map(float, azs)), tuple(map(float, els)), board=False)
    best = beams.groupBy(*on).agg(F.max_by(F.struct("az", "el", "power"), F.struct("power", -F.col("az"), -F.col("el"))).alias("b"))
    top = best.select(*on, "b.az", "b.el", "b.power").where("power > 0").join(rel, on)
    return top.withColumns(g.spherical(g.bin_range(F.col("range_bin")), F.radians("az"), F.radians("el")))


def over_floor(beams: DataFrame, floor: DataFrame, keys: list[str], above_db: float = 3.0) -> DataFrame:
    """Bins and directions stronger than the floor's line (slope, intercept over log10 of range), as floor positions.

    beams: keys, range_bin, az, power. One row per contiguous run of directions of a bin, at its strongest.
    """
    from .islands import runs

    rng = g.bin_range(F.col("range_bin"))
    level = 10 * F.log10(F.greatest("power", F.lit(1e-12)))
    rows = beams.join(floor, keys).withColumn("excess", level - F.col("slope") * F.log10(F.greatest(rng, F.lit(1e-6))) - F.col("intercept"))
    hot = runs(rows, [*keys, "range_bin"], ["az"], F.col("excess") >= above_db).where("run_flag")
    best = hot.groupBy(*keys, "range_bin", "run").agg(F.max_by("az", F.struct("excess", -F.col("az"))).alias("az"), F.max("excess").alias("excess"), F.sum("power").alias("energy"))
    return best.drop("run").withColumns(g.to_floor(rng, F.col("az")))


def merged(boxes: DataFrame, keys: list[str], gap: float = 0.4) -> DataFrame:
    """Boxes (x0, y0, sx, sy, energy) of a capture, tens of them, joined while two are within ``gap``; centres by energy.

    The order counts: the first pair that touches is joined first, and the search begins again.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.select(*keys).schema.fields)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x0", "y0", "sx", "sy", "energy"])
        left = [(r.x0, r.y0, r.x0 + r.sx, r.y0 + r.sy, r.x0 + r.sx / 2, r.y0 + r.sy / 2, r.energy) for r in pdf.itertuples()]
        again = True
        while again:
            again = False
            for i, a in enumerate(left):
                near = next((k for k in range(i + 1, len(left)) if all(a[d] - gap <= left[k][d + 2] and left[k][d] - gap <= a[d + 2] for d in (0, 1))), None)
                if near is not None:
                    b = left.pop(near)
                    e = a[6] + b[6]
                    left[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), (a[4] * a[6] + b[4] * b[6]) / e, (a[5] * a[6] + b[5] * b[6]) / e, e)
                    again = True
                    break
        return pd.DataFrame([(*key, *v) for v in left], columns=[*keys, "x0", "y0", "x1", "y1", "cx", "cy", "energy"])

    return boxes.groupBy(*keys).applyInPandas(work, f"{kinds}, x0 double, y0 double, x1 double, y1 double, cx double, cy double, energy double")


def energy_boxes(grid: DataFrame, keys: list[str], coarse: int = 5, share: float = 0.7, cell: float = 0.1) -> DataFrame:
    """Boxes around most of the energy: coarse blocks of cells first, then the cells inside each block that is kept.

    grid: keys, ix, iy, power. Blocks are taken from the strongest until ``share`` of the energy is covered; in a block
    the same is done with its cells, and the box is what those span.
    """
    from pyspark.sql import Window as W

    def covering(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
        before = F.coalesce(F.sum(value).over(W.partitionBy(*by).orderBy(F.desc(value), *order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        return df.withColumns({"_before": before, "_all": F.sum(value).over(W.partitionBy(*by))}).where(F.col("_before") < share * F.col("_all")).drop("_before", "_all")

    placed = grid.where("power > 0").withColumns({"bx": F.floor(F.col("ix") / coarse), "by": F.floor(F.col("iy") / coarse)})
    blocks = covering(placed.groupBy(*keys, "bx", "by").agg(F.sum("power").alias("block")), keys, "block", ["bx", "by"])
    inside = covering(placed.join(blocks, [*keys, "bx", "by"]), [*keys, "bx", "by"], "power", ["ix", "iy"])
    return inside.groupBy(*keys, "bx", "by").agg(
        (F.min("ix") * cell).alias("x0"), (F.min("iy") * cell).alias("y0"), ((F.max("ix") - F.min("ix") + 1) * cell).alias("sx"), ((F.max("iy") - F.min("iy") + 1) * cell).alias("sy"), F.sum("power").alias("energy")
    ).drop("bx", "by")


def scene_model(walls: DataFrame, objects: DataFrame, corners: DataFrame, keys: list[str]) -> DataFrame:
    """One nested row per sensor: its wall range, its objects and its corners in a fixed order; ready for JSON."""
    def listed(df: DataFrame, name: str) -> DataFrame:
        columns = [c for c in df.columns if c not in keys]
        return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    return walls.join(listed(objects, "objects"), keys, "left").join(listed(corners, "corners"), keys, "left")


def baseline_tables(cells: DataFrame, beams: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two tables of an occlusion baseline: power per bin, and beam energy per floor cell."""
    power = cells.where("i = j").groupBy(*keys, "range_bin").agg(F.sum("re").alias("power"))
    return power, dr.floor_grid(beams, keys)
