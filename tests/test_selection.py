import numpy as np
from pyspark.sql import functions as F

from hearthwave.helpers import angles
from hearthwave.operators import clusters, selection


def test_refined_angles(spark):
    az, el = 21.5, -8.0
    x = angles.steering((az,), (el,))[0, 0]
    df = spark.createDataFrame([(1, 15.0, -15.0, [float(v) for v in x.real], [float(v) for v in x.imag])], "id long, az double, el double, re array<double>, im array<double>")
    r = selection.refined_angles(df, ["id"]).first()
    assert abs(r["az_fine"] - az) <= 0.5 and abs(r["el_fine"] - el) <= 0.5


def test_places_and_shapes(spark):
    df = spark.createDataFrame([("near lie", 0.9, 8, 0.3, 1.0), ("远处站", 0.1, 8, 1.7, 4.0), ("x", 0.9, 3, 0.3, 4.0)], "t string, ff double, n long, z90 double, wy double")
    got = df.select(selection.zone_of(F.col("t")).alias("z"), selection.posture_of(F.col("t")).alias("p"), selection.lies_by_shape(F.col("ff"), F.col("n"), F.col("z90"), F.col("wy")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("near", "lie", True), ("far", "stand", False), (None, None, False)]


def test_breathing_pattern(spark):
    df = spark.createDataFrame([(False, 0, 0, 0.1), (True, 1, 1, 0.1), (True, 0, 1, 0.1), (True, 0, 0, 0.9), (True, 0, 0, 0.1)], "present boolean, apneas int, absences int, cv double")
    assert [r["pattern"] for r in selection.breathing_pattern(df).collect()] == ["NO_BREATHING", "APNEA", "LEFT", "ERRATIC", "REGULAR"]


def test_hot_regions(spark):
    grid = np.zeros((6, 6))
    grid[0, 0:3] = 2
    grid[4, 4] = 3
    grid[1, 3] = 2  # touches only at a corner
    rows = [(1, i, j, float(grid[i, j])) for i in range(6) for j in range(6)]
    df = spark.createDataFrame(rows, "capture_id long, ix int, iy int, ratio double")
    got = sorted((r["n_cells"], r["peak"]) for r in clusters.hot_regions(df, ["capture_id"], F.col("ratio") >= 1, 1).collect())
    assert got == [(1, 2.0), (1, 3.0), (3, 2.0)]
    assert clusters.hot_regions(df, ["capture_id"], F.col("ratio") >= 1, 3).count() == 1
