"""Room geometry, occupancy and energy over voxels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clusters as c
from ..operators import geometry as g
from ..operators import voxels as v
from ..streaming import jobs, steps
from .registry import query
from .standins import POINTS, points

COS, SIN = repr(math.cos(math.radians(35.0))), repr(math.sin(math.radians(35.0)))
KEY = ["capture_id"]


@query(f"{POINTS} SELECT capture_id, frame, k, R(x) AS x, R(y * {COS}::DOUBLE + z * {SIN}::DOUBLE) AS y, R(-y * {SIN}::DOUBLE + z * {COS}::DOUBLE + 2.0) AS z FROM points")
def room_points(spark: SparkSession, d: str) -> DataFrame:
    return g.to_room(points(spark, d)).select("capture_id", "frame", "k", "x", "y", "z")


@query(f"{POINTS} SELECT capture_id, frame, k, R(y * {SIN}::DOUBLE + z * {COS}::DOUBLE) AS y, R(2.0 - y * {COS}::DOUBLE + z * {SIN}::DOUBLE) AS z FROM points")
def room_points_from_vertical(spark: SparkSession, d: str) -> DataFrame:
    return g.to_room_from_vertical(points(spark, d)).select("capture_id", "frame", "k", "y", "z")


@query(f"{POINTS} SELECT capture_id, frame, k, R(y * cos(z) * sin(x)) AS x, R(y * cos(z) * cos(x)) AS y, R(y * sin(z)) AS z FROM points")
def spherical_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return p.select("capture_id", "frame", "k", *(e.alias(n) for n, e in g.spherical(F.col("y"), F.col("x"), F.col("z")).items()))


@query(f"{POINTS} SELECT capture_id, frame, k, R(sqrt(greatest(y * y - 1.44, 0.09)) * sin(radians(x * 20 * 0.684 + 9.21))) AS x, R(sqrt(greatest(y * y - 1.44, 0.09)) * cos(radians(x * 20 * 0.684 + 9.21))) AS y, CASE WHEN x * 20 < -6 THEN 'LEFT' WHEN x * 20 > 6 THEN 'RIGHT' ELSE 'CENTER' END AS side FROM points")
def floor_positions(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return p.select("capture_id", "frame", "k", *(e.alias(n) for n, e in g.to_floor(F.col("y"), F.col("x") * 20).items()), g.side(F.col("x") * 20).alias("side"))


CELLS = "trunc((x + 2.0) / 0.2)::INT AS ix, trunc(y / 0.2)::INT AS iy, trunc(z / 0.2)::INT AS iz"


@query(
    f"{POINTS}, cells AS (SELECT *, {CELLS} FROM points) SELECT capture_id, ix, iy, iz, least(20 * count(*), 2000)::INT AS log_odds, least(count(*), 65535)::INT AS hit_count, "
    "least(sum(100), 65535)::INT AS intensity, min(iz) AS z_min, max(iz) AS z_max FROM cells WHERE ix BETWEEN 0 AND 19 AND iy BETWEEN 0 AND 29 AND iz BETWEEN 0 AND 14 GROUP BY capture_id, ix, iy, iz"
)
def voxel_map(spark: SparkSession, d: str) -> DataFrame:
    return v.voxel_map(points(spark, d), KEY)


@query(f"{POINTS} SELECT capture_id, ix + 20 * (iy + 30 * iz) AS number, (ix + 0.5) * 0.2 - 2.0 AS x, count(*) AS n FROM (SELECT *, {CELLS} FROM points) WHERE ix BETWEEN 0 AND 19 AND iy BETWEEN 0 AND 29 AND iz BETWEEN 0 AND 14 GROUP BY ALL".replace("(ix + 0.5) * 0.2 - 2.0", "R((ix + 0.5) * 0.2 - 2.0)"))
def voxel_numbers(spark: SparkSession, d: str) -> DataFrame:
    cells = v.voxel_map(points(spark, d), KEY)
    return cells.select("capture_id", g.voxel_number().alias("number"), g.voxel_centre()["x"].alias("x"), F.col("hit_count").cast("long").alias("n"))


def _grid(cell: str, low: tuple, n: tuple, high: tuple, where: str = "") -> str:
    parts = ", ".join(f"least(trunc(({a} - ({lo})) / {cell})::INT, {m - 1}) AS i{a}" for a, lo, m in zip("xyz", low, n, strict=True))
    inside = " AND ".join(f"{a} >= {lo} AND {a} < {hi}" for a, lo, hi in zip("xyz", low, high, strict=True))
    return f"cells AS (SELECT *, {parts} FROM points WHERE {inside} {where})"


COUNTS = _grid("0.2", (-3.0, 0.0, 0.0), (30, 35, 12), (3.0, 7.0, 2.5))
ENERGY = _grid("0.3", (-3.0, 0.0, -0.1), (20, 23, 9), (3.0, 7.0, 2.5))


@query(f"{POINTS}, {COUNTS} SELECT capture_id, ix, iy, iz, count(*) AS n FROM cells GROUP BY ALL")
def voxel_counts(spark: SparkSession, d: str) -> DataFrame:
    return v.point_counts(points(spark, d), KEY)


@query(f"{POINTS}, {ENERGY}, s AS (SELECT capture_id, ix, iy, iz, sum(power) AS e FROM cells GROUP BY ALL) SELECT capture_id, ix, iy, iz, R(e / sum(e) OVER (PARTITION BY capture_id)) AS e FROM s", 9)
def energy_density(spark: SparkSession, d: str) -> DataFrame:
    return v.energy_density(points(spark, d), KEY)


CHANGE = f"""{POINTS}, {ENERGY}, s AS (SELECT capture_id % 5 AS capture_id, scan, ix, iy, iz, sum(power) AS e FROM cells WHERE scan IN ('R', 'N') GROUP BY ALL),
n AS (SELECT *, e / sum(e) OVER (PARTITION BY capture_id, scan) AS q FROM s),
change AS (SELECT capture_id, ix, iy, iz, coalesce(sum(q) FILTER (scan = 'R'), 0) - coalesce(sum(q) FILTER (scan = 'N'), 0) AS d FROM n GROUP BY ALL)"""


def _change(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("capture_id", F.col("capture_id") % 5)
    event, base = (v.energy_density(p.where(F.col("scan") == s), KEY) for s in ("R", "N"))
    return v.energy_change(base, event, KEY)


@query(f"{CHANGE} SELECT capture_id, ix, iy, iz, R(d) AS d FROM change", 9)
def energy_change(spark: SparkSession, d: str) -> DataFrame:
    return _change(spark, d)


@query(f"{CHANGE}, p AS (SELECT *, max(greatest(d, 0)) OVER (PARTITION BY capture_id) AS peak FROM change) SELECT capture_id, ix, iy, iz, R(d) AS d, R((ix + 0.5) * 0.3 - 3.0) AS x, R((iy + 0.5) * 0.3) AS y, R((iz + 0.5) * 0.3) AS z FROM p WHERE greatest(d, 0) > 0.3 * peak AND peak > 0", 9)
def appeared_cells(spark: SparkSession, d: str) -> DataFrame:
    return v.appeared(_change(spark, d), KEY)


@query(f"{CHANGE}, low AS (SELECT capture_id, ix, iy, sum(d) AS s FROM change WHERE iz < 2 AND d > 0 GROUP BY ALL) SELECT capture_id, R(sum(s)) AS total, arg_max(ix, (s, -ix, -iy)) AS ix, arg_max(iy, (s, -ix, -iy)) AS iy, R(max(s)) AS peak FROM low GROUP BY capture_id")
def floor_anomaly(spark: SparkSession, d: str) -> DataFrame:
    return v.floor_anomaly(_change(spark, d), KEY)


@query(f"""WITH RECURSIVE {CHANGE}, p AS (SELECT *, max(abs(d)) OVER (PARTITION BY capture_id) AS peak FROM change), strong AS (SELECT *, CASE WHEN d > 0 THEN 'appeared' ELSE 'gone' END AS kind, row_number() OVER () AS id FROM p WHERE abs(d) > 0.2 * peak AND peak > 0),
e AS (SELECT p.id AS a, q.id AS b FROM strong p JOIN strong q ON p.capture_id = q.capture_id AND p.kind = q.kind AND abs(p.ix - q.ix) + abs(p.iy - q.iy) + abs(p.iz - q.iz) = 1), reach AS (SELECT id, id AS root FROM strong UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id), lab AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
found AS (SELECT capture_id, kind, sum(abs(d) * ((ix + 0.5) * 0.3 - 3.0)) / sum(abs(d)) AS cx, sum(abs(d) * ((iy + 0.5) * 0.3)) / sum(abs(d)) AS cy, sum(abs(d) * ((iz + 0.5) * 0.3 - 0.1)) / sum(abs(d)) AS cz, sum(abs(d)) AS magnitude, count(*) AS n_voxels FROM strong JOIN lab USING (id) GROUP BY capture_id, kind, root)
SELECT capture_id, kind, R(cx) AS cx, R(cy) AS cy, R(cz) AS cz, R(magnitude) AS magnitude, n_voxels, kind = 'appeared' AND cz < 0.4 AS fall_zone FROM found""", 7)
def change_events(spark: SparkSession, d: str) -> DataFrame:
    """Regions of changed energy that touch by a face."""
    return c.change_events(_change(spark, d), KEY, rel=0.2, least=1)


@query(f"{POINTS} SELECT capture_id, floor(x / 0.5)::INT AS ix, floor(y / 0.5)::INT AS iy, floor(z / 0.5)::INT AS iz, count(*) AS n, R((floor(x / 0.5) + 0.5) * 0.5) AS x, R((floor(y / 0.5) + 0.5) * 0.5) AS y, R((floor(z / 0.5) + 0.5) * 0.5) AS z FROM points WHERE z >= 0 GROUP BY capture_id, floor(x / 0.5), floor(y / 0.5), floor(z / 0.5) HAVING count(*) >= 2")
def stable_voxels(spark: SparkSession, d: str) -> DataFrame:
    return v.stable_voxels(points(spark, d), KEY, 0.5, 2)


@query(f"{POINTS}, {COUNTS}, n AS (SELECT capture_id % 5 AS capture_id, scan, ix, iy, iz, count(*) AS n FROM cells GROUP BY ALL) SELECT capture_id, ix, iy, iz, count(DISTINCT scan) AS scans FROM n WHERE n >= 1 GROUP BY ALL HAVING count(DISTINCT scan) >= 2")
def voxel_votes(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("capture_id", F.col("capture_id") % 5)
    return v.votes(v.point_counts(p, [*KEY, "scan"]), KEY, "scan", 1, 2)


BAND = "CASE WHEN z < 0.4 THEN 'floor' WHEN z < 0.7 THEN 'bed_low' WHEN z < 1.1 THEN 'table_chair' WHEN z < 1.8 THEN 'standing' ELSE 'wall_high' END"


@query(f"{POINTS} SELECT capture_id, {BAND} AS band, count(*) AS n, R(avg(power)) AS power FROM points GROUP BY ALL", 4)
def height_bands(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("capture_id", g.height_band(F.col("z")).alias("band")).agg(F.count("*").alias("n"), F.avg("power").alias("power"))


@query(f"{POINTS}, {COUNTS}, n AS (SELECT capture_id, ix, iy, iz, count(*) AS n FROM cells GROUP BY ALL) SELECT capture_id, ix, iy, count(*) FILTER (iz < 2) AS floor_layers, count(*) FILTER (iz >= 2) AS upper_layers FROM n GROUP BY ALL")
def floor_plan(spark: SparkSession, d: str) -> DataFrame:
    return v.floor_plan(v.point_counts(points(spark, d), KEY), KEY)


BOX = """b AS (SELECT capture_id, k AS cluster_id, count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz,
  greatest(max(x) - min(x), 0.05) AS sx, greatest(max(y) - min(y), 0.05) AS sy, greatest(max(z) - min(z), 0.05) AS sz FROM points GROUP BY ALL HAVING count(*) >= 4)"""
LABEL = """CASE WHEN top < 0.35 THEN 'floor' WHEN top >= 1.5 THEN 'wall/person' WHEN foot >= 1.4 AND top < 0.7 THEN 'bed/sofa' WHEN top BETWEEN 0.65 AND 1.15 AND foot >= 0.5 THEN 'table' WHEN top BETWEEN 0.4 AND 1.1 AND foot < 0.7 THEN 'chair' ELSE 'object' END"""


@query(f"{POINTS}, {BOX} SELECT capture_id, cluster_id, n, R(cx) AS cx, R(cy) AS cy, R(cz) AS cz, R(sx) AS sx, R(sy) AS sy, R(sz) AS sz, {LABEL} AS label FROM (SELECT *, cz + sz / 2 AS top, greatest(sx, sy) AS foot FROM b)")
def boxes(spark: SparkSession, d: str) -> DataFrame:
    return v.boxes(points(spark, d).withColumn("cluster_id", F.col("k")), KEY)


@query(f"""{POINTS}, {BOX}, p AS (SELECT *, CASE WHEN greatest(sx, sy) >= 0.9 AND sz < 0.6 THEN 'LIE' WHEN sz >= 1.0 THEN 'STAND' WHEN sz / greatest(greatest(sx, sy), 0.05) > 1.5 THEN 'STAND' WHEN sz / greatest(greatest(sx, sy), 0.05) < 0.7 THEN 'LIE' ELSE 'SIT' END AS p FROM b)
SELECT capture_id, cluster_id, CASE WHEN p = 'LIE' THEN 'LIE' WHEN cz >= 0.85 THEN 'STAND' WHEN cz <= 0.55 THEN 'SIT' ELSE p END AS pose, R(greatest(0.0, least(1.0, (1.3 - sz / greatest(sx, sy, 0.05)) / 1.3))) AS flatness FROM p""")
def poses(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.falls import flatness

    b = v.boxes(points(spark, d).withColumn("cluster_id", F.col("k")), KEY)
    return b.select("capture_id", "cluster_id", g.pose(F.greatest("sx", "sy"), F.col("sz"), F.col("cz")).alias("pose"), flatness(F.col("sx"), F.col("sy"), F.col("sz")).alias("flatness"))


@query(f"{POINTS} SELECT capture_id, k AS cluster_id, count(*) AS n, " + ", ".join(f"R(quantile_cont({a}, {q})) AS {a}{i}" for a in "xyz" for i, q in ((0, 0.05), (1, 0.95))) + " FROM points GROUP BY ALL")
def percentile_boxes(spark: SparkSession, d: str) -> DataFrame:
    return v.percentile_boxes(points(spark, d).withColumn("cluster_id", F.col("k")), KEY)


@query(f"{POINTS}, b AS (SELECT capture_id, k, k % 3 AS tid, count(*) AS n, " + ", ".join(f"quantile_cont({a}, {q}) AS {a}{i}" for a in "xyz" for i, q in ((0, 0.05), (1, 0.95))) + " FROM points GROUP BY ALL) SELECT capture_id, tid, sum(n)::BIGINT AS n, " + ", ".join(f"R({f}({a}{i})) AS {a}{i}" for a in "xyz" for i, f in ((0, "min"), (1, "max"))) + " FROM b GROUP BY ALL")
def merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    parts = v.percentile_boxes(points(spark, d).withColumn("cluster_id", F.col("k")), KEY)
    return v.merged_boxes(parts.withColumn("tid", F.col("cluster_id") % 3), KEY)


@query(f"{POINTS} SELECT capture_id, k, count(*) AS n, R(avg(x)) AS cx, R(avg(y)) AS cy, R(avg(z)) AS cz, R(avg((z < 0.4)::INT)) AS floor_frac, R(quantile_cont(z, 0.9)) AS z90, R(quantile_cont(z, 0.5)) AS z_med, R(max(y) - min(y)) AS y_span FROM points GROUP BY ALL")
def cluster_features(spark: SparkSession, d: str) -> DataFrame:
    return v.cluster_features(points(spark, d), ["capture_id", "k"])


@query(f"""{POINTS}, w AS (SELECT *, sum(power) OVER (PARTITION BY capture_id ORDER BY z, power ROWS UNBOUNDED PRECEDING) AS up, sum(power) OVER (PARTITION BY capture_id) AS total FROM points WHERE power > 0)
SELECT capture_id, R(min(z) FILTER (up >= 0.9 * total)) AS z_q, R(sum(CASE WHEN z < 0.4 THEN power ELSE 0 END) / sum(power)) AS floor_frac, R(sum(z * power) / sum(power)) AS z_mean FROM w GROUP BY capture_id""")
def weighted_z90(spark: SparkSession, d: str) -> DataFrame:
    return v.weighted_height(points(spark, d), KEY, "z", "power")


N_CELLS = 20 * 23 * 9


@query(f"""{POINTS}, {ENERGY}, s AS (SELECT capture_id, ix, iy, iz, sum(power) AS e FROM cells GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY e, ix, iy, iz) + {N_CELLS} - count(*) OVER (PARTITION BY capture_id) AS i FROM s WHERE e > 0)
SELECT capture_id, count(*) AS occupied, R(sum(e)) AS total, R(2 * sum(i * e) / ({N_CELLS} * sum(e)) - ({N_CELLS} + 1) / {N_CELLS}::DOUBLE) AS gini, R(sum(e) / count(*)) AS density FROM r GROUP BY capture_id""", 3)
def clarity(spark: SparkSession, d: str) -> DataFrame:
    return v.clarity(v.energy_density(points(spark, d), KEY, normalize=False), KEY, N_CELLS)


@query(f"""{POINTS}, {ENERGY}, s AS (SELECT capture_id, ix, iy, iz, sum(power) AS e FROM cells GROUP BY ALL), q AS (SELECT capture_id, ix, iy, sum(e) AS s, sum(e * ((iz + 0.5) * 0.3)) AS m, sum(e * ((iz + 0.5) * 0.3) * ((iz + 0.5) * 0.3)) AS q FROM s GROUP BY ALL)
SELECT capture_id, R(avg(sqrt(greatest(q / s - (m / s) ** 2, 0.0)))) AS z_spread FROM q GROUP BY capture_id""", 4)
def column_spread(spark: SparkSession, d: str) -> DataFrame:
    return v.column_spread(v.energy_density(points(spark, d), KEY, normalize=False), KEY)


EMA = f"""{POINTS}, {ENERGY}, s AS (SELECT capture_id % 5 AS capture_id, frame % 40 + 1 AS f, ix, iy, iz, sum(power) AS e FROM cells GROUP BY ALL), l AS (SELECT *, max(f) OVER (PARTITION BY capture_id) AS last FROM s),
q AS (SELECT capture_id, ix, iy, iz, sum(0.1 * pow(0.9, last - f) * e) AS slow, sum(CASE WHEN f > last - 6 THEN e ELSE 0.0 END) / 6 AS now FROM l GROUP BY ALL) SELECT capture_id, ix, iy, iz, R(slow) AS slow, R(now) AS now, R(now - slow) AS d FROM q"""


@query(EMA, 3)
def ema_diff(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "f": F.col("frame") % 40 + 1})
    return v.ema_difference(v.energy_density(p, [*KEY, "f"], normalize=False), KEY, 0.1, "f", 6)


@query(EMA.rsplit(" SELECT ", 1)[0] + " SELECT capture_id, ix, iy, iz, R(slow) AS slow FROM q", 3)
def slow_map_by_day(spark: SparkSession, d: str) -> DataFrame:
    """The slow baseline from the maps of days of ten frames."""
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "day": F.floor((F.col("frame") % 40) / 10), "f": F.col("frame") % 10 + 1})
    cells = v.energy_density(p, [*KEY, "day", "f"], normalize=False)
    last = p.groupBy(*KEY).agg(F.max(F.col("day") * 10 + F.col("f")).alias("last"))
    counts = last.select(*KEY, F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - 1) / 10))).alias("day"), "last").select(*KEY, "day", F.least(F.lit(10), F.col("last") - F.col("day") * 10).alias("n"))
    return v.slow_map(v.day_maps(cells, counts, KEY, 0.1, "day", "f"), counts, KEY, 0.1, "day")


@query(EMA.rsplit(" SELECT ", 1)[0] + " SELECT capture_id, ix, iy, iz, R(now - slow) AS d FROM q", 3)
def map_steps(spark: SparkSession, d: str) -> DataFrame:
    """The monitor's step function, a frame's sparse cells at a time; what it tells at a capture's last frame."""
    p = points(spark, d).withColumns({"capture_id": F.col("capture_id") % 5, "f": F.col("frame") % 40 + 1})
    cells = v.energy_density(p, [*KEY, "f"], normalize=False)
    name = F.concat_ws(":", "ix", "iy", "iz")
    rows = cells.groupBy(*KEY, "f").agg(F.sort_array(F.collect_list(F.struct(name.alias("cell"), "e"))).alias("cells"))
    last = rows.groupBy(*KEY).agg(F.max("f").alias("last"))

    def step(state: dict, row: dict) -> list[dict]:
        diff = steps.map_step(state, {"cells": {c["cell"]: c["e"] for c in row["cells"]}}, 0.1, 6)["diff"]
        return [{"cell": k, "d": v} for k, v in diff.items()] if row["f"] == row["last"] else []

    told = jobs.in_batch(rows.join(last, KEY), KEY, ["f"], step, "capture_id long, f long, cell string, d double")
    at = F.split("cell", ":")
    return told.select(*KEY, *(at[i].cast("int").alias(n) for i, n in enumerate(("ix", "iy", "iz"))), "d")



@query(f"{POINTS} SELECT capture_id, count(*) AS n FROM points WHERE abs(doppler) < 0.3 GROUP BY ALL")
def static_points(spark: SparkSession, d: str) -> DataFrame:
    return g.static_points(points(spark, d), 0.3).groupBy("capture_id").agg(F.count("*").alias("n"))


@query(f"""{POINTS}, s AS (SELECT capture_id, min(k) * 20 AS a, max(k) * 40 AS b FROM points GROUP BY ALL), c AS (SELECT capture_id, r * 0.0234375 AS r, sa * radians(60.0) AS az, se * radians(30.0) AS el FROM (SELECT capture_id, unnest([a, b]) AS r FROM s), (SELECT unnest([-1.0, 1.0]) AS sa), (SELECT unnest([-1.0, 1.0]) AS se)),
p AS (SELECT capture_id, r * cos(el) * sin(az) AS x, r * cos(el) * cos(az) AS yy, r * sin(el) AS zz FROM c), q AS (SELECT capture_id, x, yy * {COS}::DOUBLE + zz * {SIN}::DOUBLE AS y, -yy * {SIN}::DOUBLE + zz * {COS}::DOUBLE + 2.0 AS z FROM p)
SELECT capture_id, R(min(x)) AS x_min, R(max(x)) AS x_max, R(min(y)) AS y_min, R(max(y)) AS y_max, R(min(z)) AS z_min, R(max(z)) AS z_max FROM q GROUP BY capture_id""")
def coverage_box(spark: SparkSession, d: str) -> DataFrame:
    spans = points(spark, d).groupBy("capture_id").agg((F.min("k") * 20).alias("bin_min"), (F.max("k") * 40).alias("bin_max"))
    return g.coverage(spans, KEY)


@query(f"""WITH RECURSIVE {POINTS}, c AS (SELECT capture_id % 5 AS capture_id, floor(x / 0.25)::INT AS ix, floor(y / 0.25)::INT AS iy, floor(z / 0.25)::INT AS iz FROM points WHERE z >= 0 GROUP BY ALL HAVING count(*) >= 2), p AS (SELECT capture_id, ((ix + 50000)::BIGINT * 100000 + iy + 50000) * 100000 + iz AS node, (ix + 0.5::DOUBLE) * 0.25::DOUBLE AS x, (iy + 0.5::DOUBLE) * 0.25::DOUBLE AS y, (iz + 0.5::DOUBLE) * 0.25::DOUBLE AS z, ix, iy, iz FROM c WHERE iz >= 1 OR (iz + 0.5) * 0.25 >= 0.15),
shift AS (SELECT a.s AS a, b.s AS b, c.s AS c FROM (SELECT unnest([-1, 0, 1]) AS s) a, (SELECT unnest([-1, 0, 1]) AS s) b, (SELECT unnest([-1, 0, 1]) AS s) c WHERE abs(a.s) + abs(b.s) + abs(c.s) <= 2),
d AS (SELECT p.capture_id, p.node AS a, o.node AS b FROM p CROSS JOIN shift s JOIN p o ON o.capture_id = p.capture_id AND o.ix = p.ix + s.a AND o.iy = p.iy + s.b AND o.iz = p.iz + s.c), core AS (SELECT capture_id, a AS node FROM d GROUP BY ALL HAVING count(*) >= 4),
e AS (SELECT d.capture_id, d.a, d.b FROM d JOIN core x ON x.capture_id = d.capture_id AND x.node = d.a JOIN core y ON y.capture_id = d.capture_id AND y.node = d.b),
reach(capture_id, node, root) USING KEY (capture_id, node) AS (SELECT capture_id, node, node FROM core UNION (SELECT e.capture_id, e.b, min(r.root) FROM reach r JOIN e ON e.capture_id = r.capture_id AND e.a = r.node JOIN recurring.reach o ON o.capture_id = e.capture_id AND o.node = e.b WHERE r.root < o.root GROUP BY ALL)),
lab AS (SELECT d.capture_id, d.a AS node, coalesce(any_value(own.root), min(r.root)) AS root FROM d JOIN reach r ON r.capture_id = d.capture_id AND r.node = d.b LEFT JOIN reach own ON own.capture_id = d.capture_id AND own.node = d.a GROUP BY d.capture_id, d.a), ids AS (SELECT capture_id, root, row_number() OVER (PARTITION BY capture_id ORDER BY root) - 1 AS cluster_id FROM (SELECT DISTINCT capture_id, root FROM lab)),
b AS (SELECT capture_id, cluster_id::INT AS cluster_id, count(*) AS n, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), 0.05) AS sx, greatest(max(y) - min(y), 0.05) AS sy, greatest(max(z) - min(z), 0.05) AS sz FROM lab JOIN p USING (capture_id, node) JOIN ids USING (capture_id, root) GROUP BY ALL HAVING count(*) >= 4)
SELECT capture_id, cluster_id, n, R(cx) AS cx, R(cy) AS cy, R(cz) AS cz, R(sx) AS sx, R(sy) AS sy, R(sz) AS sz, {LABEL} AS label FROM (SELECT *, cz + sz / 2 AS top, greatest(sx, sy) AS foot FROM b)""")
def room_objects(spark: SparkSession, d: str) -> DataFrame:
    """The furniture pass: cells, clusters, boxes and labels."""
    p = points(spark, d).withColumn("capture_id", F.col("capture_id") % 5)
    return c.detect_objects(p, KEY, cell=0.25, dense=2, eps=0.4, least=4)


@query(f"""WITH RECURSIVE {POINTS}, p AS (SELECT capture_id, frame % 2000 AS frame, x, y, z, row_number() OVER (PARTITION BY capture_id, frame % 2000 ORDER BY power, x, y, z) AS i FROM points), d AS (SELECT a.capture_id, a.frame, a.i, b.i AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.capture_id = b.capture_id AND a.frame = b.frame AND a.i <> b.i),
n AS (SELECT capture_id, frame, i, min(d) AS near FROM d GROUP BY ALL), kept AS (SELECT capture_id, frame, i FROM n QUALIFY near <= 5.0 * avg(near) OVER (PARTITION BY capture_id, frame)), e AS (SELECT d.capture_id, d.frame, d.i, d.j FROM d SEMI JOIN kept USING (capture_id, frame, i) WHERE d <= 1.5 AND EXISTS (SELECT 1 FROM kept k WHERE k.capture_id = d.capture_id AND k.frame = d.frame AND k.i = d.j)),
reach AS (SELECT capture_id, frame, i, i AS root FROM kept UNION SELECT e.capture_id, e.frame, e.j, reach.root FROM reach JOIN e ON e.capture_id = reach.capture_id AND e.frame = reach.frame AND e.i = reach.i), lab AS (SELECT capture_id, frame, i, min(root) AS root FROM reach GROUP BY ALL), big AS (SELECT capture_id, frame, root FROM lab GROUP BY ALL HAVING count(*) >= 2), large AS (SELECT *, row_number() OVER (PARTITION BY capture_id, frame ORDER BY root) - 1 AS id FROM big)
SELECT p.capture_id, p.frame, coalesce(id, -1)::INT AS cluster_id, count(*) AS n FROM p LEFT JOIN lab ON lab.capture_id = p.capture_id AND lab.frame = p.frame AND lab.i = p.i LEFT JOIN large ON large.capture_id = p.capture_id AND large.frame = p.frame AND large.root = lab.root GROUP BY ALL""")
def frame_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Chain clusters of each frame's points."""
    found = c.frame_clusters(points(spark, d).withColumn("frame", F.col("frame") % 2000), ["capture_id", "frame"], k="power", link=1.5, least=2)
    return found.groupBy("capture_id", "frame", "cluster_id").agg(F.count("*").alias("n"))
