"""Clusters of points and cells: neighbours by a grid of cells, components by label spreading, boxes and planes."""

from __future__ import annotations

import itertools
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import voxels as v


def checkpointed(df: DataFrame) -> DataFrame:
    """The lineage is cut in the folder of spark.checkpoint.dir; one of its own only where that is unset and all runs in one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str, rounds: int = 50) -> DataFrame:
    """Adds ``label``: the smallest node number reachable. edges: keys, a, b, in both directions.

    Each round takes the least label among a node and its neighbours, then that label's own label, which halves
    the way left to go; the lineage is cut each round.
    """
    now = checkpointed(nodes.withColumn("label", F.col(node)))
    for _ in range(rounds):
        held = now.select(*keys, F.col(node).alias("b"), "label")
        near = edges.join(held, [*keys, "b"]).groupBy(*keys, F.col("a").alias(node)).agg(F.min("label").alias("_l"))
        spread = now.join(near, [*keys, node], "left").withColumn("_new", F.least("label", "_l"))
        own = spread.select(*keys, F.col(node).alias("_new"), F.col("_new").alias("_up"))
        jumped = checkpointed(spread.join(own, [*keys, "_new"], "left").select(*nodes.columns, F.col("label").alias("_old"), F.least("_new", "_up").alias("label")))
        changed = jumped.where("label <> _old").limit(1).count()
        now = jumped.drop("_old")
        if not changed:
            return now
    raise RuntimeError(f"the labels didn't settle within {rounds} rounds")


def touching(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether any two points of the two sets lie within ``eps``: halves of the sets that boxes rule in or out are not looked into."""
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        low, high = np.maximum(a.min(0), b.min(0)), np.minimum(a.max(0), b.max(0))
        if (np.maximum(low - high, 0) ** 2).sum() > eps * eps * (1 + 1e-12):
            continue
        far = np.maximum(a.max(0), b.max(0)) - np.minimum(a.min(0), b.min(0))
        if (far**2).sum() <= eps * eps * (1 - 1e-12):
            return True
        if len(a) * len(b) <= 4096:
            if (((a[:, None, :] - b[None, :, :]) ** 2).sum(-1) <= eps * eps).any():
                return True
            continue
        first, second = (a, b) if len(a) >= len(b) else (b, a)
        side = int((first.max(0) - first.min(0)).argmax())
        order = np.argpartition(first[:, side], len(first) // 2)
        waiting += [(first[order[: len(first) // 2]], second), (first[order[len(first) // 2 :]], second)]
    return False


def _numbered(labels: DataFrame, keys: list[str]) -> Column:
    from pyspark.sql import Window as W

    return F.dense_rank().over(W.partitionBy(*keys).orderBy("label")) - 1


def dbscan(points: DataFrame, keys: list[str], node: str, eps: float = 0.35, least: int = 5) -> DataFrame:
    """Adds ``cluster_id``: from 0 by each cluster's smallest node, -1 for noise.

    A point with ``least`` neighbours within eps, itself included, is a core; a border point gets its least core label.
    Points stand in cells so small that all of a cell are neighbours: a cell of ``least`` points is all core and one
    node of the graph, named by its least point, so that no pairs are made within it. Points of other cells, fewer than
    ``least`` in each, meet the cells around; two full cells are joined if their closest points are within eps, which
    boxes tell for most. The work is linear in the points of a cell.
    """
    side = eps / 3**0.5 * (1 - 1e-9)
    cell = ["_cx", "_cy", "_cz"]
    base = points.select(*keys, F.col(node).alias("_node"), *(F.col(c).cast("double").alias(f"_{c}") for c in "xyz"))
    placed = base.withColumns({f"_c{c}": F.floor(F.col(f"_{c}") / side) for c in "xyz"})
    box = [f(f"_{c}").alias(f"_{n}{c}") for n, f in (("low", F.min), ("high", F.max)) for c in "xyz"]
    cells = checkpointed(placed.groupBy(*keys, *cell).agg(F.count("*").alias("_n"), F.min("_node").alias("_rep"), *box).withColumn("_full", F.col("_n") >= least))
    sparse = placed.join(cells.where(~F.col("_full")).select(*keys, *cell), [*keys, *cell])

    def around(some: DataFrame, shifts: list[tuple]) -> DataFrame:
        """``some`` cells as _ox, _oy, _oz, with the cells at the shifts from them."""
        home = some.select(*keys, *(F.col(c).alias(c.replace("_c", "_o")) for c in cell), F.explode(F.array(*(F.array(*map(F.lit, s)) for s in shifts))).alias("_s"))
        return home.withColumns({c: F.col(c.replace("_c", "_o")) + F.col("_s")[i] for i, c in enumerate(cell)}).drop("_s")

    every = list(itertools.product(range(-2, 3), repeat=3))
    met = around(cells.where(~F.col("_full")).select(*keys, *cell), every).join(cells.select(*keys, *cell, "_full", "_rep"), [*keys, *cell])
    own = sparse.select(*keys, F.col("_node").alias("a"), *(F.col(f"_{c}").alias(f"_a{c}") for c in "xyz"), *(F.col(c).alias(c.replace("_c", "_o")) for c in cell))
    pairs = own.join(met, [*keys, "_ox", "_oy", "_oz"]).join(placed, [*keys, *cell])
    d2 = sum(((F.col(f"_a{c}") - F.col(f"_{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    near = checkpointed(pairs.where(d2 <= eps * eps).groupBy(*keys, "a", F.when(F.col("_full"), F.col("_rep")).otherwise(F.col("_node")).alias("b"), "_full").agg(F.count("*").alias("_n")))
    lone = near.groupBy(*keys, F.col("a").alias(node)).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least).select(*keys, node)
    core = checkpointed(lone.unionAll(cells.where("_full").select(*keys, F.col("_rep").alias(node))))
    in_a, in_b = core.withColumnRenamed(node, "a"), core.withColumnRenamed(node, "b")
    known = near.join(in_b, [*keys, "b"], "left_semi").select(*keys, "a", "b")
    links = known.join(in_a, [*keys, "a"], "left_semi")
    edges = links.unionAll(_joined_cells(placed, cells.where("_full"), keys, cell, around, eps))
    labelled = checkpointed(components(core, checkpointed(edges.unionAll(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), keys, node))
    reached = known.join(labelled.withColumnRenamed(node, "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias(node)).agg(F.min("label").alias("_border"))
    of_cells = cells.where("_full").select(*keys, *cell, F.col("_rep").alias(node)).join(labelled, [*keys, node]).select(*keys, *cell, F.col("label").alias("_inside"))
    told = points.withColumns({f"_c{c}": F.floor(F.col(c).cast("double") / side) for c in "xyz"}).join(of_cells, [*keys, *cell], "left").drop(*cell)
    found = told.join(reached, [*keys, node], "left").join(labelled, [*keys, node], "left").withColumn("label", F.coalesce("_inside", "label", "_border")).drop("_border", "_inside")
    ids = labelled.select(*keys, "label").distinct()
    numbered = ids.withColumn("cluster_id", _numbered(ids, keys))
    return found.join(numbered, [*keys, "label"], "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).drop("label")


def _joined_cells(placed: DataFrame, full: DataFrame, keys: list[str], cell: list[str], around: Callable[[DataFrame, list[tuple]], DataFrame], eps: float) -> DataFrame:
    """(keys, a, b): the names of full cells whose closest points are within eps; each two cells are looked at once.

    The boxes of their points tell for most; else their different points that lie near the other's box are compared.
    """
    half = [s for s in itertools.product(range(-2, 3), repeat=3) if s > (0, 0, 0)]
    box = [f"_{n}{c}" for n in ("low", "high") for c in "xyz"]
    one = full.select(*keys, *(F.col(c).alias(c.replace("_c", "_o")) for c in cell), F.col("_rep").alias("a"), *(F.col(c).alias(f"{c}_a") for c in box))
    two = full.select(*keys, *cell, F.col("_rep").alias("b"), *(F.col(c).alias(f"{c}_b") for c in box))
    pairs = around(full.select(*keys, *cell), half).join(two, [*keys, *cell]).join(one, [*keys, "_ox", "_oy", "_oz"])

    def gap(c: str) -> Column:
        return F.greatest(F.col(f"_low{c}_b") - F.col(f"_high{c}_a"), F.col(f"_low{c}_a") - F.col(f"_high{c}_b"), F.lit(0.0))

    def reach(c: str) -> Column:
        return F.greatest(f"_high{c}_a", f"_high{c}_b") - F.least(f"_low{c}_a", f"_low{c}_b")

    apart, most = (sum((f(c) ** 2 for c in "xyz"), F.lit(0.0)) for f in (gap, reach))
    judged = checkpointed(pairs.where(apart <= eps * eps * (1 + 1e-12)).withColumn("_sure", most <= eps * eps * (1 - 1e-12)))
    open_ = judged.where(~F.col("_sure"))
    spots = placed.select(*keys, *cell, "_x", "_y", "_z").distinct()

    def side(mine: str, other: str, at: list[str]) -> DataFrame:
        """The points of one cell of each open pair that lie within eps of the other's box."""
        rows = spots.join(open_.select(*keys, *(F.col(c).alias(n) for c, n in zip(at, cell, strict=True)), "a", "b", *(F.col(f"{c}_{other}").alias(c) for c in box)), [*keys, *cell])
        off = sum((F.greatest(F.col(f"_low{c}") - F.col(f"_{c}"), F.col(f"_{c}") - F.col(f"_high{c}"), F.lit(0.0)) ** 2 for c in "xyz"), F.lit(0.0))
        return rows.where(off <= eps * eps * (1 + 1e-12)).select(*keys, "a", "b", F.lit(mine == "a").alias("_first"), "_x", "_y", "_z")

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["_first"].to_numpy(bool)
        at = pdf[["_x", "_y", "_z"]].to_numpy(float)
        hit = first.any() and not first.all() and touching(at[first], at[~first], eps)
        return pdf[[*keys, "a", "b"]].head(1 if hit else 0)

    both = side("a", "b", ["_ox", "_oy", "_oz"]).unionAll(side("b", "a", cell))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in judged.select(*keys, "a", "b").schema.fields)
    return judged.where("_sure").select(*keys, "a", "b").unionAll(both.groupBy(*keys, "a", "b").applyInPandas(decide, kinds))


def cell_components(cells: DataFrame, keys: list[str], dims: list[str]) -> DataFrame:
    """Adds ``label`` to cells that touch by a face (6 neighbours in 3-D, 4 in 2-D): the least cell number reachable."""
    number = F.lit(0).cast("long")
    for d in dims:
        number = number * 1_000_003 + F.col(d) + 500_000
    numbered = cells.withColumn("_id", number)
    steps = [tuple(s if i == j else 0 for j in range(len(dims))) for i in range(len(dims)) for s in (-1, 1)]
    around = numbered.select(*keys, F.col("_id").alias("b"), *dims, F.explode(F.array(*(F.array(*map(F.lit, s)) for s in steps))).alias("_s"))
    moved = around.withColumns({d: F.col(d) + F.col("_s")[i] for i, d in enumerate(dims)}).drop("_s")
    edges = checkpointed(numbered.select(*keys, *dims, F.col("_id").alias("a")).join(moved, [*keys, *dims]).select(*keys, "a", "b"))
    return components(numbered, edges, keys, "_id").drop("_id")


def change_events(change: DataFrame, keys: list[str], rel: float = 0.3, least: int = 2, fall_z: float = 0.4, cell: float = 0.3, origin: tuple = (-3.0, 0.0, -0.1)) -> DataFrame:
    """Regions of gain (appeared) and loss (gone) above ``rel`` of the peak change: weighted centre, magnitude, cells.

    An appeared region whose centre is below ``fall_z`` is in the fall zone.
    """
    peak = change.groupBy(*keys).agg(F.max(F.abs("d")).alias("_peak"))
    strong = change.join(peak, keys).where((F.abs("d") > rel * F.col("_peak")) & (F.col("_peak") > 0)).withColumn("kind", F.when(F.col("d") > 0, "appeared").otherwise("gone")).drop("_peak")
    regions = cell_components(strong, [*keys, "kind"], v.CELLS)
    w = F.abs("d")
    centre = [(F.sum(w * ((F.col(i) + 0.5) * cell + o)) / F.sum(w)).alias(f"c{c}") for i, c, o in zip(v.CELLS, "xyz", origin, strict=True)]
    found = regions.groupBy(*keys, "kind", "label").agg(*centre, F.sum(w).alias("magnitude"), F.count("*").alias("n_voxels")).where(F.col("n_voxels") >= least)
    return found.drop("label").withColumn("fall_zone", (F.col("kind") == "appeared") & (F.col("cz") < fall_z))


def hot_regions(ratio: DataFrame, keys: list[str], hot: Column, least: int = 3) -> DataFrame:
    """Regions of hot floor cells (ix, iy, ratio): cells, peak ratio, centroid; regions under ``least`` cells go."""
    regions = cell_components(ratio.where(hot), keys, ["ix", "iy"])
    found = regions.groupBy(*keys, "label").agg(F.count("*").alias("n_cells"), F.max("ratio").alias("peak"), F.avg("ix").alias("cx"), F.avg("iy").alias("cy"))
    return found.where(F.col("n_cells") >= least).drop("label")


def detect_objects(points: DataFrame, keys: list[str], cell: float = 0.1, dense: int = 10, floor: float = 0.0, floor_band: float = 0.15, eps: float = 0.35, least: int = 5) -> DataFrame:
    """The whole furniture pass: ghosts out, stable cells, the floor out, clusters, boxes, labels."""
    cells = v.stable_voxels(points, keys, cell, dense, floor).where(F.col("z") >= floor_band)
    nodes = cells.withColumn("node", ((F.col("ix") + 50_000).cast("long") * 100_000 + F.col("iy") + 50_000) * 100_000 + F.col("iz"))
    return v.boxes(dbscan(nodes.select(*keys, "node", "x", "y", "z"), keys, "node", eps, least), keys)


def frame_clusters(points: DataFrame, keys: list[str], k: str = "k", outlier: float = 5.0, link: float = 0.4, least: int = 4) -> DataFrame:
    """Chain clusters within each frame (tens to hundreds of points): adds ``cluster_id``, dropped points get -1.

    Points whose nearest neighbour is over ``outlier`` times the mean away go first; the rest link up to ``link``.
    Clusters are numbered by their first point. Frames are packed into few batches, not one call each.
    """
    fields = points.schema.fields
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    names = [f.name for f in fields]
    packed = points.repartition(*keys).sortWithinPartitions(*keys, k, "x", "y", "z")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the frame that the last batch ended in

        def numbered(table: pa.Table) -> pa.RecordBatch:
            at = pa.Table.to_pandas(table.select(keys))
            first = np.flatnonzero(np.r_[True, (at.ne(at.shift())).to_numpy()[1:].any(1)])
            xyz = np.column_stack([table.column(c).to_numpy().astype(float) for c in "xyz"])
            ids = np.concatenate([chain(xyz[s:e], outlier, link, least) for s, e in zip(first, [*first[1:], len(xyz)], strict=True)])
            return table.append_column("cluster_id", pa.array(ids, pa.int32())).combine_chunks().to_batches()[0]

        for b in it:
            if not b.num_rows:
                continue
            at = b.select(keys).to_pandas()
            last = (at != at.iloc[-1]).any(axis=1).to_numpy()
            cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
            if cut or (held and [held[-1].column(c)[0].as_py() for c in keys] != [b.column(c)[0].as_py() for c in keys]):
                yield numbered(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield numbered(pa.Table.from_batches(held))

    return packed.select(*names).mapInArrow(batches, f"{kinds}, cluster_id int")


def chain(xyz: np.ndarray, outlier: float, link: float, least: int) -> np.ndarray:
    """Cluster numbers of one frame's points."""
    n = len(xyz)
    out = np.full(n, -1)
    if n < 2:
        return out
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    near = (d + np.where(np.eye(n, dtype=bool), np.inf, 0.0)).min(1)
    kept = np.flatnonzero(near <= outlier * near.mean())
    left, number = set(kept.tolist()), 0
    for start in kept.tolist():
        if start not in left:
            continue
        left.discard(start)
        members, queue = [start], [start]
        while queue:
            at = queue.pop()
            reached = [j for j in left if d[at, j] <= link]
            left.difference_update(reached)
            members += reached
            queue += reached
        if len(members) >= least:
            out[members] = number
            number += 1
    return out


def planes(points: DataFrame, keys: list[str], most: int = 4, tries: int = 1000, inlier: float = 0.05, least: int = 10, seed: int = 7, block: int = 1_000) -> DataFrame:
    """Dominant planes by random triples: keys, plane, normal (a, b, c), offset d, inliers; each takes its inliers away.

    ``tries`` triples are drawn by seeded hashes over all distinct points of a key, each point with the same chance in
    each draw, and all points count (repeated ones as often as they are there). Points are scored in blocks of about
    ``block`` against the key's candidates, of which there are ``tries``, and the blocks' counts are added up. A block's
    numbers stay in Arrow's arrays: a worker holds one batch of them and the comparison of one block.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)
    rest = checkpointed(points.groupBy(*keys, "x", "y", "z").agg(F.count("*").alias("copies")))
    out = None
    for number in range(most):
        # of a key's points some are drawn: each has three hashed chances in ``tries`` that grow with how few there are
        total = rest.groupBy(*keys).agg(F.count("*").alias("_all"))
        slots = F.greatest(F.lit(1), F.ceil(3.0 * tries / F.col("_all"))).cast("int")
        chance = F.pmod(F.xxhash64("x", "y", "z", "_i", F.lit(seed + number)), F.lit(1 << 30)) / float(1 << 30)
        drawn = rest.join(total, keys).withColumn("_slots", slots).withColumn("_i", F.explode(F.sequence(F.lit(1), "_slots"))).where(chance <= 4.0 * tries / (F.col("_all") * F.col("_slots")))
        bucket = F.pmod(F.xxhash64("z", "y", "x", "_i", F.lit(seed + 100 + number)), F.lit(tries)).cast("int")
        three = drawn.withColumn("_t", bucket).groupBy(*keys, "_t").agg(F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("x", "y", "z", "_i").alias("h"), "x", "y", "z"))), 1, 3).alias("p")).where(F.size("p") == 3)
        u = {c: F.col("p")[1][c] - F.col("p")[0][c] for c in "xyz"}
        w = {c: F.col("p")[2][c] - F.col("p")[0][c] for c in "xyz"}
        normal = {"a": u["y"] * w["z"] - u["z"] * w["y"], "b": u["z"] * w["x"] - u["x"] * w["z"], "c": u["x"] * w["y"] - u["y"] * w["x"]}
        size = F.sqrt(normal["a"] ** 2 + normal["b"] ** 2 + normal["c"] ** 2)
        unit = {n: e / size for n, e in normal.items()}
        offset = -(unit["a"] * F.col("p")[0]["x"] + unit["b"] * F.col("p")[0]["y"] + unit["c"] * F.col("p")[0]["z"])
        candidates = three.where(size > 1e-9).select(*keys, "_t", *(e.alias(n) for n, e in unit.items()), offset.alias("d"))
        listed = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_t", "a", "b", "c", "d"))).alias("_planes"))

        def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                lists = {c: b.column(c) for c in ("_points", "_planes")}
                ends = {c: v.offsets.to_numpy() for c, v in lists.items()}
                held = {c: {f.name: v.values.field(f.name).to_numpy(zero_copy_only=False) for f in v.type.value_type} for c, v in lists.items()}
                for i in range(b.num_rows):
                    xyz, copies = (np.column_stack([held["_points"][c][ends["_points"][i] : ends["_points"][i + 1]] for c in names]) for names in (("x", "y", "z"), ("copies",)))
                    q = {c: v[ends["_planes"][i] : ends["_planes"][i + 1]] for c, v in held["_planes"].items()}
                    n = copies[:, 0] @ (np.abs(xyz @ np.column_stack([q["a"], q["b"], q["c"]]).T + q["d"]) <= inlier)
                    own = np.full(len(n), i)
                    yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(own)) for k in keys), *(pa.array(v) for v in q.values()), pa.array(n.astype(np.int64))], names=[*keys, *q, "n"])

        part = F.pmod(F.xxhash64("x", "y", "z"), F.ceil(F.col("_all") / block))
        blocks = rest.join(total, keys).groupBy(*keys, part.alias("_b")).agg(F.collect_list(F.struct("x", "y", "z", "copies")).alias("_points"))
        scored = blocks.join(listed, keys).select(*keys, "_points", "_planes").mapInArrow(score, f"{kinds}, _t int, a double, b double, c double, d double, n long")
        counted = scored.groupBy(*keys, "_t", "a", "b", "c", "d").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        best = checkpointed(counted.groupBy(*keys).agg(F.max_by(F.struct("a", "b", "c", "d"), F.struct("n", -F.col("_t"))).alias("q"), F.max("n").alias("inliers")))
        found = best.select(*keys, F.lit(number).alias("plane"), "q.a", "q.b", "q.c", "q.d", "inliers")
        out = found if out is None else out.unionByName(found)
        on = F.abs(F.col("q.a") * F.col("x") + F.col("q.b") * F.col("y") + F.col("q.c") * F.col("z") + F.col("q.d")) <= inlier
        rest = checkpointed(rest.join(best, keys).where(~on).select(*keys, "x", "y", "z", "copies"))
    return out
