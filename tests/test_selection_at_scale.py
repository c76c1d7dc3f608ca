"""Quantiles by selection, slopes by counting, clusters by cells: against plain versions, and on what would be quadratic."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthwave.helpers import slopes
from hearthwave.operators import clusters, moments, quantiles


def test_quantiles_equal_the_sorted_ones(spark):
    e = random.Random(1)
    rows = [("a", e.gauss(0, 1)) for _ in range(1001)] + [("b", float(e.randrange(4))) for _ in range(600)] + [("c", 10.0 ** e.uniform(-200, 200) * e.choice([-1, 1])) for _ in range(400)]
    rows += [("d", 5.0)] * 300 + [("e", 1.0), ("f", None), (None, 2.0), (None, 4.0), ("g", float("nan")), ("g", 3.0), ("h", -1.7e308), ("h", 1.7e308), ("h", 0.0)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(5).withColumn("n", F.lit("x"))
    got = {r["key"]: r for r in quantiles.quantiles(df, ["key"], "v", {"low": 0.05, "med": 0.5, "top": 1.0}).collect()}
    values = {}
    for k, v in rows:
        if v is not None and v == v:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, own in values.items():
        assert got[k]["n"] == len(own)
        for name, q in (("low", 0.05), ("med", 0.5), ("top", 1.0)):
            at = q * (len(own) - 1)
            s = sorted(own)
            low, high = s[int(at)], s[min(int(at) + 1, len(s) - 1)]
            want = low if at == int(at) or low == high else low * (1 - (at - int(at))) + high * (at - int(at))
            assert got[k][name] == pytest.approx(want, rel=1e-12)
    assert quantiles.quantiles(df.where("false"), ["key"], "v", {"med": 0.5}).count() == 0


def test_spread_equals_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(v)) for k in range(3) for v in rng.lognormal(size=500 + k)]
    for r in quantiles.spread(spark.createDataFrame(rows, "key int, v double"), ["key"], "v", 1.4826).collect():
        own = np.array([v for k, v in rows if k == r["key"]])
        assert r["n"] == len(own) and r["med"] == pytest.approx(np.median(own)) and r["sigma"] == pytest.approx(1.4826 * np.median(np.abs(own - np.median(own))))


def _plain_slope(x, y):
    i, j = np.triu_indices(len(x), 1)
    dx, dy = x[j] - x[i], y[j] - y[i]
    return float(np.median(dy[dx != 0] / dx[dx != 0])) if (dx != 0).any() else None


def test_median_slope_equals_all_pairs():
    rng = np.random.default_rng(0)
    for t in range(120):
        n, kind = int(rng.integers(1, 200)), t % 6
        x = [rng.normal(size=n), rng.integers(0, 9, n) * 1.0, np.arange(n) * 1.0, rng.integers(0, 3, n) * 1.0, rng.normal(size=n) * 1e6 + 1.7e9, np.repeat(1.0, n)][kind]
        y = [rng.normal(size=n), rng.integers(0, 4, n) * 1.0, np.repeat(2.0, n), rng.normal(size=n), 3 * x + rng.normal(size=n) * 1e-3, rng.normal(size=n)][kind]
        got, want = slopes.median_slope(x, y), _plain_slope(x, y)
        assert (got is None and want is None) or got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_long_series_make_no_pairs(spark):
    """100,000 points of a key are 5 x 10^9 pairs."""
    rng = np.random.default_rng(3)
    x = rng.permutation(100_000) / 100
    y = 0.25 * x + rng.standard_cauchy(100_000)
    df = spark.createDataFrame(zip(["k"] * len(x), x.tolist(), y.tolist(), strict=True), "key string, x double, y double")
    start = time.process_time()
    (r,) = moments.theil_sen(df, ["key"], "x", "y").collect()
    assert r["slope"] == pytest.approx(0.25, abs=1e-3) and r["intercept"] == pytest.approx(float(np.median(y) - r["slope"] * np.median(x)))
    assert time.process_time() - start < 30
    assert slopes.median_slope(x, 3 * x) == pytest.approx(3.0)


def _plain_dbscan(at, eps, least):
    d2 = ((at[:, None, :] - at[None, :, :]) ** 2).sum(-1)
    near = d2 <= eps * eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(at)), -1)
    while True:
        new = np.array([min([label[j] for j in np.flatnonzero(near[i] & core)], default=-1) if core[i] else -1 for i in range(len(at))])
        if (new == label).all():
            break
        label = new
    label = np.array([label[i] if core[i] else min([label[j] for j in np.flatnonzero(near[i] & core)], default=-1) for i in range(len(at))])
    ids = {v: k for k, v in enumerate(sorted({v for v in label.tolist() if v >= 0}))}
    return [ids.get(v, -1) for v in label.tolist()]


@pytest.mark.parametrize("seed", [1])
def test_clusters_equal_the_plain_ones(spark, seed):
    """Blobs denser than a cell takes, chains along cell borders, lone points, lattice points at exactly eps, negative places."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n, 3)) for c, s, n in ((0, 0.1, 90), (1, 0.3, 60), (-2, 0.03, 50), (3, 1.0, 40))]
    parts.append(np.column_stack([np.arange(30) * 0.35 + 5, np.zeros(30), np.zeros(30)]))
    parts.append(np.array([[i * 0.25, j * 0.25, -4.0] for i in range(6) for j in range(6)]))
    at = np.round(np.concatenate(parts), 3)
    rows = [(k, i, *map(float, p)) for k in ("a", "b") for i, p in enumerate(at if k == "a" else at[::2])]
    df = spark.createDataFrame(rows, "key string, node long, x double, y double, z double").repartition(4)
    for eps, least in ((0.35, 5), (0.25, 3)):
        got = {(r["key"], r["node"]): r["cluster_id"] for r in clusters.dbscan(df, ["key"], "node", eps, least).collect()}
        for k, own in (("a", at), ("b", at[::2])):
            assert [got[k, i] for i in range(len(own))] == _plain_dbscan(own, eps, least)


def test_a_dense_cell_makes_no_pairs(spark):
    """100,000 equal points, and 20,000 different ones in two cells that touch at their borders alone."""
    df = spark.range(100_000).select(F.lit("k").alias("key"), F.col("id").alias("node"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    more = spark.range(20_000).select(F.lit("k").alias("key"), (F.col("id") + 200_000).alias("node"), (F.lit(5.0) + (F.col("id") % 2) * 0.36 + F.rand(1) * 0.05).alias("x"), F.rand(2).alias("y") * 0.1, F.rand(3).alias("z") * 0.1)
    start = time.monotonic()
    got = {(r["cluster_id"], r["n"]) for r in clusters.dbscan(df.unionAll(more.toDF(*df.columns)), ["key"], "node").groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 100_000), (1, 20_000)} and time.monotonic() - start < 120


def test_touching_sets():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.random((200, 3)), rng.random((150, 3)) + [1.2, 0, 0]
        least = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1).min())
        assert clusters.touching(a, b, least * 1.0001) and not clusters.touching(a, b, least * 0.9999)
