"""Moments of complex antenna snapshots (re, im arrays) and comparisons of captures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import complex_similarity
from ..helpers.signal import rotation_p
from ..helpers.slopes import median_slope


def capped(entries: DataFrame, keys: list[str], order: list[str], k: int, least: int = 1) -> DataFrame:
    """The first k snapshots of each key, where there are ``least`` or more."""
    window = W.partitionBy(*keys)
    ranked = entries.withColumns({"_at": F.row_number().over(window.orderBy(*order)), "_n": F.count("*").over(window)})
    return ranked.where((F.col("_at") <= k) & (F.col("_n") >= least)).drop("_at", "_n")


def by_antenna(entries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per antenna: keys, a (from 0), re, im."""
    zipped = entries.select(*keys, F.posexplode(F.arrays_zip(F.col("re").alias("re"), F.col("im").alias("im"))).alias("a", "v"))
    return zipped.select(*keys, "a", F.col("v.re").cast("double").alias("re"), F.col("v.im").cast("double").alias("im"))


def bin_moments(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: snapshots, power (trace of the covariance), power of the mean vector, and variance, the difference."""
    per = by_antenna(entries, keys).groupBy(*keys, "a").agg(F.count("*").alias("n"), F.avg("re").alias("mr"), F.avg("im").alias("mi"), F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("p"))
    sums = per.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("p").alias("power"), F.sum(F.col("mr") * F.col("mr") + F.col("mi") * F.col("mi")).alias("mean_power"))
    return sums.withColumn("variance", F.col("power") - F.col("mean_power"))


def covariances(entries: DataFrame, keys: list[str], conjugate: bool = False, fluctuation: bool = False) -> DataFrame:
    """Covariance E[x x^H] of each key as long rows: keys, i, j, re, im, n.

    Each task sums the outer products of its own snapshots, and Spark adds the tasks' sums, so that a hot bin is
    never one group. conjugate: give (X^H X) / K instead. fluctuation: less the mean's outer product.
    """
    fields = [entries.schema[k] for k in keys]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def partial(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for key, own in pdf.groupby(keys, dropna=False, sort=False):
                x = np.stack(own["re"].to_numpy()).astype(float) + 1j * np.stack(own["im"].to_numpy()).astype(float)
                r, n = x.T @ x.conj(), x.shape[1]
                m = x.sum(0)
                cells = pd.DataFrame({"i": np.repeat(np.arange(n), n), "j": np.tile(np.arange(n), n), "re": r.real.ravel(), "im": r.imag.ravel(), "k": len(x)})
                means = pd.DataFrame({"i": np.arange(n), "j": -1, "re": m.real, "im": m.imag, "k": len(x)})
                out = pd.concat([cells, means])
                for name, value in zip(keys, key, strict=True):
                    out[name] = value
                yield out[[*keys, "i", "j", "re", "im", "k"]]

    sums = entries.select(*keys, "re", "im").mapInPandas(partial, f"{kinds}, i int, j int, re double, im double, k long")
    total = sums.groupBy(*keys, "i", "j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("k").alias("n"))
    scaled = total.withColumns({"re": F.col("re") / F.col("n"), "im": F.col("im") / F.col("n")})
    cells = scaled.where("j >= 0")
    if fluctuation:
        m = scaled.where("j < 0").select(*keys, "i", F.col("re").alias("mr"), F.col("im").alias("mi"))
        both = cells.join(m, [*keys, "i"]).join(m.withColumnsRenamed({"i": "j", "mr": "nr", "mi": "ni"}), [*keys, "j"])
        cells = both.select(*keys, "i", "j", (F.col("re") - F.col("mr") * F.col("nr") - F.col("mi") * F.col("ni")).alias("re"), (F.col("im") - F.col("mi") * F.col("nr") + F.col("mr") * F.col("ni")).alias("im"), "n")
    return cells.withColumn("im", -F.col("im")) if conjugate else cells


def robust_base(rounds: DataFrame, keys: list[str], round_id: str = "round", share: float = 0.5) -> DataFrame:
    """Element-wise median over rounds, for keys that are in more than a share of the rounds. rounds: keys, round, i, j, re, im."""
    n = rounds.agg(F.countDistinct(round_id).alias("_rounds"))
    common = rounds.groupBy(*keys).agg(F.countDistinct(round_id).alias("_own")).join(F.broadcast(n)).where(F.col("_own") > share * F.col("_rounds"))
    return rounds.join(common, keys, "left_semi").groupBy(*keys, "i", "j").agg(F.median("re").alias("re"), F.median("im").alias("im"))


def relative_change(a: DataFrame, b: DataFrame, keys: list[str], captures: list[str] | None = None) -> DataFrame:
    """Frobenius norm of b - a over that of a, per key. Inputs: keys, i, j, re, im; b may have ``captures`` besides."""
    more = captures or []
    pair = a.join(b.select(*more, *keys, "i", "j", F.col("re").alias("_re"), F.col("im").alias("_im")), [*keys, "i", "j"])
    off = F.sum((F.col("_re") - F.col("re")) ** 2 + (F.col("_im") - F.col("im")) ** 2)
    own = F.sum(F.col("re") ** 2 + F.col("im") ** 2)
    return pair.groupBy(*more, *keys).agg((F.sqrt(off) / F.greatest(F.sqrt(own), F.lit(1e-12))).alias("rel"))


def change_by_capture(rel: DataFrame, keys: list[str]) -> DataFrame:
    """Median over the bins, and each bin's change against it."""
    whole = W.partitionBy(*keys)
    return rel.withColumns({"med": F.median("rel").over(whole), "bins": F.count("*").over(whole)}).withColumn("scaled", F.col("rel") / F.greatest(F.col("med"), F.lit(1e-12)))


def top_changed(rel: DataFrame, keys: list[str], k: int = 5, value: str = "rel", order: str = "range_bin") -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), order))
    return rel.withColumn("place", place).where(F.col("place") <= k)


def grid_change(a: DataFrame, b: DataFrame, keys: list[str], cells: list[str], value: str = "n") -> DataFrame:
    """Sum of |b - a| over the sum of a, over the cells of either."""
    pair = a.withColumnRenamed(value, "_a").join(b.withColumnRenamed(value, "_b"), [*keys, *cells], "full").fillna(0, ["_a", "_b"])
    return pair.groupBy(*keys).agg((F.sum(F.abs(F.col("_b") - F.col("_a"))) / F.greatest(F.sum("_a"), F.lit(1e-12))).alias("rel"))


def direction_similarity(means: DataFrame, capture: str, keys: list[str]) -> DataFrame:
    """For every two captures: the median over bins of |<m1, m2>| / (|m1| |m2|). means: capture, keys, re, im (arrays)."""
    other = means.withColumnsRenamed({capture: f"{capture}_b", "re": "re_b", "im": "im_b"})
    pair = means.join(other, keys).where(F.col(capture) < F.col(f"{capture}_b"))

    rows = pair.withColumn("sim", complex_similarity("re", "im", "re_b", "im_b"))
    return rows.groupBy(capture, f"{capture}_b").agg(F.median("sim").alias("sim"), F.count("*").alias("bins"))


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Median slope over all pairs of a key's points, and the intercept through the medians; exact, without making the pairs.

    A key's points come to one task as two columns of numbers; keys without two different x give no row.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, value = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        slope = median_slope(at, value)
        rows = [] if slope is None else [(*key, slope, float(np.median(value) - slope * np.median(at)))]
        return pd.DataFrame(rows, columns=[*keys, "slope", "intercept"])

    known = points.select(*keys, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(*keys).applyInPandas(work, f"{kinds}, slope double, intercept double")


def trend_chance(points: DataFrame, keys: list[str], x: str, y: str, shifts: int = 400) -> DataFrame:
    """Per key (tens of window values): rows, and the share of rotated and reversed series that fall as steeply (column p)."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*keys).schema.fields)

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, y])
        p = rotation_p(pdf[x].to_numpy(float), pdf[y].to_numpy(float), shifts)
        return pd.DataFrame([(*key, len(pdf), p)], columns=[*keys, "n", "p"])

    return points.select(*keys, x, y).groupBy(*keys).applyInPandas(work, f"{kinds}, n long, p double")


def motion_score(entries: DataFrame, keys: list[str], order: str, parts: int = 4) -> DataFrame:
    """Mean relative change between the covariances of ``parts`` equal spans of a key's snapshots."""
    span = F.ntile(parts).over(W.partitionBy(*keys).orderBy(order))
    cov = covariances(entries.withColumn("part", span), [*keys, "part"])
    other = cov.withColumnsRenamed({"part": "part_b", "re": "re_b", "im": "im_b"}).drop("n")
    pair = cov.join(other, [*keys, "i", "j"]).where("part < part_b")
    norm = F.sqrt(F.sum((F.col("re_b") - F.col("re")) ** 2 + (F.col("im_b") - F.col("im")) ** 2)) / F.greatest(F.sqrt(F.sum(F.col("re") ** 2 + F.col("im") ** 2)), F.lit(1e-12))
    return pair.groupBy(*keys, "part", "part_b").agg(norm.alias("rel")).groupBy(*keys).agg(F.avg("rel").alias("score"))
