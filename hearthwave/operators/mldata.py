"""Training tables of posture and fall models, and their fitting with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def live_files(tracks: DataFrame, key: str = "file", least: float = 0.10) -> DataFrame:
    """Rows of files whose height axis moves: the largest |posz| is ``least`` or more."""
    good = tracks.groupBy(key).agg(F.max(F.abs("posz")).alias("_m")).where(F.col("_m") >= least)
    return tracks.join(good, key, "left_semi")


def sane_tracks(tracks: DataFrame, z: tuple[float, float] = (-4.0, 3.0), limit: float = 1e3) -> DataFrame:
    """Tracker rows with a possible height and possible speeds and accelerations."""
    ok = F.col("posz").between(*z)
    for c in ("velx", "vely", "velz", "accx", "accy", "accz"):
        ok = ok & (F.abs(F.coalesce(F.col(c), F.lit(0.0))) <= limit)
    return tracks.where(ok & ~F.isnan("posz"))


def gated_points(points: DataFrame, tracks: DataFrame, keys: list[str], dy: tuple[float, float] = (-4.0, 5.0), z: tuple[float, float] = (-4.0, 3.0), least: int = 5) -> DataFrame:
    """Points near their track along y and within heights, of rows that keep ``least`` of them."""
    near = points.join(tracks.select(*keys, "posy"), keys).where((F.col("y") - F.col("posy")).between(*dy) & F.col("z").between(*z)).drop("posy")
    counts = near.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return near.join(counts, keys, "left_semi")


def balance(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows per class and recording, and their share of the recording."""
    counts = windows.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))


def fold_of(group: str, folds: int):
    """Fold of a row by its group, so that no group is in two."""
    return F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")


def oversampled(df: DataFrame, label: str = "label", most: int = 10) -> DataFrame:
    """Rows of rare classes repeated, up to ``most`` times, toward the largest class's number."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    top = counts.agg(F.max("_n").alias("_top"))
    times = counts.join(F.broadcast(top)).select(label, F.least(F.round(F.col("_top") / F.col("_n")).cast("int"), F.lit(most)).alias("_times"))
    return df.join(times, label).withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest("_times", F.lit(1))))).drop("_times", "_i")


def _sums(table: DataFrame, width: int, make: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of what ``make`` (of recording numbers, labels, weights and features) tells of a batch: rows of ``width`` numbers. One job."""

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in it:
            if len(pdf):
                part = make(pdf["_g"].to_numpy(), pdf["_y"].to_numpy(float), pdf["_w"].to_numpy(float), np.stack(pdf["_x"].to_numpy()).astype(float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    parts = table.mapInPandas(work, "i long, v array<double>").select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    rows = parts.toPandas().sort_values(["i", "j"])
    return rows["v"].to_numpy(float).reshape(-1, width) if len(rows) else np.zeros((0, width))


def fitted_without(table: DataFrame, folds: int, dims: int, reg: float, steps: int = 60) -> np.ndarray:
    """(folds, 1 + dims): bias and weights of a logistic model for each recording left out, by Newton steps for all at once.

    table: _g (number of the recording), _y, _w (weight), _x. A step is one job, whatever the number of recordings: the sums
    of a fold are those of all rows less those of its own recording. Weights are held back by their features' spread.
    """
    size = 1 + dims
    first = _sums(table, 2 + 2 * dims + 2, lambda g, y, w, x: _by_group(g, np.column_stack([w, w * w, w[:, None] * x, w[:, None] * x * x, w * y, w * (1 - y)]), folds))
    own = first.sum(axis=0) - first
    weight = np.maximum(own[:, :1], 1e-300)
    mean = own[:, 2 : 2 + dims] / weight
    spread = (own[:, 2 + dims : 2 + 2 * dims] - weight * mean**2) / np.maximum(weight - own[:, 1:2] / weight, 1e-300)
    held = np.column_stack([np.zeros(folds), reg * np.maximum(spread, 0)])
    both = (own[:, -2] > 0) & (own[:, -1] > 0)
    beta = np.zeros((folds, size))
    scale = np.column_stack([np.ones(folds), np.where(spread > 0, np.sqrt(np.maximum(spread, 1e-300)), 1.0)])
    for _ in range(steps):
        now = beta.copy()

        def slopes(g: np.ndarray, y: np.ndarray, w: np.ndarray, x: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            x1 = np.column_stack([np.ones(len(x)), x])
            out = np.zeros((folds, size + size * size))
            for f in range(folds):
                rows = g != f
                p = 1 / (1 + np.exp(-np.clip(x1[rows] @ now[f], -500, 500)))
                out[f, :size] = x1[rows].T @ (w[rows] * (p - y[rows]))
                out[f, size:] = ((x1[rows] * (w[rows] * p * (1 - p))[:, None]).T @ x1[rows]).ravel()
            return out

        sums = _sums(table, size + size * size, slopes)
        moved = 0.0
        for f in np.flatnonzero(both):
            gradient = sums[f, :size] / weight[f] + held[f] * beta[f]
            bend = sums[f, size:].reshape(size, size) / weight[f] + np.diag(held[f] + 1e-12 * scale[f] ** 2)
            step = np.linalg.lstsq(bend, gradient, rcond=None)[0]
            long = float(np.abs(step * scale[f]).max())
            beta[f] -= step * min(1.0, 5.0 / max(long, 1e-300))
            moved = max(moved, long)
        if moved < 1e-9:
            break
    return beta


def _by_group(g: np.ndarray, rows: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros((groups, rows.shape[1]))
    np.add.at(out, g, rows)
    return out


def areas(scored: DataFrame, group: str) -> DataFrame:
    """Per recording: n and auc (null where it has one class only), exact, from counts by score. scored: group, _y, _z."""
    per = scored.groupBy(group, "_z").agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg"))
    below = F.sum("_neg").over(W.partitionBy(group).orderBy("_z")) - F.col("_neg")
    won = per.withColumn("_won", F.col("_pos") * (below + F.col("_neg") / 2))
    total = won.groupBy(group).agg(F.sum(F.col("_pos") + F.col("_neg")).cast("long").alias("n"), F.sum("_won").alias("_won"), F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    return total.select(group, "n", F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_won") / (F.col("_p") * F.col("_q"))).alias("auc"))


def leave_one_out(features: DataFrame, columns: list[str], group: str, label: str = "label", reg: float = 0.01) -> DataFrame:
    """Logistic fusion with one recording held out at a time: group, n, auc (null where it has one class only).

    All folds are fitted together: jobs grow with the Newton steps and not with the recordings, whose names are on the driver.
    Rows with a missing feature or label are left out; where the rest of the recordings has one class only, all score alike.
    """
    known = features.select(F.col(group).alias("_name"), F.col(label).cast("double").alias("_y"), F.array(*(F.col(c).cast("double") for c in columns)).alias("_x"))
    known = known.where(F.col("_y").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v))).persist()
    names = sorted(r["_name"] for r in known.select("_name").distinct().collect())
    kind = features.schema[group].dataType.simpleString()
    numbers = known.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], f"_name {kind}, _g int")
    share = known.agg(F.avg("_y")).first()[0] or 0.0
    table = known.join(numbers, "_name").withColumn("_w", F.when(F.col("_y") == 1, 1 - share).otherwise(share)).persist()
    beta = fitted_without(table, len(names), len(columns), reg)

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                own = beta[pdf["_g"].to_numpy()]
                yield pd.DataFrame({group: pdf["_name"], "_y": pdf["_y"], "_z": own[:, 0] + (np.stack(pdf["_x"].to_numpy()) * own[:, 1:]).sum(axis=1)})

    scored = table.mapInPandas(score, f"`{group}` {kind}, _y double, _z double")
    rows = areas(scored, group).collect()
    table.unpersist()
    known.unpersist()
    return features.sparkSession.createDataFrame(rows, f"`{group}` {kind}, n long, auc double")


def compared(features: DataFrame, sets: dict[str, list[str]], group: str, label: str = "label", reg: float = 0.01) -> DataFrame:
    """Leave-one-out of several feature sets on the same recordings: name, group, n, auc."""
    found = None
    for name, columns in sets.items():
        own = leave_one_out(features, columns, group, label, reg).select(F.lit(name).alias("name"), group, "n", "auc")
        found = own if found is None else found.unionByName(own)
    return found


def exported(features: DataFrame, columns: list[str], label: str = "label", reg: float = 0.01) -> DataFrame:
    """Weights of a logistic model as rows: name, mean, scale, weight; the bias is a row of its own."""
    table = VectorAssembler(inputCols=columns, outputCol="raw").transform(features).select(F.col(label).cast("double").alias("label"), "raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(table)
    model = LogisticRegression(regParam=reg).fit(scaler.transform(table))
    rows = [(c, float(m), float(s), float(w)) for c, m, s, w in zip(columns, scaler.mean, scaler.std, model.coefficients, strict=True)]
    return features.sparkSession.createDataFrame([*rows, ("bias", 0.0, 1.0, float(model.intercept))], "name string, mean double, scale double, weight double")


def posture_model(windows: DataFrame, layers: list[int], folds: int = 5, group: str = "file", seed: int = 7, iterations: int = 100) -> DataFrame:
    """Grouped cross-validation of a perceptron over window vectors: fold, n, accuracy. windows: group, vector, label."""
    rows = windows.select(fold_of(group, folds).alias("fold"), array_to_vector("vector").alias("features"), F.col("label").cast("double").alias("label")).persist()
    found = []
    for fold in range(folds):
        train, test = rows.where(F.col("fold") != fold), rows.where(F.col("fold") == fold)
        if test.isEmpty() or train.isEmpty():
            continue
        model = MultilayerPerceptronClassifier(layers=layers, seed=seed, maxIter=iterations).fit(oversampled(train))
        hit = model.transform(test).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy")).first()
        found.append((fold, hit["n"], hit["accuracy"]))
    rows.unpersist()
    return windows.sparkSession.createDataFrame(found, "fold int, n long, accuracy double")


def apply_perceptron(windows: DataFrame, weights: list[tuple[np.ndarray, np.ndarray]], keep: list[str], name: str = "chances") -> DataFrame:
    """Class chances of fixed weights (matrix and bias of each layer): rectified inside, softmax at the end."""

    def forward(x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(weights):
            x = x @ w + b
            if i + 1 < len(weights):
                x = np.maximum(x, 0)
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                yield pdf[keep].assign(**{name: list(forward(np.stack(pdf["vector"].to_numpy()).astype(float)))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*keep).schema.fields)
    return windows.select(*keep, "vector").mapInPandas(work, f"{kinds}, {name} array<double>")
